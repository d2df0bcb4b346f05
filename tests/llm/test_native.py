"""URL rules, quality rules, chat formatting and the SQL of their queries."""

import json
import random

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from cartlens.llm import chat_format, quality_rules, url_filters
from cartlens.llm.queries import ORACLES, QUERIES

RULES = "host string, path string, verdict string"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, key):
    got = QUERIES[key](spark, sf_dir).toArrow()
    assert compare(got, connect(sf_dir).sql(ORACLES[key]).to_arrow_table()) is None


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules_against_brute_force(spark):
    rules = [
        ("net", "/", "block"),
        ("example.net", "/en/", "allow"),
        ("example.net", "/en/private/", "block"),
        ("a.example.net", "/", "allow"),
        ("xample.net", "/", "block"),
        ("org", "/fr/", "allow"),
        ("org", "/fr/", "block"),
        ("", "", "block"),
    ]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "zexample.net", "EXAMPLE.net", "x.org", "org", "orgs", "", "é.net", ".net"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/x", "/en/private/y?q", "/fr/#f", "?a/en/", "/en\n/z")]
    urls += [None, "", "no scheme", "a://b://c/", urls[0], urls[0]]
    pages = spark.createDataFrame([(i % 80, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filters.filter_urls(pages, spark.createDataFrame(rules, RULES), keep=("page_id", "url")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url, rules), r.url


def test_url_rules_with_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert url_filters.filter_urls(pages, none, default="block").first().verdict == "block"
    assert url_filters.filter_urls(pages.where("false"), none).count() == 0


def brute_quality(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text or "").split(" ") if w]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_measures_against_brute_force(spark, messy):
    texts = ["a b c a b c", "a b c d a b c", "x\ny\nx\n \nx", "# * & word", "a a a a a", "the of " * 400, "é ü\u00a0ö x"]
    docs = messy.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    got = quality_rules.judge_quality(docs, keep=("doc_id", "text", "score")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_keeps_prose_and_runs_without_udfs(spark, no_docs):
    words = "the house of my friend is on a hill with an old garden".split()
    draw = random.Random(1)
    prose = " ".join(draw.choice(words) + str(draw.randrange(30)) * draw.randrange(2) for _ in range(120))
    docs = spark.createDataFrame([(1, prose), (2, prose.replace(" ", "# "))], "doc_id long, text string")
    judged = quality_rules.judge_quality(docs)
    assert {r.doc_id: r.kept for r in judged.collect()} == {1: True, 2: False}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert quality_rules.judge_quality(no_docs).count() == 0


CHAT = "conv_id long, turn long, role string, text string, kind string, call_id string, name string, arguments string, after string"
SCHEMA = chat_format.ToolSchema("add", {"a": "integer", "b": "number", "note": "string"}, ("a", "b"))


def test_chat_links_orders_and_validates(spark):
    rows = [
        (1, 0, "system", 'be "kind"\n', "message", None, None, None, None),
        (1, 1, "assistant", None, "call", "x", "add", '{"b":2.5, "a":1}', None),
        (1, 2, "tool", "3.5", "result", "x", None, None, None),
        (1, 3, "assistant", None, "call", "y", "add", '{"a":1}', "x"),
        (1, 4, "assistant", None, "call", "z", "add", '{"a":"1","b":2}', "y"),
        (1, 5, "tool", "again", "result", "x", None, None, None),
        (1, 0, "tool", "early", "result", "z", None, None, None),
        (1, 6, "tool", "lost", "result", "nobody", None, None, None),
        (1, 7, "assistant", None, "call", None, "add", "not json", None),
        (2, 0, "assistant", None, "call", "c1", "add", '{"a":1,"b":1,"c":2}', "c2"),
        (2, 1, "assistant", None, "call", "c2", "other", "{}", "c1"),
        (2, 2, "assistant", None, "call", "d", "add", '{"a":1,"b":1}', "absent"),
        (2, 3, "assistant", None, "call", "d", "add", '{"a":1,"b":1}', "absent"),
    ]
    got = {(r.conv_id, r.turn, r.call_id): r for r in chat_format.format_chat(spark.createDataFrame(rows, CHAT), [SCHEMA]).collect()}
    assert len(got) == len(rows)
    status = {k: r.status for k, r in got.items()}
    assert status[1, 0, None] == "plain" and status[1, 2, "x"] == "linked" and status[1, 5, "x"] == "repeated"
    assert status[1, 3, "y"] == "unanswered" and status[1, 0, "z"] == "early" and status[1, 6, "nobody"] == "orphan"
    assert status[1, 7, None] == "no_id" and status[2, 0, "c1"] == "cyclic" and status[2, 2, "d"] == "repeated"
    assert [got[1, t, c].level for t, c in ((1, "x"), (3, "y"), (4, "z"))] == [0, 1, 2]
    assert got[2, 0, "c1"].level is None and got[2, 2, "d"].level == 0
    valid = {k: r.valid for k, r in got.items()}
    assert valid[1, 1, "x"] is True and valid[1, 2, "x"] is None
    assert [valid[k] for k in ((1, 3, "y"), (1, 4, "z"), (1, 7, None), (2, 0, "c1"), (2, 1, "c2"))] == [False] * 5
    assert got[1, 1, "x"].json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","role":"assistant"}'
    assert json.loads(got[1, 0, None].json) == {"role": "system", "text": 'be "kind"\n'}
    assert json.loads(got[1, 7, None].json)["arguments"] is None


def test_identifiers_belong_to_their_conversation(spark):
    rows = []
    for conv in (1, 2, None):
        rows += [
            (conv, 0, "assistant", None, "call", "call_1", "add", '{"a":1,"b":1}', None),
            (conv, 1, "tool", f"two {conv}", "result", "call_1", None, None, None),
            (conv, 2, "assistant", None, "call", "call_2", "add", '{"a":1,"b":1}', "call_1"),
        ]
    rows.append((3, 0, "assistant", None, "call", "call_9", "add", '{"a":1,"b":1}', "call_1"))
    got = chat_format.format_chat(spark.createDataFrame(rows, CHAT), [SCHEMA]).collect()
    assert len(got) == len(rows)
    found = {(r.conv_id, r.turn): (r.status, r.level) for r in got}
    for conv in (1, 2, None):
        assert [found[conv, t] for t in range(3)] == [("linked", 0), ("linked", 0), ("unanswered", 1)]
    assert found[3, 0] == ("unanswered", 0)


def test_one_result_of_a_turn_is_linked(spark):
    long_text = "word " * 300_000
    rows = [(1, 0, "assistant", None, "call", "x", "add", '{"a":1,"b":1}', None)]
    rows += [(1, 1, "tool", t, "result", "x", None, None, None) for t in ("a", "b", long_text, None)]
    rows += [(1, None, "tool", "no turn", "result", "x", None, None, None)]
    rows += [(2, 0, "assistant", None, "call", "x", "add", '{"a":1,"b":1}', None)]
    rows += [(2, 1, "tool", "copy", "result", "x", None, None, None)] * 2
    chat = spark.createDataFrame(rows, CHAT)
    for name in ("id", "level", "call_turn", "n_calls", "result_place", "place", "parent", "status", "_args"):
        chat = chat.withColumn(name, F.lit("clash"))
    got = chat_format.format_chat(chat, [SCHEMA]).collect()
    one = [r.status for r in got if r.conv_id == 1 and r.kind == "result"]
    assert sorted(one) == ["linked"] + ["repeated"] * 4
    assert [r.status for r in got if r.conv_id == 1 and r.turn is None] == ["repeated"]
    assert [r.status for r in got if r.conv_id == 2] == ["linked"] * 3
    assert sum(json.loads(r.json).get("text") == long_text for r in got) == 1


def test_long_chains_and_empty_chats(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    levels = chat_format.topological_levels(spark.createDataFrame(chain, "id string, parent string"))
    assert {r.id: r.level for r in levels.collect()} == {f"n{i}": i for i in range(40)}
    assert chat_format.format_chat(spark.createDataFrame([], CHAT), [SCHEMA]).count() == 0
