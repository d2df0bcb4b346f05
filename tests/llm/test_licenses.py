"""License scans against regular expressions over the joined words."""

import re

import pytest
from pyspark.sql import functions as F

from cartlens.llm import licenses, queries
from cartlens.llm.license_templates import PHRASES, TEMPLATES


def as_regex(parts) -> str:
    """A template as a pattern over words that are each followed by a blank."""
    out = ""
    for kind, *value in parts:
        if kind == "word":
            out += re.escape(value[0]) + " "
        elif kind == "any":
            out += r"(?:\S+ ){%d,%d}" % tuple(value)
        elif kind == "one":
            out += "(?:" + "|".join("".join(re.escape(w) + " " for w in words) for words in value[0]) + ")"
        else:
            out += f"(?:{as_regex(value[0])})?"
    return out


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}) if text else "")
    tails = ["".join(w + " " for w in words[i:]) for i in range(len(words))]
    found = []
    entries = [*[(label, phrase, True) for phrase, label in PHRASES.items()], *[(k, t, False) for k, t in TEMPLATES.items()]]
    for label, template, phrase in entries:
        pattern = re.compile(as_regex(licenses.parse(template)))
        for i, tail in enumerate(tails):
            ends = [m.end() for m in [pattern.match(tail)] if m]
            # The longest match: try every shorter tail as a whole as well.
            if ends:
                n = max(k for k in range(tail[: ends[0]].count(" "), min(len(words) - i, 600) + 1) if pattern.fullmatch("".join(w + " " for w in words[i : i + k])))
                found.append((label, phrase, i, i + n))
    return len(words), sorted(found)


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Apache license mit license MIT LICENSE cc by-nc, cc by cc by",
    "Made available under the terms of the GNU General Public License, either version 3 of it, and under CC BY-NC 4.0!",
    "licensed under under the MIT license; released under the MIT    License",
    "permission to use software is here by granted " * 3,
    re.sub(r'<<var;name="holder";words="1-20">>', "the authors or copyright holders", TEMPLATES["mit-text"]).replace("<<beginOptional>>", "").replace("<<endOptional>>", ""),
    re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", TEMPLATES["isc-text"]).replace('<<var;name="holder";words="1-20">>', "a b"),
    re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", TEMPLATES["isc-text"]).replace('<<var;name="holder";words="1-20">>', "a b").replace("WHATSOEVER", "ANYWAY"),
    "",
    None,
]


def test_templates_against_regular_expressions():
    automaton = licenses.Automaton([*[(label, phrase) for phrase, label in PHRASES.items()], *TEMPLATES.items()])
    for text in TEXTS:
        n, matches = automaton.search(licenses.words_in(text))
        got = sorted((automaton.labels[k], k < len(PHRASES), a, b) for a, b, k in matches)
        assert (n, got) == brute(text), text
    assert [label for label, *_ in brute(TEXTS[5])[1]] == ["mit-text"]
    assert not brute(TEXTS[7])[1]  # one mandatory word differs


@pytest.mark.parametrize("run", [1, 2, 7])
def test_long_texts_are_read_in_runs(monkeypatch, run):
    monkeypatch.setattr(licenses, "RUN", run)
    automaton = licenses.Automaton([("a", 'x <<var;name="n";words="0-3">> y'), ("b", "x y"), ("c", "y")])
    words = "x x p y x y q x p q r y y x p q r s y".split()
    _, matches = automaton.search(iter(words))
    want = []
    for i, _ in enumerate(words):
        for number, least in ((0, 0), (1, 0), (2, 0)):
            ends = [j + 1 for j in range(i, len(words)) if words[j] == "y" and {0: words[i] == "x" and 1 <= j - i <= 4, 1: words[i] == "x" and j == i + 1, 2: j == i}[number]]
            if ends:
                want.append((i, max(ends), number))
    assert sorted(matches) == sorted(want)


def test_whole_texts_and_wrong_markup():
    automaton = licenses.Automaton([("a", 'one <<beginOptional>>two<<endOptional>> <<var;name="n";match="three|four five">>')])
    assert automaton.whole(["one", "three"]) == automaton.whole("one two four five".split()) == ["a"]
    assert automaton.whole(["one", "two"]) == automaton.whole("one two four five six".split()) == []
    for bad in ("one <<beginOptional>> two", "<<what>> one", '<<var;name="n";words="0-3">> one', "<<beginOptional>>one<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.Automaton([("a", bad)])


def test_tables_are_made_anew_when_full(monkeypatch):
    automaton = licenses.Automaton(list(TEMPLATES.items()))
    want = automaton.search(licenses.words_in(TEXTS[5]))
    monkeypatch.setattr(licenses, "HELD", 1)
    assert automaton.search(licenses.words_in(TEXTS[5])) == want


def test_query_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_license_scans"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        r = got[doc_id]
        if re.search("licen|apache|cc|permission|redistribution|program|software|released|available", text or "", re.I):
            n, found = brute(text)
            base = [m for m in found if m[1]]
            inside = {w for _, _, a, b in found for w in range(a, b)}
            assert (r["n_words"], r["n_base"]) == (n, len(base))
            assert r["first_word"] == min((m[2] for m in base), default=None)
            assert r["last_word"] == max((m[2] for m in base), default=None)
            assert r["base_labels"] == ",".join(sorted({m[0] for m in base}))
            assert r["labels"] == ",".join(sorted({m[0] for m in found}))
            assert r["score"] == pytest.approx(len(inside) / n if n else 0.0)
        else:
            assert (r["n_base"], r["labels"], r["score"]) == (0, "", 0.0)
    assert sum(r["n_base"] for r in got.values()) > 0


def test_messy_rows(messy, no_docs):
    found = licenses.scan_licenses(messy, keep=("doc_id", "key"))
    rows = found.collect()
    assert len(rows) == messy.count() and all(r["matches"] == [] and r["score"] == 0.0 for r in rows)
    assert licenses.scan_licenses(no_docs).count() == 0
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}


def test_a_text_of_many_words(spark):
    text = "filler words " * 300_000 + "under the MIT license " + "Released under the MIT License. " * 2
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_words"] == 600_014 and [m["label"] for m in row["matches"]].count("mit") == 3
    assert row["score"] == pytest.approx(12 / 600_014)
    labels = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(licenses.labels_of(F.col("matches"))).first()[0]
    assert labels == "mit,mit-notice"
