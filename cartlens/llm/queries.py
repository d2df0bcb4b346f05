"""One registered query per operator, with production parameters over its whole tables, and the SQL that
defines its result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import (
    chat_format,
    decontamination,
    hard_negatives,
    language_id,
    licenses,
    merkle,
    ngram_lm,
    quality_rules,
    sentencepiece_codec,
    simhash,
    token_counts,
    toxicity,
    url_filters,
)
from cartlens.llm.common import ascii_lower, crc_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


#: host, path, verdict (fixed values of the contract).
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
URL_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT s.*, rule_host || rule_path AS rule, verdict, row_number() OVER (
      PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM split s LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE n = 1
"""


@query("op1_url_filters", URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 3) == 1
    model = language_id.fit_languages(docs.where(~held_out))
    return language_id.identify_languages(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), verify=True)
    return encoded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "lossless")


REPLY = chat_format.ToolSchema("reply", {"prompt": "string", "turn": "integer"}, ("prompt", "turn"))
CHAT_SQL = """
WITH kinds AS (
  SELECT conv_id, turn, role, text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_turn
  FROM conversations
), calls AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS n
  FROM kinds WHERE kind = 'call'
), levels AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * n ORDER BY turn) - 1 AS level
  FROM calls
)
SELECT k.conv_id, k.turn, k.role, k.kind, k.conv_id::VARCHAR || ':' || k.call_turn::VARCHAR AS call_id,
  CASE WHEN kind = 'message' THEN 0 ELSE l.level END AS level,
  CASE WHEN kind = 'message' THEN 'plain' WHEN kind = 'result' AND l.level IS NULL THEN 'orphan'
    WHEN kind = 'call' AND r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN kind = 'call' THEN true END AS valid,
  CASE kind
    WHEN 'call' THEN '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || k.turn || '},"id":"'
      || k.conv_id || ':' || k.call_turn || '","name":"reply","role":' || to_json(k.role) || '}'
    WHEN 'result' THEN '{"id":"' || k.conv_id || ':' || k.call_turn || '","role":' || to_json(k.role)
      || ',"text":' || to_json(text) || '}'
    ELSE '{"role":' || to_json(k.role) || ',"text":' || to_json(text) || '}' END AS json
FROM kinds k
LEFT JOIN levels l ON k.conv_id = l.conv_id AND k.call_turn = l.turn
LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') r
  ON k.kind = 'call' AND r.conv_id = k.conv_id AND r.turn = k.turn + 1
"""


def reply_calls(conversations: DataFrame) -> DataFrame:
    """Conversations as calls of a tool ``reply``: a user turn calls it, the assistant turn behind it is the
    result, and a call follows the call two turns before."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"

    def ident(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    return conversations.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, ident(F.col("turn"))).when(assistant, ident(F.col("turn") - 1)).alias("call_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(user, ident(F.col("turn") - 2)).alias("after"),
    )


@query("op8_chat_format", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chat(reply_calls(table(spark, sf_dir, "conversations")), [REPLY])


_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in quality_rules.STOP_WORDS.values() for w in words}))
_BLANK = r"[\x20\x09-\x0D]"
QUALITY_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, length(t) AS n_chars,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.5 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop >= 0.05 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_chars - word_chars <= 0.6 * n_chars AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.contamination(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op11_license_scans")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("base", licenses.phrase_places())
    starts = F.transform("base", lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels_of("base").alias("base_labels"),
        licenses.labels_of("matches").alias("labels"),
        "score",
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine_negatives(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted
    )
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Levels of trees and of the top tree that the SQL writes out: eight to that power are leaves of a group, and groups.
MERKLE_LEVELS, MERKLE_TOP = 7, 4


def _merkle_tree_sql(name: str, key: str, levels: int) -> tuple[list[str], str]:
    """Tables name0 .. (key, i, d, n: nodes of the level) upwards from name0, and a query for the root of every key."""
    steps = [
        f"""{name}{k + 1} AS (SELECT {key}, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d,
    string_agg(d, '' ORDER BY i) AS run, (n + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY {key}, i // 8, n)"""
        for k in range(levels)
    ]
    roots = " UNION ALL ".join(f"SELECT {key}, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return steps, roots


def _merkle_fold_sql(source: str, tree: str, key: str, levels: int, at: str) -> list[str]:
    """Tables source1 .. : ``folded`` and ``siblings`` of every row of source0 carried one level up each."""
    steps = []
    for k in range(levels):
        place = f"64 * (s.{at} // {8**k} % 8)"
        steps.append(
            f"""{source}{k + 1} AS (SELECT s.* REPLACE (
    CASE WHEN run IS NULL THEN folded ELSE sha256(left(run, {place}) || folded || substr(run, {place} + 65)) END AS folded,
    CASE WHEN run IS NULL THEN siblings ELSE siblings || left(run, {place}) || substr(run, {place} + 65) END AS siblings)
  FROM {source}{k} s LEFT JOIN {tree}{k + 1} t ON t.i = s.{at} // {8 ** (k + 1)} AND {key})"""
        )
    return steps


def _merkle_sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        names = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
        return f"sha256({' || '.join(map(field, names))})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree, roots = _merkle_tree_sql("t", "lang", MERKLE_LEVELS)
    top, top_root = _merkle_tree_sql("g", "one", MERKLE_TOP)
    steps = [
        # crc32 by its table: 256 entries made by the shift rule.
        """crc AS (SELECT list(list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS entries
  FROM range(256) AS bytes(b))""",
        """sums AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
    lambda x: ascii(x)::BIGINT)), lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM documents, crc)""",
        f"""leaves AS (SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS seen FROM sums)""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves)""",
        "t0 AS (SELECT lang, i, leaf AS d, n FROM numbered)",
        *tree,
        f"roots AS ({roots})",
        """g0 AS (SELECT 1 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, d,
    count(*) OVER () AS n FROM roots)""",
        *top,
        f"root AS ({top_root})",
        """a0 AS (SELECT s.doc_id, s.lang, s.i, s.leaf, g0.d AS subroot, g0.i AS g, seen AS folded, '' AS siblings
  FROM numbered s JOIN g0 ON s.lang IS NOT DISTINCT FROM g0.lang)""",
        *_merkle_fold_sql("a", "t", "t.lang IS NOT DISTINCT FROM s.lang", MERKLE_LEVELS, "i"),
        f"b0 AS (SELECT * FROM a{MERKLE_LEVELS})",
        *_merkle_fold_sql("b", "g", "true", MERKLE_TOP, "g"),
    ]
    return "WITH " + ", ".join(steps) + f"""
SELECT doc_id, leaf, subroot, root.d AS root, sha256(siblings) AS proof_sha256, folded AS folded_root,
  folded = root.d AS verified FROM b{MERKLE_TOP}, root"""


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns])
    manifest = merkle.build_manifest(
        table(spark, sf_dir, "documents"),
        columns=columns,
        keep={"doc_id": F.col("doc_id"), "tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered)},
    )
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("path"))
    proven = manifest.proofs().withColumn("folded_root", folded)
    return proven.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
