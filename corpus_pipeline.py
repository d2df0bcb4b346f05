"""The corpus pipeline: five operators of the training-data package, one after the other, over ``documents``.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last one adds
the token ids. Every stage is written as Parquet and read again before the next, so a lost executor costs at most
one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import decontamination, quality_rules, sentencepiece_codec, simhash, simhash_groups, toxicity
from cartlens.llm.common import table
from cartlens.staging import stage

TOXIC_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one, so that no result of an operator can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; the model learns from the labels of the stage's own input."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(_packed(docs), model, keep=("doc",))
    return scored.where(F.col("score") < TOXIC_SCORE).select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.judge_quality(_packed(docs), keep=("doc",)).where("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies.

    Groups are those of the SimHash operator (fingerprints that differ in at most two bits), and an exact check over
    whole texts adds what fingerprints miss (five-word shingles, similarity 0.8 or more).
    """
    return simhash_groups.one_of_each_group(docs, also=simhash.near_duplicates)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark passages make up a twentieth or more."""
    found = decontamination.find_benchmark(_packed(docs), table(spark, sf_dir, "benchmark"), keep=("doc",))
    return decontamination.contamination(found).where(~F.col("contaminated")).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and the piece ids (``token_ids``) of every document."""
    encoded = sentencepiece_codec.encode_texts(_packed(docs), keep=("doc",))
    return encoded.select("doc.*", F.col("ids").alias("token_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: SQL has no SimHash, no fitted toxicity grammar and no piece lattice: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
