"""The toxicity fit ends at the least loss for all inputs, its sample is bounded, and clean documents stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import toxicity
from cartlens.llm.queries import QUERIES


def features(n, share, scale, seed):
    """Rows as the grammar makes them: toxic texts mostly match, clean ones seldom, long texts with many matches."""
    draw = np.random.default_rng(seed)
    y = (np.arange(n) < max(1, round(share * n))).astype(float)
    x = np.zeros((n, toxicity.N_FEATURES))
    hit = draw.random(n) < np.where(y == 1, 0.93, 0.02)
    for k in np.flatnonzero(hit):
        for c in draw.integers(0, 16, draw.integers(1, 4)):
            x[k, c] += draw.gamma(1.0, 4.0)
    x[:, :16] = np.minimum(scale * x[:, :16], 40.0)
    x[:, 16] = np.minimum(x[:, :16].max(axis=1), 10.0)
    x[:, 17] = np.minimum(100 * x[:, :16].sum(axis=1) / draw.integers(20, 2000, n), 20.0)
    return x, y


@pytest.mark.parametrize("share", [0.01, 0.03, 0.1, 0.25, 0.5])
@pytest.mark.parametrize("scale", [1, 2, 3, 5])
def test_fit_converges(share, scale):
    for seed, n in ((1, 3000), (2, 13_000), (3, 40)):
        x, y = features(n, share, scale, seed)
        weights, bias = toxicity._logistic(x, y)
        design = np.hstack([x, np.ones((n, 1))])
        w = np.append(weights, bias)
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + np.append(np.full(x.shape[1], toxicity.RIDGE), 0.1) * (w - np.append(toxicity.PRIOR, toxicity.PRIOR_BIAS))
        used = np.append(weights > 0, True)
        assert np.abs(gradient[used]).max() <= 1e-3 * n and (weights >= 0).all()
        assert 1 / (1 + np.exp(-bias)) < 0.5


def test_fit_without_end_is_an_error():
    x, y = features(100, 0.3, 1, 4)
    x[0, 0] = np.nan
    with pytest.raises((ArithmeticError, np.linalg.LinAlgError)):
        toxicity._logistic(x, y)


def test_share_of_matches_is_continuous():
    """A short text counts as one of twenty words."""
    scorer = toxicity.Scorer(toxicity.seed_lexicon())
    values = [scorer.features("you idiot" + " word" * n)[0][17] for n in range(40)]
    assert values[0] == values[18] == pytest.approx(100 * toxicity.SEED_WEIGHT / 20)
    assert all(b <= a and a - b < 0.06 * values[0] for a, b in zip(values, values[1:], strict=False))


def test_sample_is_distinct_and_bounded(spark):
    rows = [(i, "you are an idiot") for i in range(3000)] + [(7, "you are an idiot")] * 2000
    rows += [(5000 + i, f"clean text number {i}") for i in range(500)] + [(6000 + i, f"you moron {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", F.col("text").rlike("idiot|moron").cast("int").alias("toxic")).distinct()
    sample, sizes = toxicity.labelled_sample(docs, labels, doc_id="doc_id", text="text", label="toxic", sample_rows=100)
    counts = {r["y"]: (r["n"], r["d"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("text").alias("d")).collect()}
    assert counts[0] == (100, 100) and counts[1][0] == counts[1][1] <= 100 and counts[1][0] > 90
    assert sizes == {0: 500, 1: 5300}


def test_a_text_without_matches_is_never_toxic(spark):
    """Also where nearly all labelled texts are toxic and the words tell nothing."""
    rows = [(i, f"plain words {i}") for i in range(200)] + [(1000 + i, f"other words {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    empty = toxicity.score_toxicity(spark.createDataFrame([(1, ""), (2, None), (3, "nothing here")], "doc_id long, text string"), model)
    assert all(r["score"] < 0.5 for r in empty.where("doc_id < 3").collect())


def test_entries_of_equal_texts_lose_nothing(spark, sf_dir):
    """The lexicon is the one that covering finds among all entries."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    texts = {(r["text"], marks[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in marks and r["text"] is not None}
    sets = [(toxicity.entries_of(t), y) for t, y in texts]
    n_yes, n_no = sum(y for _, y in sets), sum(1 - y for _, y in sets)
    yes, no = {}, {}
    for entries, y in sets:
        for e in entries:
            (yes if y else no)[e] = (yes if y else no).get(e, 0) + 1
    weights = {e: toxicity.log_odds_bound(k, no.get(e, 0), n_yes, n_no) for e, k in yes.items() if k >= max(3, n_yes // 400)}
    weights = {e: w for e, w in weights.items() if w > 1.5}
    want = toxicity.cover([sorted(e & weights.keys()) for e, y in sets if y], weights, max(3, n_yes // 400))
    got = {**{"=" + w: v for w, (s, v) in model.lexicon.words.items() if s == toxicity.INSULT and ("=" + w) in weights}, **{w: v for w, (_, v) in model.lexicon.stems.items()}}
    assert {e: round(min(w, 6.0), 4) for e, w in want.items()}.items() <= got.items()


def test_query_keeps_clean_and_finds_toxic(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, sf_dir).collect() if r["doc_id"] in labels]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.8 * len(toxic)


def test_pipeline_stage_keeps_clean_documents(spark):
    from corpus_pipeline import STAGES

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in dict(STAGES)["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    clean = [i for i in ids if labels.get(i) == 0]
    toxic = [i for i in ids if labels.get(i) == 1]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean) and sum(i in kept for i in toxic) <= 0.25 * len(toxic)
