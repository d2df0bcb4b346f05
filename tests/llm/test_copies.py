"""SimHash near-duplicates, decontamination and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from messy_rows import MESSY
from pyspark.sql import functions as F

from cartlens.llm import decontamination, simhash, simhash_groups
from cartlens.llm.common import table
from cartlens.llm.components import connected_components
from cartlens.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# --- fingerprints ------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_of_the_query(spark, sf_dir):
    rows = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    prints = {k: brute_fingerprint(t) for k, t in rows.items()}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(prints, links)
    got = QUERIES["op3_simhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in rows}
    assert len(got) == len(rows)


@pytest.mark.parametrize("dense", [1, 4, 10_000])
def test_links_keep_components_whole(spark, dense, monkeypatch):
    """Chains, crowded families and far fingerprints, with and without dense lists."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng, prints = random.Random(5), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        family = [centre]
        for _ in range(25):
            base = rng.choice(family)
            for _ in range(rng.choice((1, 2, 2, 3))):
                base ^= 1 << rng.randrange(64)
            family.append(base)
        prints.update(family)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.link_fingerprints(frame).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    if dense > 1000:
        assert {frozenset(x) for x in found} == {frozenset(x) for x in links}
    assert components(signed, found) == components(signed, links)
    roots = {r.id: r.root for r in connected_components(simhash.link_fingerprints(frame)).collect()}
    want = components(signed, links)
    assert {n: roots.get(n, n) for n in signed} == want


def test_fingerprints_of_messy_rows(spark, messy, no_docs):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == len(MESSY)
    group = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert all(r.component_id == 2 and r.fp == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert {r.component_id for r in rows if r.doc_id in (None, 7)} == {7}
    assert len(group) == len(MESSY) - 1
    assert simhash.near_duplicates(no_docs).count() == 0


# --- near copies by similarity -------------------------------------------------------------------------------------


def shingles(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def family_texts():
    """Families of near copies, one of them large, among other texts that share one passage."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    for size, length in ((1, 60), (2, 40), (3, 200), (60, 150), (8, 700), (2, 12)):
        base = rng.choices(vocabulary, k=length)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, length // 60))):
                words[rng.randrange(length)] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(rng.choices(vocabulary, k=90) + passage) for _ in range(60)]
    return texts + [texts[0], texts[5].upper(), "", "one", "one"]


def test_one_of_each_group_against_all_pairs(spark):
    texts = family_texts()
    sets = [shingles(t) for t in texts]
    alike = [
        (a, b)
        for a, b in combinations(range(len(texts)), 2)
        if lower(texts[a]).split() == lower(texts[b]).split() or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    ]
    want = components(range(len(texts)), alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash_groups.one_of_each_group(docs).collect())
    assert kept == sorted(set(want.values()))


@pytest.mark.parametrize("words", [1, 16])
def test_bitmaps_drop_no_similar_pair(spark, words, monkeypatch):
    """Sets of similarity 0.8 or more pass, for bitmaps of any two sizes, and few others do."""
    monkeypatch.setattr(simhash_groups, "NARROW", words)
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in [*range(1, 40), 63, 64, 65, 250, 1000, 5000]:
        for share in (0.5, 0.75, 0.799, 0.8, 0.81, 1.0):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            common = int(np.ceil(share * n))
            for other in (base[:common], np.concatenate([base[:common], rng.integers(0, 2**63, n - common, dtype=np.uint64)])):
                bits = [simhash_groups.parities(h) for h in (base, other)]
                slim = [simhash_groups.folded(x, words) for x in bits]
                both = len(set(base.tolist()) & set(other.tolist()))
                want.append(9 * both >= 4 * (n + len(other)))
                rows.append((len(rows), n, len(other), *[x.tolist() for x in (*bits, *slim)]))
    table = spark.createDataFrame(rows, "i int, n int, n_b int, bits array<long>, bits_b array<long>, narrow array<long>, narrow_b array<long>")
    size = F.greatest("n", "n_b") * 4 <= F.least("n", "n_b") * 5
    wide, slim = simhash_groups._alike("bits"), simhash_groups._alike("narrow")
    got = [tuple(r) for r in table.orderBy("i").select(size, wide, slim).collect()]
    assert all(all(g) for g, w in zip(got, want, strict=True) if w)
    assert sum(g[0] and g[1] for g in got) < 1.2 * sum(want)


def groups_of(texts):
    sets = [shingles(t) for t in texts]
    alike = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    return components(range(len(texts)), alike)


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in simhash_groups.one_of_each_group(docs).collect())


def altered(rng, base, changes):
    words = list(base)
    for at in rng.sample(range(len(base)), changes):
        words[at] = f"w{rng.getrandbits(40):x}"
    return " ".join(words)


@pytest.mark.parametrize("turns", [0, 2])
def test_large_family_without_its_base_equals_all_pairs(spark, turns, monkeypatch):
    """Members about 0.8 from each other: whether two are linked is a matter of a few shingles."""
    monkeypatch.setattr(simhash_groups, "TURNS", turns)
    monkeypatch.setattr(simhash_groups, "BLOCK", 100)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = [altered(rng, base, rng.choice((2, 3, 3, 4, 4))) for _ in range(300)]
    want = sorted(set(groups_of(texts).values()))
    assert 1 < len(want) < len(texts) - 50
    assert kept_of(spark, texts) == want


def pairs_near(low, high, sizes, seed):
    """Pairs of texts of ``sizes`` shingles with a similarity in [low, high)."""
    rng, texts = random.Random(seed), []
    for k, n in enumerate(sizes):
        base = [f"p{k}x{i}" for i in range(n + 4)]
        while True:
            changed = altered(rng, base, rng.randint(1, max(1, n // 30)))
            a, b = shingles(" ".join(base)), shingles(changed)
            if low <= len(a & b) / len(a | b) < high:
                break
        texts += [" ".join(base), changed]
    return texts


def test_similarity_of_long_texts_is_exact(spark):
    """A sample of 256 shingles cannot tell 0.79 from 0.81."""
    sizes = [400, 700, 1500, 3000] * 5
    apart, alike = pairs_near(0.78, 0.8, sizes, 1), pairs_near(0.8, 0.82, sizes, 2)
    assert kept_of(spark, apart) == list(range(len(apart)))
    assert kept_of(spark, alike) == list(range(0, len(alike), 2))


def test_no_pair_just_above_the_limit_is_lost(spark):
    sizes = [60, 70, 90, 130, 200, 255] * 10 + [6000]
    alike = pairs_near(0.8, 0.82, sizes, 4)
    assert kept_of(spark, alike) == list(range(0, len(alike), 2))


def test_one_of_each_group_of_messy_rows(spark, messy, no_docs):
    kept = simhash_groups.one_of_each_group(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7]
    assert simhash_groups.one_of_each_group(no_docs).count() == 0


def test_pipeline_links_by_fingerprint_and_by_similarity(spark):
    """The stage drops what the SimHash operator links, also where the sets of shingles are far apart, and near copies
    that fingerprints miss; a chain may have links of both kinds."""
    rng = random.Random(4)
    texts = family_texts()
    for k in range(8):
        passage = " ".join(f"r{k}x{i}" for i in range(12))
        texts += [" ".join([passage] * 60 + [f"t{k}x{j}x{i}" for i in range(20)]) for j in range(3)]
        base = texts[-1].split()
        texts.append(" ".join(base[:-1] + [f"u{k}"]))
        texts.append(altered(rng, [f"v{k}x{i}" for i in range(60)], 0))
    texts += ["", None, "two"]
    sets = [shingles(t) for t in texts]
    prints = [brute_fingerprint(t) for t in texts]
    by_print, by_sets = set(), set()
    for a, b in combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            by_print.add((a, b))
        if lower(texts[a]).split() == lower(texts[b]).split() or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
            by_sets.add((a, b))
    assert by_print - by_sets and by_sets - by_print
    want = sorted(set(components(range(len(texts)), by_print | by_sets).values()))
    assert len(want) < len(set(components(range(len(texts)), by_sets).values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


# --- decontamination -------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = word.findall(lower(item_text))
        windows = {tuple(own[i : i + 13]) for i in range(len(own) - 12)} or ({tuple(own)} if own else set())
        for m in {len(w) for w in windows}:
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    if item is not None:
                        found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination_query_against_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = QUERIES["op10_decontamination"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(rows[r.doc_id], items)


@pytest.mark.parametrize("part_words", [500_000, 20])
def test_decontamination_with_short_items_and_parts(spark, messy, part_words):
    items = [(1, "You are an IDIOT"), (2, "a"), (3, ""), (4, None), (10, "the words of"), (10, "the words of"), (None, "The end of it"), (None, "without an id"), (5, "words of a text without an id and then some more of it")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_benchmark(messy, benchmark, keep=("doc_id", "text", "score"), part_words=part_words)
    got = decontamination.contamination(found).collect()
    assert len(got) == len(MESSY)
    for r in got:
        want = brute_hits(r.text, [(i, t) for i, t in set(items) if t])
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (*want[:3], want[4]), r.text
    assert decontamination.find_benchmark(messy.where("false"), benchmark).count() == 0
    none = decontamination.contamination(decontamination.find_benchmark(messy, benchmark.where("false"))).collect()
    assert len(none) == len(MESSY) and not any(r.n_hit for r in none)


def test_search_on_repetitive_texts():
    rng = random.Random(2)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choices("ab", k=rng.randint(1, 18)))) for i in range(4)]
        text = " ".join(rng.choices("ab", k=rng.randint(0, 60)))
        ranges, found = decontamination.Searcher(items).search(decontamination.words_of(text))
        want = brute_hits(text, items)
        assert (sum(b - a for a, b in ranges), len(found)) == want[1:3]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages_drop_what_they_judge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == [*docs.columns, "token_ids"]
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "near-duplicates"
    rows = final.collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert len({tuple(lower(r.text).split()) for r in rows}) == len(rows)
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert not any(brute_hits(r.text, items)[4] for r in rows)
    kept = {r.doc_id for r in rows}
    judged = QUERIES["op9_quality_rules"](spark, sf_dir).where("kept").select("doc_id").collect()
    assert kept <= {r.doc_id for r in judged}
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    clean = [r.doc_id for r in judged if labels.get(r.doc_id) == 0]
    assert len(kept & set(clean)) >= 0.8 * len(clean)  # the rest are copies and benchmark passages


def test_stages_of_messy_rows(spark, messy, sf_dir):
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, messy, sf_dir)
        assert out.columns[: len(messy.columns)] == messy.columns, name
        assert out.count() <= len(MESSY)
        assert function(spark, messy.where("false"), sf_dir).count() == 0, name


def test_buckets_are_crc32(spark):
    from cartlens.llm.common import crc_bucket

    rows = spark.range(50).select(F.col("id").alias("doc_id"), crc_bucket("doc_id", 5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
