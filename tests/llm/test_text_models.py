"""Toxicity, token counts, language identification, language model, SentencePiece codec."""

import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from messy_rows import MESSY
from pyspark.sql import functions as F

from cartlens.llm import language_id, ngram_lm, sentencepiece_codec, token_counts, toxicity
from cartlens.llm import pieces as pc
from cartlens.llm.common import crc_bucket, table
from cartlens.llm.elias_fano import BigramTrie, EliasFano
from cartlens.llm.queries import QUERIES

# --- toxicity --------------------------------------------------------------------------------------------------


def test_grammar_scopes():
    scorer = toxicity.Scorer(toxicity.seed_lexicon())

    def channels(text):
        features, words = scorer.features(text)
        return {c for c in range(16) if features[c]}, words

    assert channels("What an idiot.") == ({0}, ["idiot"])
    assert channels("You are an idiot.") == ({1}, ["idiot"])
    assert channels("He is not an idiot.") == ({3}, ["idiot"])
    assert channels("It was not, idiot.") == ({0}, ["idiot"])
    assert channels("The paper said what an idiot. Idiot!") == ({4, 0}, ["idiot"])
    assert channels("I will kill you") == (set(), [])
    assert channels("you I will kill")[0] == {9}
    assert channels("idiotic") == (set(), [])


def test_composition_is_the_product():
    a, b = toxicity.scope(toxicity.TARGET, 2, (toxicity.STOP,)), toxicity.scope(toxicity.REPORT, None, (toxicity.STOP,))
    rows, rng = toxicity.compose([a, b]), np.random.default_rng(0)
    state = sa = sb = 0
    for symbol in rng.integers(0, 8, 500).tolist():
        (sa, oa), (sb, ob) = a[sa, symbol], b[sb, symbol]
        state, out = rows[state][symbol]
        assert out == oa + 2 * ob


def test_toxicity_held_out(spark, sf_dir):
    rows = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "labels"), "doc_id"
    )
    counts = Counter((r.toxic, r.predicted) for r in rows.where("held_out").collect())
    assert counts[0, 1] <= 2 and counts[1, 1] >= 2 * counts[1, 0]
    assert rows.where("score < 0 or score > 1").count() == 0


def test_toxicity_of_messy_rows(spark, messy, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (6, 0), (2, 1), (9, None)], "doc_id long, toxic int")
    for docs, marks in ((messy, labels), (messy, labels.where("false")), (no_docs, labels)):
        model = toxicity.fit_toxicity(docs, marks)
        got = toxicity.score_toxicity(messy, model).collect()
        assert len(got) == len(MESSY)
        scores = defaultdict(set)
        for r in got:
            scores[r.doc_id].add(r.score)
        assert len(scores[1]) == 1 and scores[2] == scores[3] == scores[4]
        assert max(scores[1]) > max(scores[3])
    assert toxicity.score_toxicity(no_docs, toxicity.default_model()).count() == 0


# --- vocabulary, counts, codec ------------------------------------------------------------------------------------


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


@pytest.fixture(scope="module")
def vocabulary():
    return pc.read_vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The public library with the same pieces and scores, as a unigram model."""
    out, i = b"", 0
    for number, value in pc.read_fields(open(pc.MODEL_PATH, "rb").read()):
        if number == 1:
            entry = dict(pc.read_fields(value))
            score = struct.pack("<f", vocabulary.scores.get(i, 0) / pc.UNIT)
            kind = _varint(3 << 3) + _varint(entry[3]) if 3 in entry else b""
            out += _field(1, _field(1, entry[1]) + _varint(2 << 3 | 5) + score + kind)
            i += 1
        elif number == 2:
            spec = b""
            for at, v in pc.read_fields(value):
                v = pc.UNIGRAM if at == 3 else v
                fixed = at in (10, 15)
                spec += _varint(at << 3) + _varint(v) if isinstance(v, int) else _varint(at << 3 | 5) + v if fixed else _field(at, v)
            out += _field(2, spec)
        else:
            out += _field(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


ODD = ["", "a", " a  b ", "\n\n x\ty  ", "日本語 🙂 é", "▁weird▁ mark", "0123 456,78", "   ", "\x01ctl", "ab" * 5000]


def test_codec_and_counts_match_the_library(spark, sf_dir, vocabulary, library):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()] + ODD
    codec = sentencepiece_codec.Codec(*sentencepiece_codec.codec_tables(vocabulary))
    pieces = [(vocabulary.pieces[i], s) for i, s in vocabulary.scores.items()]
    counter = token_counts.TokenCounter(pieces, vocabulary.unknown_score, True)
    together = sentencepiece_codec.Codec(*sentencepiece_codec.codec_tables(vocabulary)).encode_batch(texts)
    for text, batch_ids in zip(texts, together, strict=True):
        ids = codec.encode(text)
        assert ids == batch_ids == library.encode(text), text[:80]
        assert counter.count(text) == len(ids)
        assert codec.decode(ids) == library.decode(ids)
        assert codec.decode(ids) == text or pc.MARK in text


def test_double_array_holds_exactly_its_words():
    words = {w: i for i, w in enumerate(["a", "ab", "abc", "b", "bcd", "é", "日本", "zz"])}
    codes, base, check, value = sentencepiece_codec.build_double_array(words)

    def look_up(word):
        state = 0
        for c in word:
            after = base[state] + codes.get(c, 0)
            if not codes.get(c) or not base[state] or after >= len(check) or check[after] != state:
                return -1
            state = after
        return value[state]

    for word in [*words, "", "c", "bc", "abcd", "日", "zzz"]:
        assert look_up(word) == words.get(word, -1)


def test_codec_of_messy_rows(spark, messy, no_docs):
    encoded = sentencepiece_codec.encode_texts(messy, keep=("doc_id", "text", "score"), verify=True)
    rows = encoded.collect()
    assert len(rows) == len(MESSY) and all(r.lossless for r in rows)
    assert all((r.ids == []) == (not r.text) for r in rows)
    decoded = sentencepiece_codec.decode_ids(encoded, keep=("ids",)).collect()
    assert sorted(r.text for r in decoded) == sorted(t or "" for _, t in MESSY)
    counts = token_counts.count_tokens(messy).collect()
    assert Counter((r.doc_id, len(r.ids)) for r in rows) == Counter((r.doc_id, r.n_tokens) for r in counts)
    assert sentencepiece_codec.encode_texts(no_docs).count() == token_counts.count_tokens(no_docs).count() == 0


# --- languages -----------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["a", "b", "ab", "ba", "aba"])
    p = np.array([[0.4, 0.1], [0.2, 0.3], [0.15, 0.2], [0.15, 0.2], [0.1, 0.2], [1e-6, 1e-6]])
    table_ = dict(zip(["a", "b", "ab", "ba", "aba"], p, strict=False))

    def brute(text):
        if not text:
            return np.ones(2)
        total = sum((table_[text[:k]] * brute(text[k:]) for k in range(1, len(text) + 1) if text[:k] in table_), np.zeros(2))
        return total if text[0] in table_ else p[-1] * brute(text[1:])

    chunks = ["a", "abab", "babaab", "c", "acb"]
    sizes = np.array([len(c) for c in chunks])
    _, whole = language_id.forward(lattice.arcs(chunks), sizes, p)
    assert np.allclose(whole, [brute(c) for c in chunks])
    # Expected counts of a chunk are those of its pieces, weighed by the posterior.
    expected = language_id.expected_counts(lattice, ["ab"], np.array([[2.0]]), p[:, 0])
    split, joined = 0.4 * 0.2, 0.15
    assert np.allclose(expected[0][:3], [2 * split / (split + joined)] * 2 + [2 * joined / (split + joined)])


def test_whole_texts_are_scored(vocabulary):
    pieces = [vocabulary.pieces[i] for i in vocabulary.scores]
    lattice = language_id.Lattice(pieces)
    for text in ("¿qué? «l'eau» 12,5", "नमस्ते दुनिया", "x" * 500):
        assert "".join(lattice.chunks(text)) == pc.marked(text)


def test_long_chunks_are_not_cut():
    """Sums over chunks of any length, also far below the smallest double."""
    lattice = language_id.Lattice(["a", "aa"])
    p = np.array([[0.01, 0.02], [0.001, 0.003], [1e-7, 1e-7]])
    model = language_id.Identifier(["x", "y"], ["a", "aa"], p, np.zeros(2))
    chunks = ["a" * n for n in (5, 40, 1000)]
    model._learn(chunks)
    logs = np.concatenate(model.logs)
    for chunk in chunks:
        before, last, scale = np.ones(2), p[0].copy(), np.zeros(2)
        for _ in range(len(chunk) - 1):
            before, last = last, p[0] * last + p[1] * before
            scale, before, last = scale + np.log(last), before / last, np.ones(2)
        assert np.allclose(logs[model.rows[chunk]], np.log(last) + scale)
    one = language_id.expected_counts(lattice, ["a" * 1000], np.array([[1.0]]), p[:, 0])
    assert math.isclose(one[0][0] + 2 * one[0][1], 1000, rel_tol=1e-9)


def test_arcs_are_all_places_of_pieces():
    pieces = ["a", "b", "ab", "ba", "aba", "\U0001f600", "aaaa"]
    lattice = language_id.Lattice(pieces)
    chunks = ["abab", "c", "aaaaa\x00", "\U0010ffff\U0001f600b", "a" * 50]
    want = Counter()
    for k, chunk in enumerate(chunks):
        for start in range(len(chunk)):
            hits = [n for n, piece in enumerate(pieces) if chunk.startswith(piece, start)]
            want.update((k, start, start + len(pieces[n]), n) for n in hits)
            if chunk[start] not in pieces:
                want[k, start, start + 1, lattice.unknown] += 1
    assert Counter(zip(*(column.tolist() for column in lattice.arcs(chunks)), strict=True)) == want
    assert [len(column) for column in language_id.Lattice([]).arcs(["xy"])] == [2] * 4


def test_sums_of_chunks_are_seldom_copied():
    """Batch after batch of new chunks goes into one table that grows by doubling."""
    model = language_id.Identifier(["x", "y"], ["a", "b"], np.full((3, 2), 0.25), np.zeros(2))
    words = ["a" * n + "b" * m for n in range(1, 30) for m in range(1, 30)]
    tables = []
    for k in range(0, len(words), 10):
        model.identify(words[k : k + 10])
        tables.append(model.logs[0])
    assert len({t.__array_interface__["data"][0] for t in tables}) < 10 < len(tables)
    logs = np.concatenate(model.logs)
    assert len(logs) == len(model.rows)
    assert all(np.allclose(logs[k], len(chunk) * np.log(0.25)) for chunk, k in model.rows.items() if "\u2581" not in chunk)


def test_languages_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = QUERIES["op5_language_id"](spark, sf_dir).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 < r.score <= 1 for r in rows)


def test_languages_of_messy_rows(spark, messy, no_docs):
    train = spark.createDataFrame([("the cat of the house", "en"), ("die Katze und das Haus", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language_id.fit_languages(train)
    assert model.languages == ["de", "en"]
    got = language_id.identify_languages(messy, model).collect()
    assert len(got) == len(MESSY)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"en"}
    nothing = language_id.fit_languages(no_docs)
    assert {r.lang_pred for r in language_id.identify_languages(messy, nothing).collect()} == {"und"}
    assert language_id.identify_languages(no_docs, model).count() == 0


# --- language model --------------------------------------------------------------------------------------------------


def test_elias_fano_finds_and_reads():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 10), (1000, 1 << 20), (20000, 1 << 50), (3000, 3000)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        asked = np.concatenate([values, rng.integers(0, universe, 300, dtype=np.uint64)])
        place = {int(v): i for i, v in enumerate(values)}
        sequence = EliasFano.build(values, universe)
        assert sequence.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
        assert (sequence.access(np.arange(len(values))) == values).all()


def test_trie_levels():
    pairs = np.array([5, 9, (2 << 40) | 1, (2 << 40) | 5], np.uint64)
    trie = BigramTrie(np.arange(3, dtype=np.uint32), pairs, np.log10([0.5, 0.25, 0.125, 0.5]), np.log10([0.1, 1, 0.2]))
    assert trie.successors(np.arange(3)).tolist() == [2, 0, 2]
    log, found = trie.log_probability(np.array([9, 6, (1 << 40) | 5, (2 << 40) | 5], np.uint64))
    assert found.tolist() == [True, False, False, True] and np.allclose(log[[0, 3]], np.log10([0.25, 0.5]), atol=2e-4)


def brute_scores(rows, train):
    """Scores of the model with no split context, in floating point."""
    tokens = {k: [*ngram_lm.words_of(t), None] for k, t in rows.items()}
    unigrams, pairs = Counter(), Counter()
    for k in train:
        unigrams.update(tokens[k])
        pairs.update(zip([0, *tokens[k]], tokens[k], strict=False))
    n, kinds = sum(unigrams.values()), len(unigrams)
    contexts, successors = Counter({0: len(train)}) + Counter(unigrams), Counter(a for a, _ in pairs)
    out = {}
    for k, words in tokens.items():
        score = 0.0
        for a, b in zip([0, *words], words, strict=False):
            if (a, b) in pairs:
                score += math.log10((pairs[a, b] - 0.75) / contexts[a])
                continue
            if contexts[a]:
                score += min(0.0, math.log10(0.75 * max(1, successors[a]) / contexts[a]))
            score += math.log10((unigrams[b] - 0.5) / n if unigrams[b] else 0.5 * kinds / n)
        base = sum(math.log10((unigrams[w] + 1) / (n + kinds + 1)) for w in words)
        out[k] = (len(words), sum(unigrams[w] > 0 for w in words), n, base, score)
    return out


@pytest.mark.parametrize("shard_tokens", [4_000_000, 20_000])
def test_lm_against_brute_force(spark, sf_dir, shard_tokens):
    docs = table(spark, sf_dir, "documents")
    train = crc_bucket("doc_id", 7) != 2
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = brute_scores(rows, [r.doc_id for r in docs.where(train).select("doc_id").collect()])
    got = ngram_lm.score_texts(docs, train, shard_tokens=shard_tokens).collect()
    assert len(got) == len(rows)
    gain = 0.0
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 0.51 / 4096 * n + 1e-6  # quantised to half a step
        gain += 0 if r.train else r.score - r.base_score
    assert gain > 0


@pytest.mark.parametrize("shard_tokens", [4_000_000, 10_000])
def test_lm_scores_do_not_depend_on_shards(spark, sf_dir, shard_tokens):
    docs = table(spark, sf_dir, "documents")
    train = crc_bucket("doc_id", 7) != 2
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = brute_scores(rows, [r.doc_id for r in docs.where(train).select("doc_id").collect()])
    for r in ngram_lm.score_texts(docs, train, shard_tokens=shard_tokens).collect():
        # Quantised to half a step.
        assert abs(r.score - want[r.doc_id][4]) <= 0.51 / 4096 * r.n_tokens + 1e-6


@pytest.mark.parametrize("shard_tokens", [4_000_000, 400, 60])
def test_lm_of_hot_pairs(spark, shard_tokens):
    """One pair holds a third of all tokens, one word and two pairs are frequent in held-out texts only."""
    rows = {k: "of the " * 12 + f"w{k} the of w{k % 5} " + "some words of text " * 3 for k in range(60)}
    rows |= {100 + k: "rare rare of rare the end of the " * 4 for k in range(20)} | {200: "", 201: None, 202: "of"}
    train = [k for k in rows if not 100 <= k < 120]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(7)
    want = brute_scores(rows, train)
    got = ngram_lm.score_texts(docs, ~F.col("doc_id").between(100, 119), shard_tokens=shard_tokens).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) <= 0.51 / 4096 * n + 1e-6


def test_lm_shards_hold_no_hot_pair(spark):
    """Positions of frequent contexts are spread over as many parts as they have quarters of a shard."""
    ids = np.sort(np.array([ngram_lm.token_id(w) for w in (b"of", b"the")] + [ngram_lm.START, ngram_lm.END], np.uint64))
    of = int(np.flatnonzero(ids == np.uint64(ngram_lm.token_id(b"of")))[0])
    parts = np.where(np.arange(4) == of, 40, 1)
    empty = np.zeros(0, np.int64)
    model = ngram_lm._Model(1000, 1, 10, 3, ids, np.full(4, 5), parts, empty, empty)
    successors = np.array([ngram_lm.token_id(str(k).encode()) for k in range(4000)], np.uint64) >> np.uint64(24)
    places = ngram_lm._shard_function(model)(np.full(4000, ids[of]), successors)
    assert 35 <= len(set(places.tolist())) <= 40 and np.bincount(places).max() < 300


def test_lm_of_messy_rows(spark, messy, no_docs):
    got = ngram_lm.score_texts(messy, F.col("doc_id") != 7).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in MESSY)
    empty = [r for r in got if r.doc_id in (2, 3, 4)]
    assert all(r.n_tokens == 1 and r.n_known == 1 and r.score <= 0 for r in empty)
    assert len({(r.doc_id, r.score) for r in got if r.doc_id == 1}) == 1
    untaught = ngram_lm.score_texts(messy, F.lit(False)).collect()
    assert len(untaught) == len(MESSY) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in untaught)
    assert ngram_lm.score_texts(no_docs, F.lit(True)).count() == 0


def test_a_worker_builds_the_identifier_once(spark):
    """Tasks that run one after the other in a Python worker share the automaton and the sums of chunks they have met."""
    import os

    pieces = ["\u2581", "a", "b"]
    shared = spark.sparkContext.broadcast(
        language_id._Shared((["x", "y"], pieces, np.full((4, 2), 0.25), np.log([0.5, 0.5])))
    )
    seen = spark.sparkContext.parallelize(range(60), 60).map(lambda _: (os.getpid(), id(shared.value.identifier))).collect()
    assert len(set(seen)) == len({pid for pid, _ in seen}) < 60
