"""Language-model scoring with bigram tries in Elias-Fano levels, one trie a shard.

Model: the unigram of a token w seen c times among N is (c - 0.5) / N, and what is taken away belongs to the
class of unknown tokens. The bigram after a context v seen c(v) times with T(v) different successors is
(c(v, w) - 0.75) / c(v) where it was seen, else 0.75 T(v) / c(v) times the unigram. (The sum over all tokens is
at most one.) Counts come from all training texts; nothing is pruned, so the model grows with the input.

No task ever holds the whole model. Texts are cut into blocks, and the positions of a block are sent to shards by
their context word, packed as bytes (about nine a token). A shard counts the training pairs among its positions,
builds its trie, and answers all its positions: so counting and scoring cost one shuffle. What is not found
backs off to the unigram of the next word, which lies elsewhere: these positions alone travel once more, to the
parts of the unigram table. Shards answer with sums for the documents of a block, which are added up at last.

The number of shards follows the number of tokens, so a shard has a bounded size. Tokens with more than a quarter
of a shard's positions in all texts ("the", the start of a text) are frequent. As contexts they are split: they go to
shards by context and part of the next word, with as many parts as they have quarters. A pair that alone has more
than a quarter ("of the", or what junk repeats) is hot. It joins two frequent tokens, so one pass over the texts counts
these pairs beforehand; its positions go to no shard but are scored in their block. Frequent tokens and hot pairs
are broadcast: as their positions add up to all positions, there are at most ``4`` of each a shard. (With 10**13 tokens
and words by Zipf's law these are about a million tokens, 24 MB.) The model is the same for them: shards report how many
successors they saw and which positions back off, and the back-off of the whole context is added with the sums of a
document. So scores do not depend on the shards.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import batches, prepare
from cartlens.llm.elias_fano import STEP, BigramTrie, quantise
from cartlens.llm.pieces import Memo
from cartlens.staging import stage

#: Tokens of a shard; its task holds about 50 bytes of each.
SHARD_TOKENS = 2_500_000
#: Parts of a shard: a token or pair with more positions than a part is frequent or hot.
PARTS = 4
DISCOUNT, UNIGRAM_DISCOUNT = 0.75, 0.5
_BLOCK = 256
_HELD = 300_000
_RELATIVE = np.uint64((1 << BigramTrie.BITS) - 1)


def token_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


#: No word holds a blank, so these never clash with a word.
START, END = token_id(b" start"), token_id(b" end")


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009-U+000D, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def _relative(ids: np.ndarray) -> np.ndarray:
    """The part of an id by which successors are known within a context."""
    return ids >> np.uint64(64 - BigramTrie.BITS)


# --- counting ---------------------------------------------------------------------------------------------------


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their number in training texts (n) and in all texts (m)."""
    taught, others = Counter(), Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for counts, share in ((taught, 1), (others, 0)):
            ids = np.fromiter(map(token_id, counts), np.uint64, len(counts)).view(np.int64)
            m = np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m * share), pa.array(m)], names=["id", "n", "m"])
            counts.clear()

    end = np.array([END], np.uint64).view(np.int64)
    for batch in batches(source):
        train = batch.column("train").to_pylist()
        for text, teaches in zip(batch.column("text").to_pylist(), train, strict=True):
            (taught if teaches else others).update(words_of(text))
        ends = [pa.array(end), pa.array([sum(train)], pa.int64()), pa.array([len(train)], pa.int64())]
        yield pa.RecordBatch.from_arrays(ends, names=["id", "n", "m"])
        if len(taught) + len(others) > _HELD:
            yield from flush()
    yield from flush()


class _Model(NamedTuple):
    """What every task knows: sizes, the frequent tokens (ids ascending) and the hot pairs (keys ascending)."""

    shards: int
    spread: int  # parts of the unigram table
    total: int
    distinct: int
    ids: np.ndarray
    counts: np.ndarray  # in training texts
    parts: np.ndarray  # over which a context is split
    hot: np.ndarray  # context place * number of frequent tokens + successor place
    hot_counts: np.ndarray  # in training texts

    def unknown(self) -> float:
        return math.log10(UNIGRAM_DISCOUNT * self.distinct / self.total) if self.total else 0.0

    def unigram_logs(self) -> np.ndarray:
        """Of the frequent tokens; those without a count are unknown."""
        seen = self.counts > 0
        logs = np.full(len(self.ids), self.unknown())
        logs[seen] = np.log10((self.counts[seen] - UNIGRAM_DISCOUNT) / max(1, self.total))
        return logs


def _places(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id among sorted ones, -1 where it is absent."""
    if not len(sorted_ids):
        return np.full(len(ids), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def _successor_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens as successors: their relative ids, ascending, and their places. The start is none; of two with
    one relative id the first stands for both."""
    places = np.flatnonzero(ids != np.uint64(START))
    relative, first = np.unique(_relative(ids[places]), return_index=True)
    return relative, places[first]


def _count_pairs(shared):
    """Pairs of frequent tokens with their number in training texts (n) and in all texts (m)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        relative, places = _successor_order(ids)
        # Searched word by word, for which plain arrays are faster.
        known, place_of, tokens = array("Q", relative.tolist()), array("q", places.tolist()), array("Q", ids.tolist())

        def code(word: bytes | int) -> int:
            """Twice the place as a successor, and one if it is the place as a context too; -1: not frequent."""
            token = token_id(word) if isinstance(word, bytes) else word
            at = bisect_left(known, token >> 64 - BigramTrie.BITS)
            if at == len(known) or known[at] != token >> 64 - BigramTrie.BITS:
                return -1
            return 2 * place_of[at] + (tokens[place_of[at]] == token)

        memo = Memo(code)
        start, end = int(_places(ids, np.array([START], np.uint64))[0]), code(END)
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(counts, np.int64, len(counts))
            m = np.fromiter(counts.values(), np.int64, len(counts))
            columns = [pa.array(keys >> 1), pa.array(m * (keys & 1)), pa.array(m)]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["pair", "n", "m"])

        for batch in batches(source):
            keys = []
            for text, teaches in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                words = words_of(text)
                codes = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                contexts = np.r_[start, np.where(codes & 1, codes >> 1, -1)]
                contexts[1:][codes < 0] = -1
                successors = np.r_[codes >> 1, end >> 1]
                both = (contexts >= 0) & (successors >= 0)
                keys.append((contexts[both] * len(ids) + successors[both]) * 2 + int(teaches))
            found, times = np.unique(np.concatenate(keys), return_counts=True)
            counts.update(dict(zip(found.tolist(), times.tolist(), strict=True)))
            if len(counts) > _HELD:
                yield flush()
        yield flush()

    return run


# --- blocks: positions by shard ---------------------------------------------------------------------------------


def _pack(shard_of, positions: tuple[np.ndarray, ...], block: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (shard, block, bytes): distinct contexts and their number of positions, then successors and documents."""
    context, successor, document = positions
    shard = shard_of(context, successor)
    # One key for shard and context; contexts that agree in 40 bits may alternate, which only repeats their heads.
    order = np.argsort(shard.astype(np.uint64) << np.uint64(40) | context >> np.uint64(24))
    context, successor, document, shard = context[order], successor[order], document[order], shard[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = context[lo:hi]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[first, len(part)]).astype(np.uint32)
        low, high = _split(successor[lo:hi])
        head = np.array([len(first), hi - lo], np.uint32)
        yield int(shard[lo]), block, b"".join(
            a.tobytes() for a in (head, part[first], sizes, low, high, document[lo:hi].astype(np.uint8))
        )


def _split(successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (successor & np.uint64(0xFFFFFFFF)).astype(np.uint32), (successor >> np.uint64(32)).astype(np.uint8)


def _join(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


class _Packed:
    """One packed row: the contexts with their sizes, then successor and document of each position."""

    def __init__(self, block: int, data: pa.Buffer) -> None:
        self.block = block
        self.trained = np.unpackbits(np.frombuffer(data, np.uint8, 32)).view(bool)
        kinds, self.n = (int(v) for v in np.frombuffer(data, np.uint32, 2, 32))
        self.contexts = np.frombuffer(data, np.uint64, kinds, 40)
        at = 40 + 8 * kinds
        self.sizes = np.frombuffer(data, np.uint32, kinds, at)
        at += 4 * kinds
        self.low = np.frombuffer(data, np.uint32, self.n, at)
        self.high = np.frombuffer(data, np.uint8, self.n, at + 4 * self.n)
        self.document = np.frombuffer(data, np.uint8, self.n, at + 5 * self.n)

    def successors(self) -> np.ndarray:
        return _join(self.low, self.high)


def _shard_function(model: _Model):
    def shard_of(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        place = _places(model.ids, context)
        split = place >= 0
        part = np.zeros(len(context), np.uint64)
        part[split] = successor[split] % model.parts[place[split]].astype(np.uint64) + np.uint64(1)
        # Mixed, so that the parts of a context do not fall on neighbouring shards.
        key = context + part * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((key ^ (key >> np.uint64(31))) % np.uint64(model.shards)).astype(np.int64)

    return shard_of


#: kind 0: positions; 1: the documents of a block; 2: sums by document; 3: questions to the unigram table;
#: 4: successors seen of split contexts; 5: positions of a block that back off from them.
ROWS = "kind int, shard int, block long, data binary, ids array<long>, train array<boolean>, n array<long>"
_EMPTY: list = [None, None, None]


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    names = ["kind", "shard", "block", "data", "ids", "train", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _hot_scores(model: _Model):
    """Takes the hot pairs out of the positions of a block; the rest, and the rows that answer for them."""
    relative, places = _successor_order(model.ids)
    unigrams = model.unigram_logs()

    def run(positions: tuple[np.ndarray, ...], block: int) -> tuple[tuple[np.ndarray, ...], list[tuple]]:
        context, successor, document = positions
        first = _places(model.ids, context)
        second = _places(relative, successor)
        pair = np.where((first >= 0) & (second >= 0), first * len(model.ids) + places[second], -1)
        at = _places(model.hot, pair)
        here = at >= 0
        if not here.any():
            return positions, []
        first, second, at, where = first[here], places[second[here]], at[here], document[here]
        times, whole = model.hot_counts[at], model.counts[first]
        seen = times > 0
        log = unigrams[second]
        log[seen] = quantise(np.log10((times[seen] - DISCOUNT) / whole[seen])) / -STEP
        is_word = model.ids[first] != np.uint64(START)
        sums = _sums(where, (whole > 0) & is_word, np.log10(whole + 1.0) * is_word, log)
        # They pass through a shard like the documents of the block.
        shard = block % model.shards
        rows = [(2, shard, block, sums, *_EMPTY)]
        if not seen.all():
            rows.append((5, shard, block, _backing_off(first[~seen], where[~seen]), *_EMPTY))
        return tuple(p[~here] for p in positions), rows

    return run


def _backing_off(place: np.ndarray, document: np.ndarray) -> bytes:
    """Split contexts by place and document, with the number of positions that back off from them."""
    key, times = np.unique(place.astype(np.int64) << 8 | document, return_counts=True)
    return np.stack([key, times]).astype(np.int64).tobytes()


def _blocks(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        shard_of, score_hot = _shard_function(model), _hot_scores(model)
        memo = Memo(token_id)
        block = TaskContext.get().partitionId() << 32
        for batch in batches(source):
            texts = batch.column("text").to_pylist()
            train = batch.column("train").to_pylist()
            contexts, successors, documents, sizes = [], [], [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
                contexts.append(np.r_[np.uint64(START), ids])
                successors.append(np.r_[ids, np.uint64(END)])
                documents.append(np.full(len(ids) + 1, k, np.uint8))
                sizes.append(len(ids) + 1)
            mask = np.array(train, bool)
            rows = []
            positions = (np.concatenate(contexts), _relative(np.concatenate(successors)), np.concatenate(documents))
            if len(model.hot):
                positions, answers = score_hot(positions, block)
                rows += answers
            for shard, number, data in _pack(shard_of, positions, block):
                rows.append((0, shard, number, np.packbits(mask).tobytes().ljust(32, b"\0") + data, *_EMPTY))
            rows.append((1, block % model.shards, block, None, batch.column("id").to_pylist(), train, sizes))
            yield _row_batch(rows)
            block += 1

    return run


# --- shards: count, build, answer -------------------------------------------------------------------------------


def _sums(documents: np.ndarray, *values: np.ndarray) -> bytes:
    """Sums by document: their numbers, then the sums of each value."""
    present = np.flatnonzero(np.bincount(documents, minlength=256))
    parts = [present.astype(np.uint8)]
    parts += [np.bincount(documents, v, 256)[present] for v in values]
    return np.uint32(len(present)).tobytes() + b"".join(p.tobytes() for p in parts)


def _backoff(successors: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log10 of what a context seen ``whole`` times leaves to the unigram; 0 for one never seen."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, np.minimum(np.log10(DISCOUNT * np.maximum(successors, 1) / whole), 0.0), 0.0)


def _answer(shared):
    """Counts, builds and answers for one shard. Beside the packed rows it holds one sorted array of the training
    pairs; everything else is done row by row."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        model = shared.value
        kind = table.column("kind").to_numpy()
        out = [tuple(r.values()) for r in table.filter(pa.array(kind != 0)).to_pylist()]
        sent = table.filter(pa.array(kind == 0))
        rows = [_Packed(b.as_py(), d.as_buffer()) for b, d in zip(sent.column("block"), sent.column("data"), strict=True)]
        if not rows:
            return pa.Table.from_batches([_row_batch(out)]) if out else table.slice(0, 0)

        contexts = np.unique(np.concatenate([r.contexts for r in rows]))
        at = _places(model.ids, contexts)
        split = at >= 0

        def grouped(row: _Packed) -> tuple[np.ndarray, np.ndarray]:
            """Context number and (context number, successor) pair of every position."""
            number = np.repeat(np.searchsorted(contexts, row.contexts), row.sizes)
            return number, (number.astype(np.uint64) << np.uint64(BigramTrie.BITS)) | row.successors()

        taught = [r.trained[r.document] for r in rows]
        pairs = np.empty(sum(int(t.sum()) for t in taught), np.uint64)
        at_pair = 0
        for row, mask in zip(rows, taught, strict=True):
            mine = grouped(row)[1][mask]
            pairs[at_pair : at_pair + len(mine)] = mine
            at_pair += len(mine)
        del taught
        pairs.sort()
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        count = np.diff(np.r_[starts, len(pairs)]).astype(np.uint32)
        seen = pairs[starts]
        del pairs, starts
        of_pair = (seen >> np.uint64(BigramTrie.BITS)).astype(np.uint32)
        whole = np.bincount(of_pair, count, len(contexts))
        whole[split] = model.counts[at[split]]
        successors = np.bincount(of_pair, minlength=len(contexts))
        back = np.where(split, 0.0, _backoff(successors, whole))
        parted = split & (successors > 0)
        if parted.any():
            out.append((4, 0, None, None, at[parted].tolist(), None, successors[parted].tolist()))
        numbers = np.arange(len(contexts), dtype=np.uint32)
        trie = BigramTrie(numbers, seen, np.log10((count - DISCOUNT) / whole[of_pair]), back)
        del seen, count, of_pair

        relative, places = _successor_order(model.ids)
        unigrams = model.unigram_logs()
        is_word = contexts != np.uint64(START)
        known, base = (whole > 0) & is_word, np.log10(whole + 1.0) * is_word
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for row in rows:
            group, mine = grouped(row)
            log, found = trie.log_probability(mine)
            log = np.where(found, log, trie.backoff(group))
            wanted = np.flatnonzero(~found)
            left = wanted[split[group[wanted]]]
            if len(left):
                out.append((5, 0, row.block, _backing_off(at[group[left]], row.document[left]), *_EMPTY))
            successor = row.successors()[wanted]
            place = _places(relative, successor)
            common = place >= 0
            log[wanted[common]] += unigrams[places[place[common]]]
            wanted, successor = wanted[~common], successor[~common]
            out.append((2, 0, row.block, _sums(row.document, known[group], base[group], log), *_EMPTY))
            asked.append((successor, row.document[wanted]))
        out += [(3, part, None, data, *_EMPTY) for part, data in _questions(rows, asked, model.spread)]
        return pa.Table.from_batches([_row_batch(out)])

    return run


def _questions(rows: list[_Packed], asked: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, bytes) for the unigram table's parts: blocks with their number of positions, successors, documents."""
    word = np.concatenate([w for w, _ in asked])
    document = np.concatenate([d for _, d in asked])
    block = np.repeat(np.array([r.block for r in rows]), [len(w) for w, _ in asked])
    part = (word % np.uint64(parts)).astype(np.int64)
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        at = at[np.argsort(block[at], kind="stable")]
        mine = block[at]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        low, high = _split(word[at])
        head = np.array([len(first), len(at)], np.int64)
        sizes = np.diff(np.r_[first, len(mine)])
        yield int(k), b"".join(a.tobytes() for a in (head, mine[first], sizes, low, high, document[at]))


def _unigrams(shared):
    """Log probabilities for the positions that backed off; tokens without a count are unknown."""

    def run(key: tuple[pa.Scalar, ...], questions: pa.Table, table: pa.Table) -> pa.Table:
        total, unknown = shared.value.total, shared.value.unknown()
        words = table.column("word").to_numpy().astype(np.uint64)
        order = np.argsort(words)
        words, n = words[order], table.column("n").to_numpy()[order]
        out: list[tuple] = []
        sums: dict[int, np.ndarray] = {}

        def flush() -> None:
            nothing, every = np.zeros(256), np.arange(256)
            out.extend((2, 0, block, _sums(every, nothing, nothing, log), *_EMPTY) for block, log in sums.items())
            sums.clear()

        for value in questions.column("data"):
            data = value.as_buffer()
            blocks, size = (int(v) for v in np.frombuffer(data, np.int64, 2))
            block, sizes = np.frombuffer(data, np.int64, 2 * blocks, 16).reshape(2, blocks)
            at = 16 + 16 * blocks
            asked = _join(np.frombuffer(data, np.uint32, size, at), np.frombuffer(data, np.uint8, size, at + 4 * size))
            document = np.frombuffer(data, np.uint8, size, at + 5 * size)
            log = np.full(size, unknown)
            if len(words):
                place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                hit = words[place] == asked
                log[hit] = np.log10((n[place[hit]] - UNIGRAM_DISCOUNT) / total)
            last = np.cumsum(sizes)
            for number, lo, hi in zip(block.tolist(), (last - sizes).tolist(), last.tolist(), strict=True):
                one = np.bincount(document[lo:hi], log[lo:hi], 256)
                sums[number] = sums[number] + one if number in sums else one
            if len(sums) > 20_000:
                flush()
        flush()
        return pa.Table.from_batches([_row_batch(out)]) if out else questions.slice(0, 0).drop_columns(["spread"])

    return run


def _add_up(backoffs):
    """Documents of one block with the sums of all shards; ``backoffs``: of the split contexts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sums = np.zeros((3, 256))
        ids, train, n = [], [], []
        for row in table.to_pylist():
            if row["kind"] == 1:
                ids, train, n = row["ids"], row["train"], row["n"]
                continue
            data = row["data"]
            if row["kind"] == 5:
                place, times = np.frombuffer(data, np.int64).reshape(2, -1)
                sums[2] += np.bincount(place & 255, times * backoffs.value[place >> 8], 256)
                continue
            size = int(np.frombuffer(data, np.uint32, 1)[0])
            present = np.frombuffer(data, np.uint8, size, 4)
            sums[:, present] += np.frombuffer(data[4 + size :], np.float64).reshape(3, size)
        k = len(ids)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "train": pa.array(train, pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()),
                "known_words": pa.array(sums[0, :k].round().astype(np.int64)),
                "base_sum": pa.array(sums[1, :k]),
                "score": pa.array(sums[2, :k]),
            }
        )

    return run


def score_texts(
    docs: DataFrame, train: Column, *, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score (log10 of the model) of every row.

    The model learns from the rows where ``train`` is true (null: false). A null or empty text is one end token.
    Ids may be null or repeated: every row is scored. Without training rows every token is unknown: the base is
    log10(1), and so is the score. Other columns are not read. ``doc_id`` is a whole number.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    counted = rows.select("text", "train").mapInArrow(_count, "id long, n long, m long")
    table = stage(counted.groupBy("id").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "unigrams")
    # The relative id of a token, as in _relative.
    word = F.shiftrightunsigned("id", 64 - BigramTrie.BITS)
    total, tokens, distinct = (
        int(v or 0) for v in table.agg(F.sum("n"), F.sum("m"), F.count_if(F.col("n") > 0)).first()
    )
    shards = max(1, -(-tokens // shard_tokens))
    part = max(1, shard_tokens // PARTS)
    end = np.uint64(END).astype(np.int64).item()
    frequent = {r["id"] & (1 << 64) - 1: (r["n"], r["m"]) for r in table.where((F.col("m") > part) | (F.col("id") == end)).collect()}
    texts = frequent[END][0] if frequent else 0
    if frequent:
        frequent[START] = frequent[END]
    ids = np.array(sorted(frequent), np.uint64)
    counts, everywhere = (np.array([frequent[int(i)][k] for i in ids], np.int64) for k in (0, 1))
    hot = np.zeros((2, 0), np.int64)
    if tokens > part:
        paired = rows.select("text", "train").mapInArrow(_count_pairs(spark.sparkContext.broadcast(ids)), "pair long, n long, m long")
        sums = paired.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("m") > part)
        hot = np.array(sorted((r["pair"], r["n"]) for r in sums.collect()), np.int64).reshape(-1, 2).T
    # Parts of the unigram table: their words and questions are a task's load.
    parts = max(1, -(-max(distinct, shards * shard_tokens // 8) // shard_tokens))
    model = _Model(shards, parts, total, distinct, ids, counts, -(-everywhere // part), hot[0], hot[1])
    shared = spark.sparkContext.broadcast(model)

    sent = rows.mapInArrow(_blocks(shared), ROWS)
    answered = stage(sent.groupBy("shard").applyInArrow(_answer(shared), ROWS), "answers")
    # One number a split context; hot pairs are successors that no shard has seen.
    successors = np.bincount(hot[0][hot[1] > 0] // max(1, len(ids)), minlength=len(ids))
    reported = answered.where("kind = 4").select(F.inline(F.arrays_zip("ids", "n")))
    for place, n in reported.groupBy("ids").agg(F.sum("n")).collect():
        successors[place] += n
    backoffs = spark.sparkContext.broadcast(quantise(_backoff(successors, counts)) / -STEP)
    spread = F.pmod(F.col("word"), F.lit(parts)).cast("int")
    unigrams = table.where("n > 0").select(word.alias("word"), "n").withColumn("spread", spread)
    questions = answered.where("kind = 3").withColumn("spread", F.col("shard"))
    backed = questions.groupBy("spread").cogroup(unigrams.groupBy("spread")).applyInArrow(_unigrams(shared), ROWS)
    sums = answered.where("kind < 3 or kind = 5").unionByName(backed)
    schema = "doc_id long, train boolean, n_tokens long, known_words long, base_sum double, score double"
    scored = sums.groupBy("block").applyInArrow(_add_up(backoffs), schema)
    return scored.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known_words") + (1 if texts else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_sum") + math.log10(texts + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        F.when(F.lit(total > 0), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
    )
