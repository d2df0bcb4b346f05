"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The trie holds the vocabulary as two integer arrays: from state s, character code c leads to base[s] + c if
check of that cell is s. The driver builds it once from the model file and broadcasts the arrays, whose size is
bounded by the vocabulary. Every task walks the trie from each position, keeps the best score of each end, and
follows the links back. Decoding joins pieces, turns runs of byte pieces into characters (U+FFFD where they are
no UTF-8) and marks into blanks, and drops the one blank that encoding put first.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.pieces import MARK, MODEL_PATH, Memo, Vocabulary, chunk_pattern, marked, read_vocabulary


def build_double_array(words: dict[str, int]) -> tuple[dict[str, int], array, array, array]:
    """codes, base, check, value for the words; value is a word's number or -1."""
    tree: dict = {}
    for word, number in words.items():
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = number
    frequency: dict[str, int] = {}
    for word in words:
        for char in word:
            frequency[char] = frequency.get(char, 0) + 1
    codes = {c: k for k, c in enumerate(sorted(frequency, key=lambda c: (-frequency[c], c)), 1)}
    base, check, value = array("i", [0]), array("i", [0]), array("i", [-1])
    taken = bytearray([1])
    single = many = 1  # where states with one child, and with more, start to look for free cells
    queue = [(0, tree)]
    for state, node in queue:
        value[state] = node.get("", -1)
        children = sorted(((codes[c], child) for c, child in node.items() if c), key=lambda pair: pair[0])
        if not children:
            continue
        least, most = children[0][0], children[-1][0]
        at, tries = max(1, (single if len(children) == 1 else many) - least), 0
        while True:
            if at + most >= len(taken):
                grow = at + most + 1024 - len(taken)
                taken.extend(bytes(grow))
                base.extend([0] * grow)
                check.extend([-1] * grow)
                value.extend([-1] * grow)
            if not any(taken[at + code] for code, _ in children):
                break
            at, tries = at + 1, tries + 1
        if len(children) == 1:
            single = max(single, at + least)
        elif tries > 100:  # fitting gets hard here
            many = at + least
        base[state] = at
        for code, child in children:
            taken[at + code] = 1
            check[at + code] = state
            queue.append((at + code, child))
    return codes, base, check, value


#: Chunks of up to this length are encoded together, so many at a time.
_SHORT, _GROUP = 48, 8192


class Codec:
    """Encoder and decoder over plain tables."""

    def __init__(self, trie, pieces: list[str], scores: dict[int, int], byte_ids: list[int], unknown_id: int, unknown_score: int) -> None:
        codes, base, check, value = trie
        self.codes, self.base, self.check, self.value = codes, list(base), list(check), list(value)
        self.scores, self.byte_ids = scores, byte_ids
        self.unknown_id, self.unknown_score = unknown_id, unknown_score
        self.pattern = chunk_pattern([pieces[i] for i in scores])
        # Byte pieces as escaped bytes, so that joining and decoding are one pass each.
        self.texts = list(pieces)
        for byte, i in enumerate(byte_ids):
            self.texts[i] = chr(byte) if byte < 128 else chr(0xDC00 + byte)
        self.memo = Memo(self.encode_chunk, 300_000)
        self.base_of, self.check_of, self.value_of = (np.array(a, np.int64) for a in (base, check, value))
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[[ord(c) for c in codes]] = list(codes.values())
        self.score_of = np.zeros(len(pieces), np.int64)
        self.score_of[list(scores)] = list(scores.values())

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Best piece ids of a chunk; ties go to the earliest start, as in the public tokenizer."""
        n = len(chunk)
        codes, base, check, value, scores = self.codes, self.base, self.check, self.value, self.scores
        path = [codes.get(c, 0) for c in chunk]
        size = len(check)
        best: list = [0] + [None] * n
        back = [(0, 0)] * (n + 1)
        for start in range(n):
            here, state, single = best[start], 0, False
            for end in range(start, n):
                code = path[end]
                if not code:
                    break
                after = base[state] + code
                if after >= size or check[after] != state or not base[state]:
                    break
                state = after
                piece = value[state]
                if piece >= 0:
                    total = here + scores[piece]
                    if best[end + 1] is None or total > best[end + 1]:
                        best[end + 1], back[end + 1] = total, (start, piece)
                    single = single or end == start
            if not single:
                total = here + self.unknown_score
                if best[start + 1] is None or total > best[start + 1]:
                    best[start + 1], back[start + 1] = total, (start, -1)
        ids, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(chunk[start].encode()))
            else:
                ids.append(self.unknown_id)
            at = start
        return tuple(reversed(ids))

    def _arcs(self, chunks: Sequence[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end (positions in the joined chunks) and piece (-1: unknown) of all arcs; for one end by start."""
        code = self.code_of[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        limit = np.repeat(np.cumsum(sizes), sizes)
        start = np.arange(len(code))
        state, single, found = np.zeros(len(code), np.int64), np.zeros(len(code), bool), []
        depth = 0
        while len(start):
            at = start + depth
            inside = at < limit[start]
            start, state, at = start[inside], state[inside], at[inside]
            after = self.base_of[state] + code[at]
            fits = (code[at] > 0) & (self.base_of[state] > 0) & (after < len(self.check_of))
            fits[fits] = self.check_of[after[fits]] == state[fits]
            start, state = start[fits], after[fits]
            piece = self.value_of[state]
            ends = piece >= 0
            found.append((start[ends], start[ends] + depth + 1, piece[ends]))
            if not depth:
                single[start[ends]] = True
            depth += 1
        alone = np.flatnonzero(~single)
        found = [*reversed(found), (alone, alone + 1, np.full(len(alone), -1))]
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    def encode_many(self, chunks: Sequence[str]) -> list[tuple[int, ...]]:
        """``encode_chunk`` of many chunks at once: the same search, step by step over the ends of all chunks."""
        sizes = np.array([len(c) for c in chunks])
        start, end, piece = self._arcs(chunks, sizes)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(chunks)), sizes)[start]
        # Nodes: a chunk has one more than characters.
        tail, head = start + owner, end + owner
        step = end - first[owner]
        order = np.argsort(head, kind="stable")
        order = order[np.argsort(step[order].astype(np.uint16), kind="stable")]
        tail, head, piece, step = tail[order], head[order], piece[order], step[order]
        gain = np.where(piece >= 0, self.score_of[piece], self.unknown_score)
        best = np.zeros(int(sizes.sum()) + len(chunks), np.int64)
        back = np.zeros(len(best), np.int64)
        cuts = np.searchsorted(step, np.arange(1, int(sizes.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            total = best[tail[lo:hi]] + gain[lo:hi]
            group = head[lo:hi]
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            most = np.maximum.reduceat(total, heads)
            best[group[heads]] = most
            winners = np.flatnonzero(total == np.repeat(most, np.diff(np.r_[heads, hi - lo])))
            winners = winners[np.r_[True, group[winners][1:] != group[winners][:-1]]]  # the first of equals
            back[group[winners]] = lo + winners
        root = first + np.arange(len(chunks))
        chunk, node = np.arange(len(chunks)), root + sizes
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(chunk):
            arc = back[node]
            taken.append((chunk, piece[arc]))
            node = tail[arc]
            going = node != root[chunk]
            chunk, node = chunk[going], node[going]
        chunk = np.concatenate([c for c, _ in reversed(taken)])
        ids = np.concatenate([i for _, i in reversed(taken)])
        order = np.argsort(chunk, kind="stable")
        counts = np.bincount(chunk, minlength=len(chunks))
        ids, stops = ids[order].tolist(), np.cumsum(counts).tolist()
        out = [tuple(ids[stop - n : stop]) for stop, n in zip(stops, counts.tolist(), strict=True)]
        return [self.encode_chunk(c) if -1 in row else row for c, row in zip(chunks, out, strict=True)]

    def learn(self, chunks: Sequence[str]) -> None:
        """Encode chunks that are not held yet; long ones one by one."""
        if len(self.memo) + len(chunks) > self.memo.limit:
            self.memo.clear()
        short = sorted((c for c in chunks if len(c) <= _SHORT), key=len)
        for at in range(0, len(short), _GROUP):
            group = short[at : at + _GROUP]
            self.memo.update(zip(group, self.encode_many(group), strict=True))

    def encode_batch(self, texts: Sequence[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(marked(t)) if t else [] for t in texts]
        self.learn(list(set(chain.from_iterable(cut)).difference(self.memo)))
        return [list(chain.from_iterable(map(self.memo.__getitem__, chunks))) for chunks in cut]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(marked(text))))) if text else []

    def decode(self, ids: Sequence[int]) -> str:
        joined = "".join(map(self.texts.__getitem__, ids))
        text = joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def codec_tables(vocabulary: Vocabulary) -> tuple:
    """Plain values that make a ``Codec``: what is broadcast."""
    trie = build_double_array(vocabulary.matching())
    return (trie, vocabulary.pieces, vocabulary.scores, vocabulary.byte_ids, vocabulary.unknown_id, vocabulary.unknown_score)


def encode_texts(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    model_path: str = MODEL_PATH,
    verify: bool = False,
) -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of every row; with ``verify`` also ``lossless``: decoding the ids
    gives the text back (a text that holds the mark itself does not).

    Null and empty texts have no ids and are lossless. Nothing is shuffled; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(codec_tables(read_vocabulary(model_path)))
    fields = [*[docs.select(k).schema[0] for k in keep], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if verify:
        fields.append(T.StructField("lossless", T.BooleanType()))
    names = [f.name for f in fields]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches(source):
            texts = batch.column(text).to_pylist()
            rows = codec.encode_batch(texts)
            columns = [*[batch.column(k) for k in keep], pa.array(rows, pa.list_(pa.int32()))]
            if verify:
                columns.append(pa.array([codec.decode(ids) == (t or "") for ids, t in zip(rows, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType(fields))


def decode_ids(
    rows: DataFrame, *, ids: str = "ids", keep: Sequence[str] = ("doc_id",), model_path: str = MODEL_PATH
) -> DataFrame:
    """``keep`` columns and ``text`` decoded from ``ids``; null ids give null, no ids an empty text."""
    spark = prepare(rows.sparkSession)
    shared = spark.sparkContext.broadcast(codec_tables(read_vocabulary(model_path)))
    schema = T.StructType([*[rows.select(k).schema[0] for k in keep], T.StructField("text", T.StringType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches(source):
            texts = [None if v is None else codec.decode(v) for v in batch.column(ids).to_pylist()]
            columns = [*[batch.column(k) for k in keep], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text"])

    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
