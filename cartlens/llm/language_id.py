"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a text is the sum
over all its segmentations into pieces, which a forward pass over the lattice of matching pieces computes for all
languages at once. Texts are lower-cased, marked and cut into chunks that no piece crosses, so the sum over the whole
text is a product over chunks, and a chunk is computed once a Python worker, up to a bound. Chunks may have any length: those of more than
``SHORT`` characters are summed as logarithms.

Training counts every chunk of every labelled text, weighs the pieces of a chunk by their posterior under the
vocabulary's own scores (forward and backward pass), and sums these expected counts by language in Spark. The
model that reaches the driver has a number for each language and piece, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.pieces import MODEL_PATH, UNIT, chunk_pattern, marked, read_vocabulary
from cartlens.llm.sentencepiece_codec import build_double_array

#: Products over longer chunks could fall below the smallest double.
SHORT = 32
#: Log probability of a character no piece matches.
UNKNOWN = -16.0
#: Pseudo-counts spread over the vocabulary's own distribution.
SMOOTHING = 2000.0
_GROUP = 4096
_CELLS = _GROUP * (SHORT + 1)
#: No text has a lone surrogate, so no chunk holds the separator.
_SEPARATOR = "\ud800"
_HELD = 400_000
UNDETERMINED = "und"


class Lattice:
    """All segmentations of chunks; ``pieces`` in id order, the unknown character is id len(pieces)."""

    def __init__(self, pieces: Sequence[str]) -> None:
        codes, base, check, value = build_double_array({piece: number for number, piece in enumerate(pieces)})
        # One more point for characters of no piece, and cells behind the last state for all codes.
        self.code_of = np.zeros(max(map(ord, codes), default=0) + 2, np.int32)
        self.code_of[[ord(c) for c in codes]] = list(codes.values())
        self.base, self.value = np.array(base, np.int32), np.array(value, np.int32)
        self.check = np.append(np.array(check, np.int32), np.full(len(codes) + 1, -1, np.int32))
        self.check[0] = -1  # nothing leads to the root
        self.unknown = len(pieces)
        self.pattern = chunk_pattern(pieces)

    def chunks(self, text: str | None) -> list[str]:
        """The whole text, lower-cased and marked, in parts that no piece crosses."""
        return self.pattern.findall(marked(text.lower())) if text else []

    def arcs(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """chunk, start, end and piece of every arc, longer arcs first.

        The trie is walked from all characters of all chunks at once; a separator, part of no piece, ends each chunk.
        """
        sizes = np.array([len(c) for c in chunks])
        first = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer((_SEPARATOR.join(chunks) + _SEPARATOR).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.code_of[np.minimum(points, len(self.code_of) - 1)]
        code[first + sizes] = 0
        owner = np.repeat(np.arange(len(chunks)), sizes + 1)
        at = np.arange(len(code))
        state, single, found, depth = np.zeros(len(code), np.int32), np.zeros(len(code), bool), [], 0
        while len(at):
            after = self.base[state] + code[at + depth]
            fits = np.flatnonzero(self.check[after] == state)
            at, state = at[fits], after[fits]
            depth += 1
            number = self.value[state]
            ends = np.flatnonzero(number >= 0)
            found.append((at[ends], np.full(len(ends), depth), number[ends]))
            if depth == 1:
                single[at[ends]] = True
        single[first + sizes] = True  # separators
        alone = np.flatnonzero(~single)
        found = [*reversed(found), (alone, np.ones(len(alone), np.int64), np.full(len(alone), self.unknown))]
        begin, length, number = (np.concatenate(column) for column in zip(*found, strict=True))
        which = owner[begin]
        start = begin - first[which]
        return which, start, start + length, number


def _groups(chunks: Sequence[str]) -> Iterator[list[int]]:
    """Numbers of chunks by length, in groups whose tables are bounded (one longer chunk stays whole)."""
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    order = np.argsort(sizes, kind="stable")
    sizes, low = sizes[order], 0
    short = int(np.searchsorted(sizes, SHORT, "right"))
    while low < len(order):
        ahead = sizes[low : min(low + _GROUP, short if low < short else len(order))]
        high = low + max(1, int(np.searchsorted(np.arange(1, len(ahead) + 1) * (ahead + 1), _CELLS, "right")))
        yield order[low:high].tolist()
        low = high


def _by_step(which, here) -> np.ndarray:
    order = np.argsort(which.astype(np.uint16), kind="stable")
    small = here[order].astype(np.uint8 if here.max(initial=0) < 256 else np.int64)
    return order[np.argsort(small, kind="stable")]


def _log_sweep(which, here, there, gains, table, steps) -> None:
    """As ``_sweep``, of logarithms: nothing underflows, whatever the length."""
    order = _by_step(which, here)
    which, here, there, gains = which[order], here[order], there[order], gains[order]
    cuts = np.searchsorted(here, np.arange(table.shape[1] + 1))
    for step in steps:
        lo, hi = cuts[step], cuts[step + 1]
        if lo == hi:
            continue
        chunk = which[lo:hi]
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        terms = table[chunk, there[lo:hi]] + gains[lo:hi]
        top = np.maximum.reduceat(terms, first, axis=0)
        shifted = np.exp(terms - np.repeat(top, np.diff(np.r_[first, len(chunk)]), axis=0))
        table[chunk[first], step] = top + np.log(np.add.reduceat(shifted, first, axis=0))


def _sweep(which, here, there, gains, number, table, steps) -> None:
    """table[chunk, here] += table[chunk, there] * gains[number], for ``here`` in ``steps`` order."""
    order = _by_step(which, here)
    which, here, there, number = (column.take(order) for column in (which, here, there, number))
    cuts = np.searchsorted(here, np.arange(table.shape[1] + 1))
    source, cells = which * table.shape[1] + there, table.reshape(-1, table.shape[2])
    for step in steps:
        lo, hi = cuts[step], cuts[step + 1]
        if lo == hi:
            continue
        chunk = which[lo:hi]
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        terms = cells.take(source[lo:hi], axis=0)
        terms *= gains.take(number[lo:hi], axis=0)
        table[chunk[first], step] += np.add.reduceat(terms, first, axis=0)


def forward(arcs, sizes: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (chunk, position, language) and the totals of the chunks."""
    which, start, end, number = arcs
    alpha = np.zeros((len(sizes), int(sizes.max()) + 1, probability.shape[1]))
    alpha[:, 0] = 1.0
    _sweep(which, end, start, probability, number, alpha, range(1, alpha.shape[1]))
    return alpha, alpha[np.arange(len(sizes)), sizes]


def log_forward(arcs, sizes: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of what ``forward`` returns, for chunks of any length."""
    which, start, end, number = arcs
    alpha = np.zeros((len(sizes), int(sizes.max()) + 1, probability.shape[1]))
    _log_sweep(which, end, start, np.log(probability)[number], alpha, range(1, alpha.shape[1]))
    return alpha, alpha[np.arange(len(sizes)), sizes]


def expected_counts(lattice: Lattice, chunks: Sequence[str], weights: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Expected pieces (language, piece) of chunks that occur ``weights`` (chunk, language) times."""
    total = np.zeros((weights.shape[1], lattice.unknown + 1))
    for part in _groups(chunks):
        group = [chunks[k] for k in part]
        arcs = lattice.arcs(group)
        which, start, end, number = arcs
        sizes = np.array([len(c) for c in group])
        if sizes.max() > SHORT:
            alpha, whole = log_forward(arcs, sizes, base[:, None])
            beta, gains = np.zeros_like(alpha), np.log(base)[number]
            _log_sweep(which, start, end, gains[:, None], beta, range(beta.shape[1] - 2, -1, -1))
            share = np.exp(alpha[which, start, 0] + gains + beta[which, end, 0] - whole[which, 0])
        else:
            alpha, whole = forward(arcs, sizes, base[:, None])
            beta = np.zeros_like(alpha)
            beta[np.arange(len(group)), sizes] = 1.0
            _sweep(which, start, end, base[:, None], number, beta, range(beta.shape[1] - 2, -1, -1))
            share = alpha[which, start, 0] * base[number] * beta[which, end, 0] / whole[which, 0]
        for language in range(weights.shape[1]):
            total[language] += np.bincount(number, share * weights[part, language][which], len(total[language]))
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # piece (and unknown), language
    prior: np.ndarray  # log, by language


@dataclass
class _Shared:
    """What the tasks need; a Python worker builds it once, for all tasks that it runs with this broadcast value."""

    arguments: tuple

    @cached_property
    def lattice(self) -> Lattice:
        return Lattice(self.arguments[0])

    @cached_property
    def identifier(self) -> Identifier:
        return Identifier(*self.arguments)


def _base(scores: Sequence[int]) -> np.ndarray:
    weight = np.exp(np.array(scores, float) / UNIT)
    return np.append(weight / weight.sum(), math.exp(UNKNOWN))


def fit_languages(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", model_path: str = MODEL_PATH
) -> LanguageModel:
    """Piece distributions of every language in ``docs``, from all rows whose text and language are not null.

    Repeated rows count each time. Without such rows the model knows no language.
    """
    spark = prepare(docs.sparkSession)
    vocabulary = read_vocabulary(model_path)
    pieces, base = [vocabulary.pieces[i] for i in vocabulary.scores], _base(list(vocabulary.scores.values()))
    shared = spark.sparkContext.broadcast(_Shared((pieces, base)))

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, base = shared.value.lattice, shared.value.arguments[1]
        seen: dict[str, Counter] = {}
        documents: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            languages = sorted(seen)
            chunks = sorted({c for counts in seen.values() for c in counts})
            if chunks:
                place = {c: k for k, c in enumerate(chunks)}
                weights = np.zeros((len(chunks), len(languages)))
                for k, counts in enumerate(map(seen.__getitem__, languages)):
                    at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
                    weights[at, k] = np.fromiter(counts.values(), float, len(counts))
                total = expected_counts(lattice, chunks, weights, base)
                language, piece = np.nonzero(total)
                yield rows([languages[k] for k in language], piece, total[language, piece])
            if documents:
                yield rows(list(documents), np.full(len(documents), -1), np.array(list(documents.values()), float))
            seen.clear()
            documents.clear()

        def rows(language, piece, n) -> pa.RecordBatch:
            columns = [pa.array(language, pa.string()), pa.array(piece, pa.int32()), pa.array(n, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "n"])

        for batch in batches(source):
            for value, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                seen.setdefault(name, Counter()).update(lattice.chunks(value))
                documents[name] += 1
            if sum(map(len, seen.values())) > _HELD:
                yield from flush()
        yield from flush()

    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    table = known.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(languages)}
    column = np.array([place[name] for name in table.column("lang").to_pylist()], int)
    piece, n = table.column("piece").to_numpy(), table.column("n").to_numpy()
    counts, documents = np.zeros((len(base), len(languages))), np.ones(len(languages))
    inside = piece >= 0
    counts[piece[inside], column[inside]] = n[inside]
    documents[column[~inside]] += n[~inside]
    counts[-1] = 0.0
    probability = (counts + SMOOTHING * base[:, None]) / (counts.sum(axis=0) + SMOOTHING)
    probability[-1] = base[-1]
    return LanguageModel(languages, pieces, probability, np.log(documents / max(1.0, documents.sum())))


class Identifier:
    """Scores texts; holds the log probabilities of the chunks it has met, up to a bound."""

    def __init__(self, languages, pieces, probability, prior) -> None:
        self.lattice, self.languages = Lattice(pieces), languages
        self.probability, self.prior = probability, prior
        self.rows: dict[str, int] = {}
        self._table = np.zeros((0, len(languages)))

    @property
    def logs(self) -> list[np.ndarray]:
        return [self._table[: len(self.rows)]]

    def _learn(self, chunks: list[str]) -> None:
        need = len(self.rows) + len(chunks)
        if need > len(self._table):  # grows by doubling, so that it is seldom copied
            self._table = np.concatenate([*self.logs, np.empty((need + max(need, 4096) - len(self.rows), len(self.languages)))])
        for part in _groups(chunks):
            group = [chunks[k] for k in part]
            arcs, sizes = self.lattice.arcs(group), np.array([len(c) for c in group])
            long = sizes.max() > SHORT
            _, whole = (log_forward if long else forward)(arcs, sizes, self.probability)
            low = len(self.rows)
            self.rows.update(zip(group, range(low, low + len(group)), strict=True))
            self._table[low : low + len(group)] = whole if long else np.log(np.maximum(whole, 1e-300))

    def identify(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior; ``und`` and 0 for a null text or one without a letter."""
        if len(self.rows) > _HELD:
            self.rows = {}
        cut = [self.lattice.chunks(t) if t and self.languages and any(map(str.isalpha, t)) else [] for t in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.rows)
        if fresh:
            self._learn(list(fresh))
        names, scores = [], []
        for chunks in cut:
            if not chunks:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.prior + self._table[np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def identify_languages(
    docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of every row.

    Null texts and texts without a letter are ``und`` with score 0; equal probabilities go to the first language
    in alphabetical order. Nothing is shuffled; other columns, also one named ``lang``, are not read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_Shared((model.languages, model.pieces, model.probability, model.prior)))
    schema = T.StructType(
        [*[docs.select(k).schema[0] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = shared.value.identifier
        for batch in batches(source):
            names, scores = identifier.identify(batch.column(text).to_pylist())
            columns = [*[batch.column(k) for k in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
