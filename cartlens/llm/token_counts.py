"""Token counts without tokens: a Viterbi search that carries the best score and its number of pieces.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at each character. The dynamic
programme keeps, for each position, the best score and the count of pieces behind it. Ties follow the public
unigram tokenizer: candidates for an end are tried by start, and only a higher score replaces the first one, so
the longest last piece wins. A character that no single-character piece matches may be unknown; it then counts
one token a byte where the vocabulary has byte pieces, else one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.pieces import MODEL_PATH, Memo, chunk_pattern, marked, read_vocabulary


class TokenCounter:
    """``pieces``: (text, score) pairs."""

    def __init__(self, pieces: Sequence[tuple[str, int]], unknown_score: int, byte_fallback: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.byte_fallback = unknown_score, byte_fallback
        self.pattern = chunk_pattern([p for p, _ in pieces])
        self.memo = Memo(self.count_chunk)

    def count_chunk(self, chunk: str) -> int:
        """Tokens of one chunk."""
        n = len(chunk)
        score, count = [0] + [None] * n, [0] * (n + 1)
        done, single = 0, False  # ends up to ``done`` are final; ``single``: chunk[done] is itself a piece

        def close() -> None:
            # The last candidate for an end starts right before it: the unknown character.
            nonlocal done, single
            if not single:
                value = score[done] + self.unknown
                if score[done + 1] is None or value > score[done + 1]:
                    score[done + 1] = value
                    count[done + 1] = count[done] + (len(chunk[done].encode()) if self.byte_fallback else 1)
            done, single = done + 1, False

        for last, (length, gain) in self.automaton.iter(chunk):
            while done < last:
                close()
            start = last + 1 - length
            value = score[start] + gain
            if score[last + 1] is None or value > score[last + 1]:
                score[last + 1], count[last + 1] = value, count[start] + 1
            single = single or length == 1
        while done < n:
            close()
        return count[n]

    def count(self, text: str | None) -> int:
        return sum(map(self.memo.__getitem__, self.pattern.findall(marked(text)))) if text else 0


def count_tokens(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    model_path: str = MODEL_PATH,
) -> DataFrame:
    """``keep`` columns and n_tokens (long) of every row; null and empty texts have 0 tokens.

    Nothing is shuffled; repeated rows are counted each; other columns are not read. A text of any length is cut
    into chunks between which no piece reaches, so memory is bounded by the longest chunk.
    """
    spark = prepare(docs.sparkSession)
    vocabulary = read_vocabulary(model_path)
    pieces = [(vocabulary.pieces[i], score) for i, score in vocabulary.scores.items()]
    # Bounded by the vocabulary file.
    shared = spark.sparkContext.broadcast((pieces, vocabulary.unknown_score, bool(vocabulary.byte_ids)))
    schema = T.StructType([*[docs.select(k).schema[0] for k in keep], T.StructField("n_tokens", T.LongType())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value)
        for batch in batches(source):
            counts = [counter.count(t) for t in batch.column(text).to_pylist()]
            columns = [*[batch.column(k) for k in keep], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
