"""The vocabulary of a public SentencePiece model file: pieces with log scores, byte pieces, and where a text
can be cut without touching any segmentation.

The file is read by the driver; tasks get plain lists. Scores are whole sixteenths of a nat, so sums are exact in
any order and ties are real ties. A unigram model's own log scores are used. A merge-rank (BPE) file has no
probabilities: its pieces, listed by frequency, get the log score of Zipf's law for their rank.
"""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass

UNIT = 16
MARK = "▁"
#: Where public tokenizer files lie unless the caller says otherwise.
MODEL_PATH = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM = 1
# What the unknown piece scores below the least piece (fixed value of the public library).
UNKNOWN_PENALTY = 10.0


def read_fields(data: bytes):
    """(field number, value) of a protobuf message: bytes for length-delimited and 4-byte fields, else int."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """pieces[i] is the text of id i; ``scores`` (in 1/16 nat) holds the ids that match text."""

    pieces: list[str]
    scores: dict[int, int]
    byte_ids: list[int]
    unknown_id: int

    @property
    def unknown_score(self) -> int:
        return min(self.scores.values()) - round(UNKNOWN_PENALTY * UNIT)

    def matching(self) -> dict[str, int]:
        return {self.pieces[i]: i for i in self.scores}


def read_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    """Pieces of a model file. Only normal and user-defined pieces match text."""
    import struct

    with open(path, "rb") as file:
        data = file.read()
    pieces, raw, kinds, model_kind = [], [], [], UNIGRAM
    for number, value in read_fields(data):
        if number == 1:
            entry = dict(read_fields(value))
            pieces.append(entry.get(1, b"").decode())
            raw.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
            kinds.append(entry.get(3, NORMAL))
        elif number == 2:
            model_kind = dict(read_fields(value)).get(3, UNIGRAM)
    matching = [i for i, kind in enumerate(kinds) if kind in (NORMAL, USER_DEFINED)]
    if model_kind == UNIGRAM:
        scores = {i: round(raw[i] * UNIT) for i in matching}
    else:
        total = sum(1.0 / (rank + 2) for rank in range(len(matching)))
        scores = {i: round(-math.log((rank + 2) * total) * UNIT) for rank, i in enumerate(matching)}
    byte_ids = [-1] * 256
    for i, kind in enumerate(kinds):
        if kind == BYTE:
            byte_ids[int(pieces[i][1:-1], 16)] = i
    unknown = next((i for i, kind in enumerate(kinds) if kind == UNKNOWN), 0)
    return Vocabulary(pieces, scores, byte_ids if min(byte_ids) >= 0 else [], unknown)


def chunk_pattern(pieces) -> re.Pattern:
    """Cuts a marked text where no piece can reach across: before a mark that ends a word, and around characters
    that no longer piece holds."""
    long = [p for p in pieces if len(p) > 1]
    if any(MARK in p.lstrip(MARK) for p in long):
        return re.compile(r"(?s).+")
    joining = re.escape("".join(sorted({c for p in long for c in p} - {MARK})))
    return re.compile(rf"{MARK}*[{joining}]+|{MARK}+|[^{joining}{MARK}]")


def marked(text: str) -> str:
    """Blanks become marks, and one mark stands before the text; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


class Memo(dict):
    """What was computed for a chunk, forgotten altogether when ``limit`` chunks are held."""

    def __init__(self, compute, limit: int = 400_000) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, chunk):
        if len(self) >= self.limit:
            self.clear()
        value = self[chunk] = self.compute(chunk)
        return value
