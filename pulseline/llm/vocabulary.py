"""Unigram vocabularies from public SentencePiece model files.

A model file is read for its pieces; nothing is trained. The public file at hand keeps
merge ranks instead of log-probabilities, so a piece of rank r (best file score first,
then id) scores ``-ln(r + 2.7) - ln(sum 1 / (r + 2.7))``, Zipf's law over the ranks.
``scores="file"`` takes the file's scores as they are.

Segmentation rules, those of the public unigram tokenizer over marked words: a text is
marked by one leading space, spaces become U+2581, and each mark begins a word of its
own, so no piece crosses a space. Among the segmentations of a word the highest sum of
scores wins, added from the left in double precision; a later candidate for the same
place must be strictly better, so ties go to the longer last piece. A character without
a piece of its own may be passed at the lowest score less 10 and becomes its UTF-8 bytes.
An empty text has no words.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import lru_cache

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
_NORMAL, _BYTE = 1, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]          # by id
    scores: tuple[float, ...]        # by id; those of control and byte pieces are unused
    ids: dict[str, int]              # of the pieces that text can match
    byte_ids: tuple[int, ...]
    unknown: float


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL, scores: str = "zipf") -> Vocabulary:
    with open(path, "rb") as file:
        data = file.read()
    rows = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            rows.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, _NORMAL)))
    normal = sorted((i for i, r in enumerate(rows) if r[2] == _NORMAL), key=lambda i: (-rows[i][1], i))
    if scores == "zipf":
        total = math.log(math.fsum(1 / (r + 2.7) for r in range(len(normal))))
        score = {i: -math.log(r + 2.7) - total for r, i in enumerate(normal)}
    else:
        score = {i: rows[i][1] for i in normal}
    lowest = min(score.values())
    byte_ids = {int(r[0][3:5], 16): i for i, r in enumerate(rows) if r[2] == _BYTE}
    return Vocabulary(tuple(r[0] for r in rows), tuple(score.get(i, lowest) for i in range(len(rows))),
                      {rows[i][0]: i for i in normal}, tuple(byte_ids[b] for b in range(256)), lowest - UNKNOWN_PENALTY)


def words_of(text: str | None) -> list[str]:
    """Words without their marks, in order; joined by spaces they are the text."""
    return text.replace(MARK, " ").split(" ") if text else []
