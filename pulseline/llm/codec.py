"""SentencePiece encoding and decoding with a Viterbi over shared prefixes.

The distinct marked words of a batch of texts are sorted, which makes them a trie in
depth-first order: each word shares its longest common prefix with the one before. The
forward state at a place (best score, last piece) depends only on the characters up to
it, so the states along the common prefix are kept on a stack and only the rest of the
word is scored. Segmentation and tie rules are those of ``vocabulary``; of the words'
ids a task keeps those of up to ``REMEMBERED`` words.

Texts become ids by gathering their words' ids, and ids become texts by gathering their
pieces' bytes, both in whole arrays. Decoding drops the leading space that marked the
text. ``decode(encode(text)) == text`` for every text without U+2581, which comes back
as a space.

Defined results: a null text has null ids, an empty one no ids. The order and number
of rows does not matter; repeated rows get the same ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.llm.rows import packed, unpacked
from pulseline.llm.vocabulary import DEFAULT_MODEL, MARK, Vocabulary, load, words_of

REMEMBERED = 400_000
TEXT_BYTES = 1 << 21


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of ``values`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # Every ending of a piece, with the id of the piece that it is, or -1.
        self.endings = {p[k:]: -1 for p in vocabulary.ids for k in range(len(p))} | vocabulary.ids
        self.singles = {p for p in vocabulary.ids if len(p) == 1}
        values = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for byte, number in enumerate(vocabulary.byte_ids):
            values[number] = bytes([byte])
        for number, piece in enumerate(vocabulary.pieces):
            if piece not in vocabulary.ids and number not in vocabulary.byte_ids:
                values[number] = b""  # control pieces stand for no text
        self.piece_bytes = np.frombuffer(b"".join(values), dtype=np.uint8)
        self.piece_sizes = np.array([len(v) for v in values], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = self.sizes = np.empty(0, np.int64)

    def segment(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each of ``words``, which are sorted and marked."""
        endings, scores, unknown = self.endings, self.vocabulary.scores, self.vocabulary.unknown
        best, back = [0.0], [(0, 0)]  # per place: score; start and id of the last piece, -1 for unknown
        before = ""
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, step = None, None
                if word[end - 1] not in self.singles:
                    top, step = best[end - 1] + unknown, (end - 1, -1)
                for start in range(end - 1, -1, -1):  # longer pieces last, so they win ties
                    number = endings.get(word[start:end])
                    if number is None:
                        break
                    if number >= 0:
                        candidate = best[start] + scores[number]
                        if top is None or candidate >= top:
                            top, step = candidate, (start, number)
                best.append(top)
                back.append(step)
            ids, end = [], len(word)
            while end:
                start, number = back[end]
                if number >= 0:
                    ids.append(number)
                else:
                    ids.extend(self.vocabulary.byte_ids[b] for b in reversed(word[start].encode()))
                end = start
            yield ids[::-1]
            before = word

    def learn(self, words: set[str]) -> None:
        marked = sorted(MARK + w for w in words)
        found = list(self.segment(marked))
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        base = len(self.ids)
        for word in marked:
            self.number[word[1:]] = len(self.number)
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        split = [words_of(t) for t in texts]
        if len(self.number) >= REMEMBERED:
            self.forget()
        new = {w for words in split for w in words if w not in self.number}
        if new:
            self.learn(new)
        number = self.number
        which = np.fromiter((number[w] for words in split for w in words), np.int64, sum(map(len, split)))
        sizes = self.sizes[which]
        cuts = np.cumsum([0] + [len(words) for words in split])
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.ids, self.starts[which], sizes), totals[cuts[1:]] - totals[cuts[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ``counts`` ids each. Malformed bytes become U+FFFD."""
        sizes = self.piece_sizes[ids]
        data = gather(self.piece_bytes, self.piece_starts[ids], sizes).tobytes()
        totals = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        texts = []
        for first, last in zip(totals[:-1].tolist(), totals[1:].tolist()):
            text = data[first:last].decode("utf-8", "replace")
            texts.append(text[1:] if text.startswith(" ") else text)
        return texts


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, scores: str) -> Codec:
    """One per worker process."""
    if (path, scores) not in _codecs:
        _codecs[path, scores] = Codec(load(path, scores))
    return _codecs[path, scores]


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows with about ``TEXT_BYTES`` of text or less; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    row, held = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if n > row and held + size > TEXT_BYTES:
            yield row, n
            row, held = n, 0
        held += size
    if row < len(sizes):
        yield row, len(sizes)


def encoded(docs: DataFrame, model: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """``docs`` with ``_ids`` (array<int>), ``_n_tokens`` and ``_exact``, whether
    decoding the ids gives the text again. Own columns of these names are replaced."""
    rows = packed(docs, "text").withColumn("text", F.col("text").cast("string"))
    names = rows.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(model, scores)
        for batch in batches:
            for first, last in _parts(batch.column("text")):
                part = batch.slice(first, last - first)
                texts = part.column("text").to_pylist()
                ids, counts = worker.encode(texts)
                back = worker.decode(ids, counts)
                exact = pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_())
                missing = np.array([t is None for t in texts])
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(missing, False))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(at, pa.array(ids)), pa.array(counts.astype(np.int64)), exact],
                    names=[*names, "_ids", "_n_tokens", "_exact"])
    schema = T.StructType([*rows.schema.fields, T.StructField("_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("_n_tokens", T.LongType()), T.StructField("_exact", T.BooleanType())])
    return unpacked(rows.mapInArrow(run, schema), docs.columns, ["text"], ["_ids", "_n_tokens", "_exact"])


def decoded(rows: DataFrame, ids: str = "ids", model: str = DEFAULT_MODEL, scores: str = "zipf") -> DataFrame:
    """``rows`` with ``_text``, the text of the column ``ids``; null for null. An own ``_text`` is replaced."""
    rows = rows.drop("_text")
    names = rows.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = codec(model, scores)
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = pa.array(worker.decode(lists.flatten().to_numpy(), counts), pa.string())
            texts = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "_text"])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_text", T.StringType())]))
