"""Substring deduplication by parsing documents against every indexed block of text.

The reference is the whole corpus, cut into content-defined blocks. Among the 8-word
grams of a window, the one with the smallest hash is the window's anchor; a block is
the run of successive windows that share an anchor (at most 43 windows, 92 words). The
same window has the same anchor wherever it stands, so whatever is repeated anywhere
is found under the anchor of one indexed block, and about one word in 22 starts one.

1. Every block of every document goes into the index: anchor, hash of its words,
   document, place. Successive equal blocks (periodic text) are one entry.
2. Parsing: anchors that only one document has are literals. Every other block that an earlier
   document holds word for word refers to its earliest copy, a document and a place there. Each
   document is then factored from left to right: a factor starts at the first block that has a
   reference, and takes the next block as long as that one's reference goes on where the last one's
   ended; a factor ends at a literal or where the earliest copy changes.
3. Factor boundaries: where blocks under one anchor differ (a passage begins or ends
   there), the windows of the earliest copy of each differing block are compared one
   by one, so that what stands before and after a factor is found to the exact word.

A factor is at least one window long, and its words are duplicate spans. All of that
is equi-joins and aggregates; a frequent passage is one row per task after map-side
combine, and no pairs of documents are formed. Equality is that of 64-bit hashes of
the words' sequence within the same 64-bit anchor.

Defined results: null, empty and wordless texts have no words and lose none. Documents
with a null doc_id are neither reference nor cut. Rows that share a doc_id do not cut
each other. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.durable import materialise
from pulseline.llm.rows import packed, unpacked
from pulseline.llm.wordhash import _power_tables, mix, ngrams, text_chunks, words_of

GRAM = 8
# A block's document, text, first and last window.
PLACE = ["doc_id", "text_key", "first", "last"]


def _running(words: np.ndarray) -> np.ndarray:
    power, _ = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[:len(words)], out=sums[1:])
    return sums


def _sequence_hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of words first..end-1, the same at any place."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[first]) * inverse[first])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of every ``width`` successive ones, the first of equal ones."""
    def merged(x: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(x[:-step], x[step:]), np.where(x[step:] < x[:-step], place[step:], place[:-step])

    place, span = np.arange(len(x), dtype=np.int64), 1
    while span * 2 <= width:
        x, place = merged(x, place, span)
        span *= 2
    return merged(x, place, width - span)[1] if width > span else place


def _parse(words: np.ndarray, cuts: np.ndarray, window: int):
    """Blocks of the texts whose words lie between ``cuts``: text, anchor hash, block
    hash, first and last window (counted within the text)."""
    empty = np.empty(0, np.int64)
    if len(words) < window:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    grams = ngrams(words, GRAM)
    least = _sliding_least(grams, window - GRAM + 1)
    whole = np.flatnonzero(text[:len(words) - window + 1] == text[window - 1:])
    if not len(whole):
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    anchor = least[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, anchor = whole[begin], whole[np.append(begin[1:], len(whole)) - 1], anchor[begin]
    shape = mix(((anchor - first) * 1000 + (last - first)).astype(np.uint64))
    block = mix(_sequence_hash(_running(words), first, last + window) ^ shape)
    anchor_hash = grams[anchor]
    other = np.ones(len(first), dtype=bool)
    other[1:] = ((anchor_hash[1:] != anchor_hash[:-1]) | (block[1:] != block[:-1]) | (first[1:] != last[:-1] + 1)
                 | (text[first[1:]] != text[first[:-1]]))
    begin = np.flatnonzero(other)
    end = np.append(begin[1:], len(first)) - 1
    owner = text[first[begin]]
    return owner, anchor_hash[begin], block[begin], first[begin] - cuts[owner], last[end] - cuts[owner]


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in text_chunks(batch.column("text")):
                words, cuts = words_of(data, bounds)
                owner, anchor, block, first, last = _parse(words, cuts, window)
                at = pa.array(owner + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(anchor.view(np.int64)),
                     pa.array(block.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    names=["doc_id", "text_key", "anchor", "block", "first", "last"])
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for row, end, data, bounds in text_chunks(batch.column("text")):
                words, cuts = words_of(data, bounds)
                sums = _running(words)
                own = asked.slice(row, end - row)
                blocks = own.flatten()
                owner = np.repeat(np.arange(end - row), np.diff(own.offsets.to_numpy()))
                first = blocks.field("first").to_numpy().astype(np.int64)
                counts = blocks.field("last").to_numpy().astype(np.int64) - first + 1
                which = np.repeat(np.arange(len(first)), counts)
                place = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = place + cuts[owner[which]]
                hashes = _sequence_hash(sums, at, at + window)
                rows = pa.array(owner[which] + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows),
                     blocks.field("anchor").take(pa.array(which)), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32))],
                    names=["doc_id", "text_key", "anchor", "words", "first"])
    return run


def factored(blocks: DataFrame) -> DataFrame:
    """The greedy parse. ``blocks``: the blocks of documents (``PLACE``) that have a ``source``, the place of their
    earliest copy. Returns the factors (doc_id, text_key, first and last window, source where it starts): runs of successive
    blocks whose sources follow each other in one document. Rows of equal documents count once."""
    once = blocks.groupBy("doc_id", "text_key", "first").agg(F.min(F.struct("last", "source")).alias("_b")).select(
        "doc_id", "text_key", "first", "_b.last", "_b.source")
    along = Window.partitionBy("doc_id", "text_key").orderBy("first")
    before = F.lag(F.struct("last", "source")).over(along)
    goes_on = ((F.col("_before.last") + 1 == F.col("first")) & (F.col("_before.source.last") + 1 == F.col("source.first"))
               & (F.col("_before.source.doc_id") == F.col("source.doc_id")) & (F.col("_before.source.text_key") == F.col("source.text_key")))
    numbered = once.withColumn("_before", before).withColumn("_factor", F.count_if(~F.coalesce(goes_on, F.lit(False))).over(along))
    return numbered.groupBy("doc_id", "text_key", "_factor").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("source", "first").alias("source")).drop("_factor")


def duplicate_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_key, spans) of the documents with words that stand, in a window of
    ``window`` words, also in a document with a smaller doc_id. Spans are word places,
    end exclusive; they may overlap."""
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where("doc_id is not null and text is not null").withColumn("text_key", F.xxhash64("text")))
    index = materialise(texts.mapInArrow(
        _blocks(window), "doc_id long, text_key long, anchor long, block long, first int, last int"), "blocks")
    # Aggregates are written before they meet their rows again, so that a hot anchor's join can be split.
    shared = materialise(index.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                         .where("low < high").select("anchor"), "shared")
    met = materialise(index.join(shared, "anchor"), "met")
    earliest = met.groupBy("anchor", "block").agg(F.min(F.struct(*PLACE)).alias("source"))
    differing = earliest.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("anchor", F.lit(True).alias("differs"))
    reference = materialise(earliest.join(differing, "anchor", "left"), "reference")
    parsed = materialise(
        met.join(reference, ["anchor", "block"]).withColumn("factor", F.col("doc_id") > F.col("source.doc_id"))
        .where("factor or differs").select(met["*"], F.when(F.col("factor"), F.col("source")).alias("source"), "factor"), "parsed")
    factors = factored(parsed.where("factor")).select("doc_id", "text_key", "first", (F.col("last") + window).alias("end"))
    borders = parsed.where("not factor").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("asked"))
    windows = materialise(
        texts.join(borders, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
        .mapInArrow(_windows(window), "doc_id long, text_key long, anchor long, words long, first int"), "windows")
    seen = materialise(windows.groupBy("anchor", "words").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
                       .where("earliest < latest").drop("latest"), "seen")
    ends = (windows.join(seen, ["anchor", "words"]).where("doc_id > earliest")
            .select("doc_id", "text_key", "first", (F.col("first") + window).alias("end")))
    return factors.unionByName(ends).groupBy("doc_id", "text_key").agg(
        F.array_distinct(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _cut(joined: bool, names: list[str]):
    """Words outside the spans; ``joined`` by single spaces, or else as they stood."""
    def kept(text: str | None, spans: list[dict] | None) -> tuple[int, int, str | None]:
        words = (text or "").encode().split()
        if not spans:
            return len(words), 0, b" ".join(words).decode() if joined else text
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, [s["first"] for s in spans], 1)
        np.add.at(edge, [s["end"] for s in spans], -1)
        keep = np.cumsum(edge[:-1]) == 0
        removed = int(len(words) - keep.sum())
        if joined:
            return len(words), removed, b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode()
        data, parts, at = text.encode(), [], 0
        for word, stays in zip(words, keep.tolist()):
            start = data.index(word, at)
            if stays:
                parts.append(data[at:start + len(word)])
            at = start + len(word)
        return len(words), removed, b"".join(parts).decode().strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                found = [kept(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("_spans").to_pylist())]
                texts = pa.array([f[2] for f in found], pa.string())
                columns = [texts if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                    names=[*names, "_n_words", "_n_removed"])
    return run


def without_repeats(docs: DataFrame, window: int = 50, joined: bool = False) -> DataFrame:
    """``docs`` with ``text`` cut, and ``_n_words`` and ``_n_removed`` added. Texts keep
    their white space (except at the ends of a cut text) unless ``joined`` asks for
    single spaces. The number and columns of rows stay; only own columns of those two names are replaced."""
    spans = duplicate_spans(docs, window).select(
        F.col("doc_id").alias("_span_doc"), F.col("text_key").alias("_span_key"), F.col("spans").alias("_spans"))
    rows = packed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    names = rows.columns
    matched = rows.join(spans, (F.col("doc_id").cast("long") == F.col("_span_doc"))
                        & (F.xxhash64("text") == F.col("_span_key")), "left").select(*names, "_spans")
    schema = T.StructType([*rows.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())])
    return unpacked(matched.mapInArrow(_cut(joined, names), schema), docs.columns, ["doc_id", "text"], ["_n_words", "_n_removed"])
