"""SimHash near-duplicates by pigeonhole blocks.

1. A-Z are lower-cased, words are runs of anything but white space, shingles are
   ``size`` words joined by one space, repeats included. Each is hashed by XXH64 (seed
   42); a bit of the fingerprint is 1 if more than half of a text's hashes have it.
2. Fingerprints are grouped first, so copies are one class from the start.
3. Pigeonhole: the 64 bits are cut into ``BLOCKS`` blocks. Fingerprints that differ in
   at most ``distance`` bits agree in at least ``BLOCKS - distance`` whole blocks, so
   each choice of that many blocks is a key, and close pairs share one: no pair is missed.
4. Classes under one key form a bucket; buckets of one are dropped. A bucket is cut into
   parts of about ``PART`` fingerprints, and each pair of parts is a unit of work of its
   own, so a bucket of any size spreads over tasks. In a unit the Hamming distance of
   every pair is verified; what leaves it is a spanning forest of the links, never the pairs.
5. The links' components are spread over classes and documents.

Defined results: a null or empty text, or one without words, has the fingerprint zero,
which is linked like any other. With fewer words than a shingle takes, all of them are
one shingle. A long text is hashed piece by piece. Rows with a null doc_id get a
fingerprint, link nothing and have no component. Repeated rows give repeated results; a
doc_id on several texts gets each text's component. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.llm.components import components

SEED = 42
BLOCKS = 6
PART = 4096
PIECE_BYTES = 1 << 20
HASHES_AT_ONCE = 1 << 15
LINKS_AT_ONCE = 1 << 21
_SPACE = re.compile(rb"[ \t-\r]")


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about ``size`` bytes."""
    start = 0
    while len(data) - start > size:
        space = _SPACE.search(data, start + size)
        end = space.start() if space else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some at a time."""
    words, seen = [], 0
    digest = xxhash.xxh64_intdigest
    for piece in pieces(data):
        found = piece.lower().split()
        seen += len(found)
        words += found
        if len(words) >= size:
            runs = zip(*(words[k:] for k in range(size)))
            yield np.array([digest(b" ".join(run), SEED) for run in runs], dtype=np.uint64)
            words = words[len(words) - size + 1:]
    if 0 < seen < size:
        yield np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)


class Votes:
    """How many hashes of each row have each bit; hashes are counted many at once."""

    def __init__(self, rows: int):
        self.ones, self.total = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.held = 0

    def add(self, row: int, hashes: np.ndarray) -> None:
        self.total[row] += len(hashes)
        for first in range(0, len(hashes), HASHES_AT_ONCE):
            part = hashes[first:first + HASHES_AT_ONCE]
            self.waiting.append((row, part))
            self.held += len(part)
            if self.held >= HASHES_AT_ONCE:
                self.count()

    def count(self) -> None:
        if self.waiting:
            bits = np.unpackbits(np.concatenate([h for _, h in self.waiting]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            starts = np.cumsum([0] + [len(h) for _, h in self.waiting[:-1]])
            np.add.at(self.ones, [row for row, _ in self.waiting], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            self.waiting, self.held = [], 0

    def fingerprints(self) -> np.ndarray:
        self.count()
        return np.packbits(2 * self.ones > self.total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = Votes(batch.num_rows)
            for row, text in enumerate(batch.column("text")):
                for hashes in shingle_hashes(text.as_py() or b"", size):
                    votes.add(row, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(votes.fingerprints().view(np.int64))], names=["doc_id", "bits"])
    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and the fingerprint as the 64 bits of a long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(_fingerprints(size), "doc_id long, bits long")


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """As signed longs, the bits of every choice of ``blocks - distance`` blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, root) for each of ``n`` rows that the links a-b tie to a smaller row; root is
    the smallest row reachable."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            rows = np.flatnonzero(root != np.arange(n))
            return rows, root[rows]


def close_pairs(unit: np.ndarray, side: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs. Rows of one ``unit`` stand together; where a unit
    has two sides only pairs across them count. Row i meets row i + k of its unit, for all i at once."""
    n, found, held = len(unit), [], 0
    last = np.flatnonzero(np.append(unit[1:] != unit[:-1], True)) if n else np.empty(0, int)
    left = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n)
    sizes = np.diff(last, prepend=-1)
    two_sided = np.repeat(np.add.reduceat(side, last - sizes + 1) > 0 if n else np.empty(0, bool), sizes)
    here = np.flatnonzero(left > 0)
    k = 1
    while len(here):
        ok = np.bitwise_count(bits[here] ^ bits[here + k]) <= distance
        ok &= ~two_sided[here] | (side[here] != side[here + k])
        if ok.any():
            found.append((here[ok], here[ok] + k))
            held += len(found[-1][0])
            if held > LINKS_AT_ONCE:
                found = [forest(*map(np.concatenate, zip(*found)), n)]
                held = len(found[0][0])
        k += 1
        here = here[left[here] >= k]
    return forest(*map(np.concatenate, zip(*found)), n) if found else (np.empty(0, int), np.empty(0, int))


def _links(distance: int):
    """Streams rows that arrive sorted by unit of work; holds a batch and one unit."""
    def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [rows.column(k).to_numpy() for k in ("key", "masked", "low", "high")]
        changed = np.zeros(len(rows), dtype=np.int64)
        for key in keys:
            changed[1:] |= key[1:] != key[:-1]
        bits = rows.column("bits").to_numpy()
        side = rows.column("side").to_numpy().astype(np.int64)
        a, b = close_pairs(np.cumsum(changed), side, bits.view(np.uint64), distance)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(bits[a]), pa.array(bits[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
            same = np.ones(len(rows), dtype=bool)
            for k in ("key", "masked", "low", "high"):
                column = rows.column(k).to_numpy()
                same &= column == column[-1]
            whole = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if whole:
                yield from emit(rows.slice(0, whole))
            kept = rows.slice(whole)
        if kept is not None and len(kept):
            yield from emit(kept)
    return run


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """``classes``: distinct ``bits``. Returns (a, b), spanning forests of the close pairs."""
    keys = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.col("bits").bitwiseAND(F.lit(mask).cast("long")).alias("masked"))
                     for k, mask in enumerate(block_masks(distance))])
    posted = classes.select("bits", F.explode(keys).alias("p")).select("bits", "p.*")
    # Written before it meets its rows again, so that a hot key's join can be split.
    buckets = materialise(posted.groupBy("key", "masked").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"), F.count(F.lit(1)).alias("n"))
                          .where("n > 1").select("key", "masked", "parts"), "buckets")
    part = F.pmod(F.xxhash64("bits"), F.col("parts"))
    units = (posted.join(buckets, ["key", "masked"]).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .select("key", "masked", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                     (F.col("part") > F.col("other")).cast("int").alias("side"), "bits")
             .repartition("key", "masked", "low", "high").sortWithinPartitions("key", "masked", "low", "high", "bits"))
    return units.mapInArrow(_links(distance), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id,
    the smallest doc_id reachable by links."""
    signed = materialise(fingerprints(docs, size), "fingerprints")
    classes = materialise(signed.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("rep")), "classes")
    tied = components(links(classes.select("bits"), distance), "a", "b").withColumnRenamed("node", "bits")
    tied = tied.unionByName(tied.select(F.col("component").alias("bits"), "component").distinct())
    members = materialise(tied.join(classes, "bits"), "members")
    least = materialise(members.groupBy("component").agg(F.min("rep").alias("least")), "least")
    linked = materialise(members.join(least, "component").select("bits", "least"), "linked")
    found = materialise(classes.join(linked, "bits", "left").select("bits", F.coalesce("least", "rep").alias("component_id")), "found")
    return signed.join(found, "bits", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
