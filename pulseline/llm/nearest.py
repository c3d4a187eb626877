"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Every vector is scaled to length one and turned by a fixed random rotation; its code
is the sign of each coordinate, packed into bits, with one correction scalar: the
inner product of the turned vector with its own code's unit vector. For a query,
code . query / correction estimates the inner product without bias, and its error
stays below ``confidence * sqrt((1 - c^2) / c^2 / (dim - 1))`` with a probability that
``confidence`` sets. Per query the vectors of highest estimate are compared exactly, and
their k-th best cosine is the bar; every vector whose upper bound reaches it is reranked
on the original vectors in double precision.

Equal vectors share a code: an index row stands for all copies of one vector and
keeps the smallest ids that a result can need, so a vector with any number of copies
stays one row. Index rows are dealt over blocks by hash, queries are cut into chunks,
and each (block, chunk) is one unit of work with bounded size; units return k rows
per query, and the best k of all units are the result. All rows are indexed, every
query meets every code.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id. Rows repeated under one id count
once; if their vectors differ, the smallest vector counts. Vectors are compared
with those of the same dimension only. Ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise

BLOCK_ROWS = 1 << 13
CHUNK_QUERIES = 1 << 12
CONFIDENCE = 3.0
ROUNDING = 1e-9
PAIRS = 1 << 16
SEED = 7


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction of each row of a matrix."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = units @ rotation(vectors.shape[1])
    corrections = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), corrections


def bounds(codes: np.ndarray, corrections: np.ndarray, queries: np.ndarray,
           confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (queries x codes) and the codes' error bounds."""
    dim = queries.shape[1]
    units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    turned = (units @ rotation(dim)).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs *= 2
    signs -= 1
    scale = (1 / (corrections * np.sqrt(dim))).astype(np.float32)
    error = confidence * np.sqrt(np.maximum(0, 1 - corrections ** 2)) / corrections / np.sqrt(max(1, dim - 1))
    return (turned @ signs.T) * scale, error.astype(np.float32) + np.float32(1e-5)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def _survivors(estimate: np.ndarray, error: np.ndarray, units: np.ndarray, queries: np.ndarray, need: int):
    """(query, code) pairs that may be among a query's ``need`` best. Cosines of unit
    vectors, good to ``ROUNDING``, decide who is left; exact values are the caller's."""
    near = lambda q, c: np.einsum("ij,ij->i", queries[q], units[c])
    first = min(4 * need, estimate.shape[1])
    rows = np.repeat(np.arange(len(estimate)), first)
    best = np.argpartition(-estimate, first - 1, axis=1)[:, :first].ravel()
    close = near(rows, best).reshape(-1, first)
    bar = np.partition(close, -need, axis=1)[:, -need] - ROUNDING
    reaches = estimate + error >= bar[:, None]
    reaches[rows, best] = True
    q, c = np.nonzero(reaches)
    left = [near(q[a:a + PAIRS], c[a:a + PAIRS]) >= bar[q[a:a + PAIRS]] for a in range(0, len(q), PAIRS)]
    left = np.concatenate(left)
    return q[left], c[left]


def _search(k: int):
    """One unit: index rows (``query`` null) and queries, in any order."""
    def best(codes, corrections, vectors, ids, queries, names) -> Iterator[tuple[int, int, float]]:
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for start in range(0, len(queries), 256):
            part = queries[start:start + 256]
            estimate, error = bounds(codes, corrections, part)
            q, c = _survivors(estimate, error, units, part / np.linalg.norm(part, axis=1, keepdims=True), min(k + 1, len(vectors)))
            yield from _top(start + q, c, cosines(part[q], vectors[c]), ids, names, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        def flush():
            if unit is None:
                return
            dim = unit[0]
            index = [r for r in rows if r[0] is None]
            asked = [r for r in rows if r[0] is not None]
            if not index or not asked:
                return
            codes = np.frombuffer(b"".join(r[2] for r in index), dtype=np.uint8).reshape(len(index), -1)
            vectors = np.array([r[4] for r in index]).reshape(len(index), dim)
            found = list(best(codes, np.array([r[3] for r in index]), vectors, [r[1] for r in index],
                              np.array([r[4] for r in asked]).reshape(len(asked), dim), [r[0] for r in asked]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("query", "ids", "code", "correction")]
            vectors = batch.column("vector")
            cuts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            keys = zip(*(batch.column(n).to_pylist() for n in ("dim", "block", "chunk")))
            for n, key in enumerate(keys):
                if key != unit:
                    yield from flush()
                    unit, rows = key, []
                rows.append((*(c[n] for c in columns), values[cuts[n]:cuts[n + 1]].copy()))
        yield from flush()
    return run


def _top(q: np.ndarray, c: np.ndarray, score: np.ndarray, ids: list[list[int]], names: list[int], k: int):
    """The k best (query id, vector id, score) of each query among reranked rows."""
    order = np.lexsort((-score, q))
    q, c, score = q[order], c[order], score[order]
    edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True])
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own, found, worst = names[q[first]], [], None
        for n in range(first, last):
            if len(found) >= k and score[n] < worst:
                break
            found += [(-score[n], i) for i in ids[c[n]] if i != own]
            if len(found) >= k:
                found = sorted(found)[:k]
                worst = -found[-1][0]
        yield from ((own, i, -s) for s, i in sorted(found)[:k])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        cuts, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        codes, corrections = [None] * len(vectors), np.zeros(len(vectors))
        sizes = np.diff(cuts)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            packed, corrections[rows] = encode(values[cuts[rows][:, None] + np.arange(dim)])
            for row, code in zip(rows.tolist(), packed):
                codes[row] = code.tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(codes, pa.binary()), pa.array(corrections)], names=[*batch.schema.names, "code", "correction"])


def neighbours(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of every row that ``is_query`` (a condition on the
    column ``vec_id``) selects: query_id, rank from 1, vec_id, score."""
    vector = F.col(embedding).cast("array<double>")
    usable = (F.col("vec_id").isNotNull() & (F.size("vector") > 0)
              & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0))
    taken = (rows.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector")).where(usable)
             .groupBy("vec_id").agg(F.min("vector").alias("vector")))
    taken = materialise(taken.withColumn("same", F.sha2(F.array_join(F.transform("vector", lambda x: (x + 0.0).cast("string")), ","), 256)), "vectors")
    first_ids = Window.partitionBy("same").orderBy("vec_id")
    index = (taken.withColumn("place", F.row_number().over(first_ids)).where(F.col("place") <= k + 1)
             .groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vector").alias("vector")))
    index = materialise(index.mapInArrow(_encoded, "same string, ids array<long>, vector array<double>, code binary, correction double"), "index")
    queries = taken.where(is_query)
    n, asked = index.count(), queries.count()
    blocks, chunks = -(-n // BLOCK_ROWS) or 1, -(-asked // CHUNK_QUERIES) or 1
    dealt = (index.select(F.lit(None).cast("long").alias("query"), "ids", "code", "correction", "vector",
                          F.pmod(F.xxhash64("same"), F.lit(blocks)).alias("block"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")))
    sent = queries.select(F.col("vec_id").alias("query"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("code"),
                          F.lit(None).cast("double").alias("correction"), "vector",
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"))
    units = (dealt.unionByName(sent).withColumn("dim", F.size("vector"))
             .repartition("dim", "block", "chunk").sortWithinPartitions("dim", "block", "chunk"))
    found = units.mapInArrow(_search(k), "query_id long, vec_id long, score double")
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
