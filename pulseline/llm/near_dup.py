"""MinHash near-duplicates by an inverted index over signature coordinates.

A document is the set of its word shingles; A-Z are lower-cased, nothing else is
changed. Documents with the same set are one class from the start; everything else
works on one text per class.

1. Signature: ``COORDINATES`` minima per set. A token is a (coordinate, value) pair.
2. Postings. Two sets at the similarity bound agree in a share of the tokens that is
   binomial; ``match_threshold`` is the count that all but ``LOST`` of such pairs reach,
   27 of 48 for 0.85. Tokens are ordered by how many representatives post them (rarest
   first, ties by token). Signatures that share 27 of 48 tokens share one among the
   first 22 of either, so only those are posted. Tokens that nobody else posts come
   first in this order and are skipped, as are documents with fewer than 27 shared
   tokens, which can have no partner.
3. Posting lists are merged. A posting carries the document's other shared tokens, a list longer than
   ``LIST_PART`` is cut into parts, and each pair of parts is a unit of work of its own. There agreeing
   coordinates are counted pair by pair and pairs that reach the match threshold are retained;
   pairs that retained ones tie together already are skipped. What leaves a unit is a forest of
   retained pairs, so a common template alone ties nobody. The forests' components are the candidate groups.
4. Inside a group, collisions on the full shingle sets are counted exactly. A group is
   cut into blocks of about ``BLOCK_SHINGLES`` and every pair of blocks is a unit of
   work of its own, so a group of any size spreads over tasks. A unit returns a
   spanning forest of its confirmed links, never its pairs.
5. The links' components are spread over classes and documents.

Defined results: a null or empty text, or one without words, has no shingles and is
linked with nothing. Fewer words than a shingle takes are one shingle. Rows with a
null doc_id keep their counts, have no component and are kept. Repeated rows give
repeated results; a doc_id on several texts gets each text's own. Columns other than doc_id and
text play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.llm.components import components
from pulseline.llm.rows import packed, unpacked
from pulseline.llm.wordhash import lower_ascii, mix, ngrams, text_chunks, words_of

COORDINATES = 48
LOST = 1e-6
BLOCK_SHINGLES = 1 << 15
DENSE_CELLS = 1 << 22
LIST_PART = 2048

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, distinct shingle hashes of each row) for parts of a text column."""
    for row, end, data, bounds in text_chunks(column):
        words, cuts = words_of(lower_ascii(data), bounds)
        grams = ngrams(words, size)
        sets = []
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if last - first >= size:
                sets.append(np.unique(grams[first:last - size + 1]))
            elif last > first:
                sets.append(ngrams(words[first:last], last - first, salt=1000))
            else:
                sets.append(np.empty(0, np.uint64))
        yield row, sets


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, sets in shingle_sets(batch.column("text"), size):
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(counts)
                high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                signature = np.zeros((len(sets), COORDINATES), np.uint32)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    cuts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    high[full] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                    low[full] = np.add.reduceat(mix(every + np.uint64(0x14057B7EF767814F)), cuts)
                    for k, factor in enumerate(_MULTIPLIERS):
                        signature[full, k] = np.minimum.reduceat(every * factor, cuts) >> np.uint64(32)
                values = pa.array(signature.view(np.int32).ravel())
                at = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sets)), batch.column("text_key").slice(row, len(sets)), pa.array(counts),
                     pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.ListArray.from_arrays(at, values)],
                    names=["doc_id", "text_key", "n_shingles", "set_high", "set_low", "signature"])
    return run


def texts_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def signatures(docs: DataFrame, size: int = 3) -> DataFrame:
    return texts_of(docs).mapInArrow(
        _signatures(size), "doc_id long, text_key long, n_shingles long, set_high long, set_low long, signature array<int>")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node")
            for row, sets in shingle_sets(batch.column("text"), size):
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(at), values)], names=["node", "shingles"])
    return run


def match_threshold(similarity: float) -> int:
    """The most agreeing coordinates that a pair of this similarity reaches but for
    ``LOST`` of all such pairs; the number is binomial."""
    def short(n: int) -> float:
        return sum(math.comb(COORDINATES, k) * similarity ** k * (1 - similarity) ** (COORDINATES - k) for k in range(n))
    return max([1, *(n for n in range(COORDINATES) if short(n) <= LOST)])


def postings(reps: DataFrame, matches: int) -> DataFrame:
    """``reps``: node, signature. Returns (token, node, own) of the prefixes; ``own`` are all shared tokens of a node."""
    value = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    tokens = (reps.select("node", F.posexplode("signature").alias("place", "value"))
              .select("node", F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(value).alias("token")))
    # Aggregates are written before they meet their rows again, so that a hot key's join can be split.
    shared = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("posted")).where("posted > 1"), "tokens")
    ordered = (tokens.join(shared, "token").groupBy("node")
               .agg(F.sort_array(F.collect_list(F.struct("posted", "token"))).alias("own")).where(F.size("own") >= matches))
    prefix = F.slice("own", F.lit(1), F.size("own") - (matches - 1))
    return ordered.select(F.explode(prefix).alias("p"), "node", F.transform("own", lambda o: o["token"]).alias("own")).select("p.token", "node", "own")


def list_units(posted: DataFrame) -> DataFrame:
    """Postings of lists of two or more, cut into parts; a row for each pair of parts that it is in, pairs together."""
    lists = materialise(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                        .select("token", F.ceil(F.col("n") / LIST_PART).cast("long").alias("parts")), "lists")
    placed = (posted.join(lists, "token").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    return (placed.select("token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                          (F.col("part") > F.col("other")).alias("side"), "node", "own")
            .repartition("token", "low", "high").sortWithinPartitions("token", "low", "high"))


def collided(tokens: np.ndarray, side: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Of the rows of ``tokens`` (a coordinate each column; -1 - row where a row has none that is shared) a forest of the
    pairs that agree in ``matches`` columns or more; with two sides only pairs across them."""
    n, two_sided = len(tokens), bool(side.any())
    group, found = np.arange(n), []
    for row in range(n - 1):
        others = np.flatnonzero(group[row + 1:] != group[row]) + row + 1  # the rest is tied already
        if two_sided:
            others = others[side[others] != side[row]]
        if not len(others):
            continue
        hits = others[(tokens[others] == tokens[row]).sum(axis=1) >= matches]
        for other in hits.tolist():
            if group[other] != group[row]:
                found.append((row, other))
                group[group == group[other]] = group[row]
    return found


def _retained(matches: int):
    """Streams units of work that arrive sorted; holds one unit at a time."""
    def edges(nodes: list[int], sides: list[bool], own: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        tokens = np.repeat(-1 - np.arange(len(nodes), dtype=np.int64)[:, None], COORDINATES, axis=1)
        for row, held in enumerate(own):
            tokens[row, held >> 32] = held
        return [(nodes[a], nodes[b]) for a, b in collided(tokens, np.array(sides), matches)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [])
        for batch in batches:
            own = batch.column("own")
            cuts, values = own.offsets.to_numpy(), own.values.to_numpy()
            keys = zip(*(batch.column(k).to_pylist() for k in ("token", "low", "high")))
            found = []
            for k, (key, node, side) in enumerate(zip(keys, batch.column("node").to_pylist(), batch.column("side").to_pylist())):
                if key != unit:
                    found += edges(*held)
                    unit, held = key, ([], [], [])
                held[0].append(node)
                held[1].append(side)
                held[2].append(values[cuts[k]:cuts[k + 1]].copy())
            yield _edge_batch(found)
        yield _edge_batch(edges(*held))
    return run


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def retained_pairs(posted: DataFrame, matches: int) -> DataFrame:
    """(a, b): a forest, in each unit of work, of the nodes' pairs with ``matches`` collisions or more."""
    return list_units(posted).mapInArrow(_retained(matches), "a long, b long")


def _forest(adjacent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(root, others) of every connected set of more than one row."""
    waiting = adjacent.any(axis=1)
    while waiting.any():
        root = int(np.argmax(waiting))
        reached = np.zeros(len(waiting), dtype=bool)
        reached[root] = True
        edge = reached
        while edge.any():
            edge = adjacent[edge].any(axis=0) & ~reached
            reached |= edge
        waiting &= ~reached
        reached[root] = False
        yield root, np.flatnonzero(reached)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix of ``100 * intersection >= percent * union``; with two sides
    only pairs across them. Intersections are counted over the shingles that at least
    two of the sets hold, some columns at a time."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    shared = (held > 1)[column]
    owner, column = owner[shared], number[column[shared]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, DENSE_CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, last, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), min(width, last - first)), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    result = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if side.any():
        result &= side[:, None] != side[None, :]
    np.fill_diagonal(result, False)
    return result


def _confirm(percent: int):
    """Streams units of work that arrive sorted by ``unit``; holds one unit at a time."""
    def edges(ids: list[int], sides: list[bool], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(ids) > 1:
            names = np.array(ids, dtype=np.int64)
            for root, others in _forest(linked(sets, np.array(sides), percent)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(others), names[root])), pa.array(names[others])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [])
        for batch in batches:
            sets = batch.column("shingles")
            cuts, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            keys = zip(*(batch.column(k).to_pylist() for k in ("cluster", "low", "high")))
            rows = zip(keys, batch.column("node").to_pylist(), batch.column("side").to_pylist())
            for k, (key, doc_id, side) in enumerate(rows):
                if key != unit:
                    yield from edges(*held)
                    unit, held = key, ([], [], [])
                held[0].append(doc_id)
                held[1].append(side)
                held[2].append(values[cuts[k]:cuts[k + 1]].copy())
        yield from edges(*held)
    return run


def confirmed_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``clusters``: (node, cluster); ``sets``: (node, shingles). Returns (a, b),
    a spanning forest of all links inside each unit of work."""
    members = clusters.join(sets.select("node", F.size("shingles").alias("n")), "node")
    blocks = materialise(members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks")), "blocks")
    placed = (clusters.join(blocks, "cluster")
              .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("node", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                      (F.col("block") > F.col("other")).alias("side")))
    units = (placed.join(sets, "node").select("cluster", "low", "high", "side", "node", "shingles")
             .repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high"))
    return units.mapInArrow(_confirm(percent), "a long, b long")


def all_of(tied: DataFrame) -> DataFrame:
    """(node, component) of ``components`` with the smallest nodes too."""
    return tied.unionByName(tied.select(F.col("component").alias("node"), "component").distinct())


def grouped(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, ``group`` (names the component of the text; null without
    shingles) and component_id, the smallest doc_id reachable by links."""
    texts = texts_of(docs)
    signed = materialise(signatures(texts, size), "signatures")
    key = ["set_high", "set_low", "n_shingles"]
    classes = materialise(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("signature").alias("signature"))
        .select(*key, F.xxhash64(*key).alias("node"), "rep.*", "signature"), "classes")
    matches = match_threshold(percent / 100)
    posted = materialise(postings(classes.select("node", "signature"), matches), "postings")
    clusters = materialise(all_of(components(retained_pairs(posted, matches), "a", "b")).withColumnRenamed("component", "cluster"), "clusters")
    wanted = materialise(classes.select("node", "doc_id", "text_key").join(clusters, "node", "left_semi"), "wanted")
    # Ids alone first: the texts that go on to a shuffle are those of candidates.
    met = texts.join(materialise(wanted.select("doc_id").distinct(), "wanted_ids"), "doc_id", "left_semi")
    sets = materialise(met.join(wanted, ["doc_id", "text_key"]).select("node", "text").mapInArrow(_sets(size), "node long, shingles array<long>")
                       .dropDuplicates(["node"]), "sets")
    tied = materialise(all_of(components(confirmed_links(clusters, sets, percent), "a", "b")), "tied")
    members = materialise(tied.join(classes.select("node", "doc_id"), "node"), "members")
    least = materialise(members.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    linked = materialise(members.join(least, "component").select("node", "component", "least"), "linked")
    found = materialise(classes.join(linked, "node", "left").select(
        *key, F.coalesce("component", "node").alias("group"), F.coalesce("least", "doc_id").alias("least")), "found")
    return (signed.drop("signature").join(found, key, "left")
            .select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links) and kept (whether that is the document's own)."""
    return grouped(docs, size, percent).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group one, that of the smallest doc_id (then the smallest hash of its
    text); of rows alike in doc_id and text one, the smallest by a hash of the rest. Rows without shingles
    are groups of their own, rows without doc_id stay. Texts that share a doc_id and nothing else all stay."""
    rated = grouped(docs, size, percent).where("doc_id is not null")
    alone = rated.where("group is null").select("doc_id", "text_key").distinct()
    first = rated.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    chosen = materialise(alone.unionByName(first), "chosen")
    rows = packed(docs, "doc_id", "text").withColumns({"text_key": F.xxhash64(F.col("text").cast("string")), "long_id": F.col("doc_id").cast("long")})
    kept = rows.where("long_id is not null").join(
        chosen.withColumnRenamed("doc_id", "long_id"), ["long_id", "text_key"], "left_semi").groupBy("long_id", "text_key").agg(
        F.min_by(F.struct("doc_id", "text", "rest"), F.xxhash64(F.to_json("rest"))).alias("row")).select("row.*")
    every = kept.unionByName(rows.where("long_id is null").select("doc_id", "text", "rest"))
    return unpacked(every, docs.columns, ["doc_id", "text"], [])
