"""Prefix trie of conversations, rolled up by centroid decomposition.

1. Conversations are put in order by turn (null first; ties by role, then text) and, for
   ``rebuilt``, start with turns of another one: conversation c takes the first h turns of
   c - c % ``SHARE``, then its own after its first h, h = CRC-32 of its decimal number modulo ``MOST``.
2. A node is a distinct sequence of first turns. Its key is its depth and two running sums, of 60 bits a
   turn each, over hashes of (place, role, text). Numbers and sums run in ranges of
   ``TURNS_IN_A_RANGE`` turns joined by one row a range, so a conversation of any length spreads over tasks.
3. Members, children and ends are plain groupings of (conversation, depth) rows.
4. Sums over subtrees come from a centroid decomposition of the parent-edge forest. A node
   weighs as much as it has members, so the weight of its subtree is known without a rollup: what its
   members still have to say from there on. In a component of weight W the nodes whose subtree
   weighs more than W / 2 are a chain from the top; its last one is the centroid. The total of the
   centroid's subtree inside the component is added to every node of that chain; then the component falls into
   the subtrees below the centroid and the rest around it, none heavier than W / 2, so there are
   log2(W) rounds whatever the trie's depth. Components of more than ``TASK_NODES`` nodes are split so in
   Spark, all at once, round by round; smaller ones are split on in the same way in arrays inside tasks.
5. ``ends_sha256``: ids that end at a node are joined in ranges of ``IDS_IN_A_RANGE`` numbers; one running
   hash a node reads these pieces in order, so no list of ids is held.

Defined results: rows with a null conv_id take no part. A null role or text counts as empty. Equal
rows are as many turns. An empty table has no node. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.operators.ordered import running_number

SHARE, MOST = 5, 9
TURNS_IN_A_RANGE = 4096
IDS_IN_A_RANGE = 4096
TASK_NODES = 1 << 14


def node_key(depth: Column, *sums: Column) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]))


#: The key of depth 0, both sums 0.
ROOT = hashlib.md5(b"0:0:0").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): turns of each conversation, numbered from 0."""
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(turn / TURNS_IN_A_RANGE), F.lit(-(1 << 63)).cast("long")).alias("range"))
    numbered = running_number(rows, ["conv_id"], "range", [F.col("turn").asc_nulls_first(), "role", "text"], "place")
    return numbered.select("conv_id", (F.col("place") - 1).alias("place"), "role", "text")


def taken_over() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation took the first ones of another: (conv_id, place, role, text),
    and all conversations (conv_id), those left without a turn too."""
    conversations = numbered.select("conv_id").distinct()
    borrowers = conversations.select("conv_id", taken_over().alias("taken"), (F.col("conv_id") - F.col("conv_id") % SHARE).alias("lender"))
    # Only the first turns of lenders are lent, each to at most 2 * SHARE - 1 conversations.
    first = numbered.where((F.col("conv_id") % SHARE == 0) & (F.col("place") < MOST)).withColumnRenamed("conv_id", "lender")
    borrowed = first.join(borrowers, "lender").where("place < taken").select("conv_id", "place", "role", "text")
    own = numbered.where(F.col("place") >= taken_over())
    # What follows is shifted down where the lender was short.
    lent = borrowed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lent"))
    own = own.join(lent, "conv_id", "left").select(
        "conv_id", (F.col("place") - taken_over() + F.coalesce("lent", F.lit(0))).alias("place"), "role", "text")
    return borrowed.unionByName(own), conversations


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes) of each turn: the prefix that it ends, and its own text's bytes."""
    told = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.length(F.col("role").cast("binary")).cast("string"), F.lit(":"), "role", "text"))
    short = sequences.select("conv_id", "place", F.floor(F.col("place") / TURNS_IN_A_RANGE).alias("range"), told.alias("told"),
                             F.length(F.col("text").cast("binary")).cast("long").alias("bytes"))
    halves = {name: F.conv(F.substring("told", first, 15), 16, 10).cast("decimal(20,0)") for name, first in (("a", 1), ("b", 16))}
    short = materialise(short.withColumns(halves).drop("told"), "turn_hashes")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = short.groupBy("conv_id", "range").agg(F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b")).select(
        "conv_id", "range", *[F.coalesce(F.sum(f"sum_{k}").over(earlier), F.lit(0)).cast("decimal(38,0)").alias(f"before_{k}") for k in "ab"])
    inside = Window.partitionBy("conv_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = short.withColumns({f"above_{k}": F.coalesce(F.sum(k).over(inside), F.lit(0)).cast("decimal(30,0)") for k in "ab"})
    summed = summed.join(before, ["conv_id", "range"]).select(
        "conv_id", "place", "bytes", "a", "b", *[(F.col(f"before_{k}") + F.col(f"above_{k}")).cast("decimal(38,0)").alias(f"above_{k}") for k in "ab"])
    return summed.select(
        "conv_id", (F.col("place") + 1).alias("depth"),
        node_key(F.col("place") + 1, *[(F.col(f"above_{k}") + F.col(k)).cast("decimal(38,0)") for k in "ab"]).alias("node"),
        node_key(F.col("place"), F.col("above_a"), F.col("above_b")).alias("parent"), "bytes")


def nodes(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: node, parent, depth, conv_id (smallest member), n_convs, ``weight`` (sum of n_convs over
    the subtree), n_children, ``leaf`` and ``saved`` (its own part of the two sums)."""
    lengths = materialise(steps.groupBy("conv_id").agg(F.max("depth").alias("length")), "lengths")
    members = steps.join(lengths, "conv_id").select("node", "parent", "depth", "conv_id", "bytes", F.expr("length - depth + 1").alias("weight"))
    top = conversations.join(lengths, "conv_id", "left").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id",
        F.lit(0).cast("long").alias("bytes"), (F.coalesce("length", F.lit(0)) + 1).cast("long").alias("weight"))
    every = materialise(members.unionByName(top).groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("weight").alias("weight"), F.min("bytes").alias("bytes")), "members")
    children = materialise(every.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    return every.join(children, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", "weight", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


def under_centroid(rows: np.ndarray, parent: np.ndarray, part: np.ndarray, depth: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """For each of ``rows``, all deeper than ``centroid`` (a row each, that of their component), the child of
    the centroid that it is under or is; -1 if it is not under it. By pointer doubling."""
    n = len(parent)
    jump = np.full(n + 1, n)
    above = parent[rows]
    is_child = above == centroid
    inside = (above >= 0) & (part[above] == part[rows]) & (depth[above] > depth[centroid])
    jump[rows] = np.where(is_child, rows, np.where(inside, above, n))
    while True:
        further = jump[jump[rows]]
        if np.array_equal(further, jump[rows]):
            return np.where(further == n, -1, further)
        jump[rows] = further


def split_all(part: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Subtree sums inside components. ``part``: the component of each row, ``parent``: row of the
    parent or -1 at a top, ``weight``: that of the subtree, ``sums``: own values (rows x columns).
    All components are split at once, round by round, until none is left."""
    n = len(part)
    total, part, weight = np.zeros_like(sums), part.copy(), weight.copy()
    open_rows = np.arange(n)
    _, part = np.unique(part, return_inverse=True)
    while len(open_rows):
        names, group = np.unique(part[open_rows], return_inverse=True)
        whole = np.zeros(len(names), weight.dtype)
        np.maximum.at(whole, group, weight[open_rows])
        heavy = 2 * weight[open_rows] > whole[group]
        chain, chain_group = open_rows[heavy], group[heavy]
        order = np.lexsort((depth[chain], chain_group))
        last = np.append(chain_group[order][1:] != chain_group[order][:-1], True)
        centroid = np.empty(len(names), dtype=np.int64)
        centroid[chain_group[order][last]] = chain[order][last]
        head = np.full(n, -1)
        deeper = depth[open_rows] > depth[centroid[group]]
        head[open_rows[deeper]] = under_centroid(open_rows[deeper], parent, part, depth, centroid[group[deeper]])
        under = open_rows[head[open_rows] >= 0]
        counted = np.append(under, centroid)
        counted_group = np.append(group[head[open_rows] >= 0], np.arange(len(names)))
        gained = np.zeros((len(names), sums.shape[1]), sums.dtype)
        np.add.at(gained, counted_group, sums[counted])
        lost = weight[centroid]
        total[chain] += gained[chain_group]
        weight[chain] -= lost[chain_group]
        part[under] = n + head[under]
        closed = np.zeros(n, dtype=bool)
        closed[centroid] = True
        open_rows = open_rows[~closed[open_rows]]
    return total


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams components that arrive one after the other; holds about ``TASK_NODES`` nodes beyond one component."""
    def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = rows.column("node").to_pylist()
        place = {name: k for k, name in enumerate(names)}
        parts = rows.column("part").to_pylist()
        number = {name: k for k, name in enumerate(dict.fromkeys(parts))}
        part = np.array([number[p] for p in parts], dtype=np.int64)
        parent = np.array([place.get(p, -1) for p in rows.column("parent").to_pylist()], dtype=np.int64)
        depth, weight = (rows.column(k).to_numpy() for k in ("depth", "weight"))
        parent[(parent >= 0) & (part[parent] != part)] = -1
        sums = np.stack([rows.column(k).to_numpy() for k in ("leaf", "saved")], axis=1)
        found = split_all(part, parent, depth, weight, sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(found[:, 0] + rows.column("more_leaves").to_numpy()),
             pa.array(found[:, 1] + rows.column("more_saved").to_numpy())], names=["node", "n_leaves", "saved_tokens"])

    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        kept = rows if kept is None else pa.concat_tables([kept, rows])
        if len(kept) >= TASK_NODES:
            kept = kept.combine_chunks()
            last = kept.column("part")[-1].as_py()
            parts = kept.column("part").to_pylist()
            cut = parts.index(last)
            if cut:
                yield from finish(kept.slice(0, cut))
                kept = kept.slice(cut)
    if kept is not None and len(kept):
        yield from finish(kept.combine_chunks())


def rolled_up(forest: DataFrame, steps: DataFrame, task_nodes: int | None = None) -> DataFrame:
    """(node, n_leaves, saved_tokens), sums of ``leaf`` and ``saved`` over subtrees. ``forest`` has the columns of
    ``nodes``; ``steps`` has (conv_id, depth, node) of every prefix, to tell which of a centroid's children a node is under."""
    task_nodes = task_nodes or TASK_NODES
    columns = ["node", "parent", "depth", "conv_id", "weight", "leaf", "saved"]
    now = materialise(forest.select(*columns, F.lit(ROOT).alias("part"), F.lit(0).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved")), "part")
    done, small = [], []
    while True:
        sizes = materialise(now.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("whole")), "sizes")
        small.append(now.join(sizes.where(F.col("size") <= task_nodes).select("part"), "part", "left_semi").select(*now.columns))
        large = sizes.where(F.col("size") > task_nodes).select("part", "whole")
        if not large.limit(1).count():
            break
        now = materialise(now.join(large, "part").withColumn("heavy", F.expr("2 * weight > whole")), "large")
        centroid = materialise(now.where("heavy").groupBy("part").agg(F.max_by(F.struct("node", "depth", "weight"), "depth").alias("c"))
                               .select("part", F.col("c.node").alias("centroid"), F.col("c.depth").alias("centre"), F.col("c.weight").alias("lost")), "centroids")
        placed = now.join(centroid, "part")
        # Which node a node's smallest member passed at the centroid's depth, and which one came next.
        deeper = placed.where("depth > centre").select("node", "conv_id", "centre", "centroid")
        passed = steps.select("conv_id", (F.col("depth") - 1).alias("centre"), F.col("parent").alias("passed"), F.col("node").alias("under"))
        through = materialise(deeper.join(passed, ["conv_id", "centre"]).where("passed = centroid").select("node", "under"), "through")
        placed = materialise(placed.join(through, "node", "left"), "placed")
        gained = materialise(placed.where("under is not null or node = centroid").groupBy("part").agg(
            F.sum("leaf").alias("gained_leaves"), F.sum("saved").alias("gained_saved")), "gained")
        after = placed.join(gained, "part").withColumns({
            "more_leaves": F.expr("more_leaves + if(heavy, gained_leaves, 0)"), "more_saved": F.expr("more_saved + if(heavy, gained_saved, 0)"),
            "weight": F.expr("weight - if(heavy, lost, 0)"), "part": F.coalesce("under", "part")})
        after = materialise(after, "after")
        done.append(after.where("node = centroid").select("node", F.col("more_leaves").alias("n_leaves"), F.col("more_saved").alias("saved_tokens")))
        now = after.where("node <> centroid").select(*columns, "part", "more_leaves", "more_saved")
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    found = rest.repartition("part").sortWithinPartitions("part").mapInArrow(_small, "node string, n_leaves long, saved_tokens long")
    for more in done:
        found = found.unionByName(more)
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over pieces of ids that arrive in order; holds one hash."""
    node, state = None, None
    for batch in batches:
        names, found = [], []
        for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if now != node:
                if state is not None:
                    names.append(node)
                    found.append(state.hexdigest())
                node, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end."""
    last = steps.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    ending = conversations.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(ROOT)).alias("node"))
    ranges = ending.groupBy("node", F.floor(F.col("conv_id") / IDS_IN_A_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = ranges.select("node", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "range").mapInArrow(_digests, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, task_nodes: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences, every = rebuilt(materialise(turns(conversations), "turns"))
    every = materialise(every, "conversations")
    steps = materialise(prefixes(sequences), "steps")
    forest = materialise(nodes(steps, every), "nodes")
    sums = materialise(rolled_up(forest, steps, task_nodes), "sums")
    ending = materialise(ends(steps, every), "ends")
    above = forest.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (forest.join(sums, "node").join(ending, "node", "left").join(above, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
