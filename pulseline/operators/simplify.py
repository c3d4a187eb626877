"""Line simplification by triangle size (Visvalingam), for polylines of any length.

Vertices go in the order of their triangle with the two remaining neighbours,
until every triangle has at least the wanted area. A vertex never counts as
smaller than one removed next to it before. Equal sizes go in order of ``depth``
(steps since the size was set by a triangle) and place, which makes the order of
removals a total one that can be told from the neighbourhood alone.

A polyline longer than ``chunk_points`` is cut into chunks. What a chunk needs to
know of the next one is only which vertex lies across the border after each
removal there: a short list. All chunks run in parallel with the lists they
have, hand on their own, and run again until no list changes; since a removal
depends only on earlier ones, the lists then are those of one sequential run.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.operators.ordered import running_number

SHAPE = ["lineid", "direction"]
CHUNK_POINTS = 20_000
SEQ_BUCKET = 4096
# A removal's place in time, and the vertex that is at the border after it.
Step = tuple[float, int, int, float, float]
OUT = ("lineid string, direction string, chunk long, kind string, step long, level double, depth int, idx long, "
       "x double, y double")


def thin_out(xs: Sequence[float], ys: Sequence[float], min_area: float, first_idx: int = 0,
             left: Sequence[Step] = (), right: Sequence[Step] = ()) -> tuple[list[int], list[Step], list[Step]]:
    """(kept positions, border list for the left neighbour, for the right one).

    ``left`` and ``right`` list the vertices across the borders, the first entry
    being the one there at the start; empty where the polyline ends.
    """
    n = len(xs)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    gone, key = [False] * n, [None] * n
    border = [left[0][3:] if left else None, right[0][3:] if right else None]
    waiting = sorted([(s[:3], 0, s[3:]) for s in left[1:]] + [(s[:3], 1, s[3:]) for s in right[1:]])
    first, last = 0, n - 1
    shown = ([(-1.0, 0, -1, xs[0], ys[0])], [(-1.0, 0, -1, xs[-1], ys[-1])])
    queue: list[tuple[float, int, int]] = []

    def at(i: int):
        return border[0] if i < 0 else border[1] if i >= n else (xs[i], ys[i])

    def judge(i: int, now: tuple[float, int, int] | None) -> None:
        a, b = at(before[i]), at(after[i])
        if a is None or b is None:
            return
        size = abs((xs[i] - a[0]) * (b[1] - a[1]) - (b[0] - a[0]) * (ys[i] - a[1])) / 2
        key[i] = (size, 0, i + first_idx) if now is None or size > now[0] else (now[0], now[1] + 1, i + first_idx)
        if size < min_area:
            heapq.heappush(queue, key[i])

    for i in range(n):
        judge(i, None)
    turn = 0
    while True:
        while queue and (gone[queue[0][2] - first_idx] or key[queue[0][2] - first_idx] != queue[0]):
            heapq.heappop(queue)
        if turn < len(waiting) and (not queue or waiting[turn][0] < queue[0]):
            now, side, place = waiting[turn]
            turn += 1
            border[side] = place
            if first > last:
                shown[1 - side].append((*now, *place))
            else:
                judge(first if side == 0 else last, now)
            continue
        if not queue:
            break
        now = heapq.heappop(queue)
        i = now[2] - first_idx
        gone[i] = True
        a, b = before[i], after[i]
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
        was_first, was_last = i == first, i == last
        first, last = (b if was_first else first), (a if was_last else last)
        if was_first:
            shown[0].append((*now, *at(b)))
        if was_last:
            shown[1].append((*now, *at(a)))
        for j in (a, b):
            if 0 <= j < n:
                judge(j, now)
    return [i for i in range(n) if not gone[i]], shown[0], shown[1]


def _steps(frame: pd.DataFrame, kind: str) -> list[Step]:
    own = frame[frame["kind"] == kind].sort_values("step")
    return list(zip(own["level"], own["depth"], own["idx"], own["x"], own["y"]))


def _thin_chunk(min_area: float):
    def thin(points: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("idx", ignore_index=True)
        kept, to_left, to_right = thin_out(
            points["x"].tolist(), points["y"].tolist(), min_area, int(points["idx"].iloc[0]),
            _steps(lists, "right"), _steps(lists, "left"))
        rows = [("kept", 0, 0.0, 0, int(points["idx"].iloc[i]), points["x"].iloc[i], points["y"].iloc[i]) for i in kept]
        rows += [("left", s, *step) for s, step in enumerate(to_left)]
        rows += [("right", s, *step) for s, step in enumerate(to_right)]
        out = pd.DataFrame(rows, columns=["kind", "step", "level", "depth", "idx", "x", "y"])
        for position, name in enumerate([*SHAPE, "chunk"]):
            out.insert(position, name, points[name].iloc[0])
        return out

    return thin


def _delivered(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """A "left" list goes to the chunk before, a "right" list to the one after;
    those past the polyline's ends go nowhere."""
    target = F.when(F.col("kind") == "left", F.col("chunk") - 1).otherwise(F.col("chunk") + 1)
    return lists.where("kind <> 'kept'").withColumn("chunk", target).join(chunks, [*SHAPE, "chunk"], "left_semi")


def simplify(points: DataFrame, min_area: float, chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """Surviving vertices of each (lineid, direction): ``idx`` from 0 along the
    original, x, y. ``points``: lineid, direction, seq, x, y."""
    numbered = running_number(points.withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET)), SHAPE, "_bucket",
                              ["seq"], "idx").select(*SHAPE, (F.col("idx") - 1).alias("idx"), "x", "y")
    chunked = materialise(numbered.withColumn("chunk", F.floor(F.col("idx") / chunk_points)), "simplify-points")
    chunks = chunked.select(*SHAPE, "chunk").distinct()
    key = [*SHAPE, "chunk"]
    ends = chunked.groupBy(*key).agg(F.min_by(F.struct("x", "y"), "idx").alias("left"),
                                     F.max_by(F.struct("x", "y"), "idx").alias("right"))
    initial = ends.unpivot(key, ["left", "right"], "kind", "v").select(
        *key, "kind", F.lit(0).cast("long").alias("step"), F.lit(-1.0).alias("level"), F.lit(0).alias("depth"),
        F.lit(-1).cast("long").alias("idx"), "v.x", "v.y")
    lists = _delivered(initial, chunks)

    def run(these: DataFrame, with_lists: DataFrame) -> DataFrame:
        # Both sides come from the same table; fresh names keep them apart.
        with_lists = with_lists.select(*[F.col(c).alias(c) for c in with_lists.columns])
        return these.groupBy(*key).cogroup(with_lists.groupBy(*key)).applyInPandas(_thin_chunk(min_area), OUT)

    if chunks.where("chunk > 0").isEmpty():
        return run(chunked, lists).where("kind = 'kept'").select(*SHAPE, "idx", "x", "y")
    lists = materialise(lists, "simplify-lists")
    latest = materialise(run(chunked, lists), "simplify-round")
    while True:
        found = materialise(_delivered(latest, chunks), "simplify-lists")
        changed = materialise(
            lists.exceptAll(found).unionByName(found.exceptAll(lists)).select(*key).distinct(), "simplify-changed")
        if changed.isEmpty():
            return latest.where("kind = 'kept'").select(*SHAPE, "idx", "x", "y")
        again = run(chunked.join(changed, key, "left_semi"), found.join(changed, key, "left_semi"))
        latest = materialise(latest.join(changed, key, "left_anti").unionByName(again), "simplify-round")
        lists = found
