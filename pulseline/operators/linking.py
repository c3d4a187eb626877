"""Linking anonymous pings into trips: each ping, in time order, extends the
nearest open trip of its line and direction that is at most 300 s and 500 m
behind, the oldest one on a tie, or opens a new trip.

The rule is sequential per (line, direction), yet no task holds a whole one:

* No trip crosses a pause longer than the time limit, so every line-direction
  falls into independent islands. They are found on counts per minute, not by
  sorting the pings of a line in one place.
* An island larger than ``chunk_rows`` is cut into chunks along time. All chunks
  are linked in parallel, each first assuming that nothing is open at its start;
  then every chunk whose predecessor ends with other open trips than it assumed
  is linked again with those. When nothing changes any more, the result is
  the sequential one: chunk 1 is right from the start, and chunk n is right as
  soon as chunk n-1 is. Greedy links forget their start within a few
  minutes, so two or three rounds do.
* A task streams its sorted rows and keeps only the open trips in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.functions import ids

# How far and how long a ping may be from the trip it extends;
# Earth radius of the great-circle formula.
MATCH_RADIUS_M = 500.0
MATCH_WINDOW_S = 300.0
EARTH_RADIUS_M = 6_371_000.0
CHUNK_ROWS = 200_000
# About a minute of work; a task streams its chunks one after the other.
TASK_ROWS = 5_000_000
SLOT_US = 60 * 1_000_000

ISLAND = ["lineid", "direction", "island"]
CHUNK = [*ISLAND, "piece"]
# Rounds after which the pieces of earlier rounds are written as one table again.
ROUNDS_PER_REWRITE = 6
ORDER = [*CHUNK, "kind", "rank", "us", "lon", "lat", "position_id"]
# kind: 0 = trip open at the chunk's start, 1 = ping, 2 = trip open at its end.
OPEN = ["lineid", "direction", "rank", "us", "lon", "lat", "position_id", "head"]
LINKED = ("lineid string, direction int, island long, piece long, kind int, rank long, us long, "
          "lon double, lat double, position_id string, head string, carried boolean")


class OpenTrips:
    """Open trips of one line-direction in a grid of match-radius cells."""

    def __init__(self, radius_m: float, window_us: int):
        self.radius_m = radius_m
        self.window_us = window_us
        self.cell_lat = math.degrees(radius_m / EARTH_RADIUS_M) * 1.001
        self.widest_lat = -1.0
        self.cell_lon = 0.0
        self.cells: dict[tuple[int, int], list[list]] = {}
        self.opened = 0

    def _cell(self, lon: float, lat: float) -> tuple[int, int]:
        # A column must be as wide as the radius at the highest latitude seen.
        if abs(lat) > self.widest_lat:
            self.widest_lat = min(abs(lat) + 0.5, 89.5)
            self.cell_lon = self.cell_lat / math.cos(math.radians(self.widest_lat)) * 1.001
            trips = [t for cell in self.cells.values() for t in cell]
            self.cells = {}
            for t in trips:
                self.cells.setdefault(self._cell(t[2], t[3]), []).append(t)
        return math.floor(lon / self.cell_lon), math.floor(lat / self.cell_lat)

    def open(self, us: int, lon: float, lat: float, ping: str, carried: bool) -> list:
        """A trip is [order, us, lon, lat, last ping, head ping, carried]."""
        trip = [self.opened, us, lon, lat, ping, ping, carried]
        self.opened += 1
        cell = self._cell(lon, lat)
        self.cells.setdefault(cell, []).append(trip)
        return trip

    def place(self, us: int, lon: float, lat: float, ping: str) -> list:
        """The trip this ping now belongs to."""
        cx, cy = self._cell(lon, lat)
        oldest, cells = us - self.window_us, self.cells
        best, best_m, best_cell = None, math.inf, None
        for x in (cx - 1, cx, cx + 1):
            for y in (cy - 1, cy, cy + 1):
                cell = cells.get((x, y))
                if not cell:
                    continue
                expired = False
                for t in cell:
                    if t[1] < oldest:
                        expired = True
                    elif t[1] < us and abs(t[3] - lat) <= self.cell_lat and abs(t[2] - lon) <= self.cell_lon:
                        metres = distance_m(t[2], t[3], lon, lat)
                        if metres <= self.radius_m and (
                                metres < best_m or (metres == best_m and t[0] < best[0])):
                            best, best_m, best_cell = t, metres, cell
                if expired:
                    cell[:] = [t for t in cell if t[1] >= oldest]
        if best is None:
            return self.open(us, lon, lat, ping, False)
        best_cell.remove(best)
        best[1:5] = us, lon, lat, ping
        cells.setdefault((cx, cy), []).append(best)
        return best

    def still_open(self, last_us: int) -> list[list]:
        alive = [t for cell in self.cells.values() for t in cell if t[1] >= last_us - self.window_us]
        return sorted(alive, key=lambda t: t[0])


def distance_m(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Great-circle metres; the same formula as ``geo.haversine_m``."""
    s_lat = math.sin(math.radians(lat2 - lat1) / 2)
    s_lon = math.sin(math.radians(lon2 - lon1) / 2)
    chord = s_lat * s_lat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * s_lon * s_lon
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(chord))


def _linker(radius_m: float, window_us: int):
    names = [field.split()[0] for field in LINKED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(),
             pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, types)))

    def chunk_starts(batch: pa.RecordBatch) -> list[int]:
        lines = batch.column("lineid").dictionary_encode().indices.to_numpy()
        fresh = np.ones(batch.num_rows, dtype=bool)
        fresh[1:] = lines[1:] != lines[:-1]
        for name in CHUNK[1:]:
            values = batch.column(name).to_numpy()
            fresh[1:] |= values[1:] != values[:-1]
        return [*np.flatnonzero(fresh).tolist(), batch.num_rows]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, trips, last_us = None, None, None
        ends: list[tuple] = []

        def close() -> None:
            if last_us is not None:
                ends.extend((*chunk, 2, i, *t[1:]) for i, t in enumerate(trips.still_open(last_us)))

        def taken_ends() -> pa.RecordBatch:
            columns = list(zip(*ends)) if ends else [[] for _ in names]
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            heads, carried = [], []
            columns = [batch.column(name).to_pylist() for name in ("kind", "us", "lon", "lat", "position_id")]
            starts = chunk_starts(batch)
            for start, stop in zip(starts, starts[1:]):
                here = tuple(batch.column(name)[start].as_py() for name in CHUNK)
                if here != chunk:
                    close()
                    chunk, trips, last_us = here, OpenTrips(radius_m, window_us), None
                for kind, us, lon, lat, ping in zip(*[c[start:stop] for c in columns]):
                    if kind == 0:
                        trips.open(us, lon, lat, ping, True)
                        continue
                    trip = trips.place(us, lon, lat, ping)
                    last_us = us
                    heads.append(trip[5])
                    carried.append(trip[6])
            pings = batch.filter(pc.equal(batch.column("kind"), 1))
            yield pa.RecordBatch.from_arrays(
                [*[pings.column(n).cast(t) for n, t in zip(names[:-2], types)], pa.array(heads, pa.string()),
                 pa.array(carried, pa.bool_())], schema=schema)
            if ends:
                yield taken_ends()
        close()
        yield taken_ends()

    return link


def plan_chunks(pings: DataFrame, window_us: int, chunk_rows: int) -> DataFrame:
    """(lineid, direction, slot) -> (island, piece, n), from counts per slot."""
    line = Window.partitionBy("lineid", "direction").orderBy("slot")
    island = Window.partitionBy("lineid", "direction", "island").orderBy("slot")
    pause = F.col("first_us") - F.lag("last_us").over(line) > window_us
    return (
        pings.groupBy("lineid", "direction", "slot")
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .withColumn("_cut", F.when(pause, 1).otherwise(0))
        .withColumn("island", F.sum("_cut").over(line))
        .withColumn("_before", F.coalesce(
            F.sum("n").over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_full", F.floor(F.col("_before") / chunk_rows))
        .withColumn("piece", F.dense_rank().over(
            Window.partitionBy("lineid", "direction", "island").orderBy("_full")).cast("long") - 1)
        .select("lineid", "direction", "slot", "island", "piece", "n")
    )


def _entries_after(ends: DataFrame) -> DataFrame:
    """What is open at a chunk's end is open at the start of the next one."""
    return ends.where("kind = 2").select(
        "lineid", "direction", "island", (F.col("piece") + 1).alias("piece"), F.lit(0).alias("kind"), "rank",
        "us", "lon", "lat", "position_id")


def link_pings(positions: DataFrame, chunk_rows: int = CHUNK_ROWS, radius_m: float = MATCH_RADIUS_M,
               window_s: float = MATCH_WINDOW_S) -> DataFrame:
    """Each located ping with the ``head``: the first ping of its trip.

    ``positions`` must have unique position ids. Equal times are ordered by
    (lon, lat, position_id).
    """
    linked, _ = link_onto(positions, None, chunk_rows, radius_m, window_s)
    return linked


def link_onto(positions: DataFrame, open_trips: DataFrame | None, chunk_rows: int = CHUNK_ROWS,
              radius_m: float = MATCH_RADIUS_M, window_s: float = MATCH_WINDOW_S) -> tuple[DataFrame, DataFrame]:
    """Links pings that all come after ``open_trips`` (columns of OPEN, one row
    per open trip and its last ping). Returns the linked pings and the trips open
    at the end of every line-direction that had pings."""
    window_us = int(window_s * 1_000_000)
    pings = (
        positions.where("lon is not null and lat is not null")
        .select("lineid", "direction", "position_id", F.unix_micros("fetched_at").alias("us"), "lon", "lat")
        .withColumn("slot", F.floor(F.col("us") / SLOT_US))
    )
    plan = materialise(plan_chunks(pings, window_us, chunk_rows), "link-plan")
    rows = (
        pings.join(plan.drop("n"), ["lineid", "direction", "slot"])
        .select(*CHUNK, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rank"), "us", "lon", "lat", "position_id")
    )
    given = None
    if open_trips is not None:
        first = F.lit(0).cast("long")
        given = open_trips.join(plan.select("lineid", "direction").distinct(), ["lineid", "direction"], "left_semi").select(
            "lineid", "direction", first.alias("island"), first.alias("piece"), F.lit(0).alias("kind"),
            "rank", "us", "lon", "lat", "position_id")

    # The work per byte is high, so tasks are sized by rows, not merged by bytes.
    total = plan.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_ROWS))

    def run(df: DataFrame) -> DataFrame:
        return (df.repartition(tasks, *CHUNK).sortWithinPartitions(*ORDER)
                .mapInArrow(_linker(radius_m, window_us), LINKED))

    def finished(linked: DataFrame) -> DataFrame:
        return _resolve_heads(materialise(linked, "linked", "kind"), open_trips)

    split = materialise(plan.where("piece > 0").select(*ISLAND).distinct(), "link-split-islands")
    everything = rows if given is None else rows.unionByName(given)
    if split.isEmpty():
        linked = run(everything)
        linked = linked if given is None else finished(linked)
    else:
        whole = run(everything.join(split, ISLAND, "left_anti"))
        parts = materialise(rows.join(split, ISLAND, "left_semi"), "link-parts")
        part_entries = parts.limit(0) if given is None else given.join(split, ISLAND, "left_semi")
        linked = (whole if given is None else finished(whole)).unionByName(
            finished(_link_in_rounds(parts, part_entries, run)))
    last = plan.groupBy("lineid", "direction").agg(F.max(F.struct("island", "piece")).alias("_l")).select(
        "lineid", "direction", "_l.island", "_l.piece")
    still_open = linked.where("kind = 2").join(last, CHUNK, "left_semi").select(*OPEN)
    return linked.where("kind = 1").select("lineid", "direction", "us", "lon", "lat", "position_id", "head"), still_open


def _link_in_rounds(rows: DataFrame, given: DataFrame, run) -> DataFrame:
    """Links the chunks of split islands until their borders agree. A round writes
    only the chunks it ran; the others are read from where they were written."""
    given = materialise(given, "link-given")
    pieces = rows.select(*CHUNK).distinct()
    entries = given
    latest = materialise(run(rows.unionByName(entries)), "link-round", "kind")
    for number in range(1, rows.agg(F.max("piece")).first()[0] + 2):
        found = materialise(
            _entries_after(latest).join(pieces, CHUNK, "left_semi").select(*rows.columns).unionByName(given),
            "link-entries")
        # The same ping at the same rank means the same state.
        had = entries.select(*CHUNK, "rank", F.col("position_id").alias("_had"))
        has = found.select(*CHUNK, "rank", F.col("position_id").alias("_has"))
        changed = materialise(
            had.join(has, [*CHUNK, "rank"], "full").where("not (_had <=> _has)").select(*CHUNK).distinct(),
            "link-changed")
        if changed.isEmpty():
            break
        entries = found
        again = materialise(run(rows.unionByName(entries).join(changed, CHUNK, "left_semi")), "link-round", "kind")
        latest = latest.join(changed, CHUNK, "left_anti").unionByName(again)
        if number % ROUNDS_PER_REWRITE == 0:
            latest = materialise(latest, "link-round", "kind")
    return latest


def _resolve_heads(linked: DataFrame, open_trips: DataFrame | None) -> DataFrame:
    """Replaces carried heads (the ping a trip was last seen with in an earlier
    chunk or batch) by the trip's first ping, by pointer doubling over them."""
    carried = linked.where("carried").select(F.col("head").alias("at")).distinct()
    pings = linked.where("kind = 1")
    hops = pings.join(carried, F.col("position_id") == F.col("at")).select(
        "at", F.col("head").alias("to"), F.col("carried").alias("open"))
    if open_trips is not None:
        earlier = open_trips.select(F.col("position_id").alias("at"), F.col("head").alias("to"),
                                    F.lit(False).alias("open"))
        hops = hops.unionByName(earlier)
    hops = materialise(hops, "link-hops")
    while not hops.where("open").isEmpty():
        onward = hops.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("open").alias("_open"))
        hops = materialise(
            hops.join(onward, "to", "left").select(
                "at", F.when(F.col("open"), F.col("_to")).otherwise(F.col("to")).alias("to"),
                (F.col("open") & F.col("_open")).alias("open")), "link-hops")
    roots = hops.select(F.col("at").alias("head"), F.col("to").alias("_root"), F.lit(True).alias("carried"))
    return linked.join(roots, ["head", "carried"], "left").withColumn("head", F.coalesce("_root", "head")).select(
        *linked.columns)


def trip_samples(linked: DataFrame) -> DataFrame:
    """Linked pings as trip samples; trips of one ping are still included."""
    return linked.select(
        ids.trip_id(F.col("head")).alias("trip_id"), "lineid", "direction",
        F.timestamp_micros("us").alias("ts"), "lon", "lat", "position_id", F.col("head").alias("first_position_id"))


def build_trips(samples: DataFrame, min_points: int = 2) -> tuple[DataFrame, DataFrame]:
    """(trip headers, their samples); single-ping trips are dropped from both."""
    headers = (
        samples.groupBy("trip_id", "lineid", "direction")
        .agg(F.first("first_position_id").alias("_first"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
             F.count(F.lit(1)).cast("int").alias("point_count"))
        .where(F.col("point_count") >= min_points)
        .select("trip_id", ids.vehicle_uuid(F.col("_first")).alias("vehicle_uuid"), "lineid", "direction",
                "start_ts", "end_ts", "point_count",
                F.lit(None).cast("string").alias("line_trip_id"), F.lit(None).cast("int").alias("daily_trip_seq"))
    )
    kept = samples.drop("position_id", "first_position_id").join(headers.select("trip_id"), "trip_id", "left_semi")
    return headers, kept
