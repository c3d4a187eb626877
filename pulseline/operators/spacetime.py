"""Trips met by a box on the map within a window of time.

A trip is a line through (lon, lat, time). Its segments are cut into parts by the time
slice they start in; a part has one box over its segments, and the first sample of the
following part as ``tail``, so a part's segments can be rebuilt without its neighbours. The
question goes to the boxes first; the segments of the parts whose box meets it are then tested exactly.

Stored boxes lie under each day their part touches, ordered by the quadkey of their
centre (a z-order), so that day and place prune partitions and row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.geo import mercator_unit_x, mercator_unit_y
from pulseline.operators.temporal import Instant, _at
from pulseline.operators.trips import TRIP_KEY, headers_touching, samples_touching, time_slice

# Quadkey digits of a box's centre: cells of about 150 m.
PLACE_DIGITS = 18
BOXES = ("trip_id string, lineid string, direction int, part long, start_ts timestamp, end_ts timestamp, west double, south double, "
         "east double, north double, place string, tail struct<ts:timestamp,lon:double,lat:double>")


@dataclass(frozen=True)
class Box:
    """Degrees; the borders belong to the box."""

    west: float
    south: float
    east: float
    north: float


def _place(lon: Column, lat: Column) -> Column:
    """The quadkey of the cell: binary digits of both numbers, read as ones to base four, add up to its digits."""
    side = 1 << PLACE_DIGITS

    def digits(unit: Column) -> Column:
        cell = F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(unit * side)))
        return F.conv(F.bin(cell), 4, 10).cast("long")
    both = digits(mercator_unit_x(lon)) + 2 * digits(mercator_unit_y(lat))
    return F.lpad(F.conv(both.cast("string"), 10, 4), PLACE_DIGITS, "0")


def part_boxes(samples: DataFrame) -> DataFrame:
    """One row in the columns of ``BOXES`` for each trip and time slice in which it has a sample with coordinates."""
    placed = samples.dropna(subset=["lon", "lat", "ts", *TRIP_KEY])
    # Own samples are aggregated where they are; what follows a part is the first sample of the trip's next one.
    own = placed.groupBy(*TRIP_KEY, time_slice(F.col("ts")).alias("part")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("_last"), F.min("lon").alias("_west"), F.min("lat").alias("_south"),
        F.max("lon").alias("_east"), F.max("lat").alias("_north"), F.min_by("lon", "ts").alias("_lon"), F.min_by("lat", "ts").alias("_lat"))
    head = F.struct(F.col("start_ts").alias("ts"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    boxes = own.withColumn("tail", F.lead(head).over(Window.partitionBy(*TRIP_KEY).orderBy("part"))).withColumns({
        "end_ts": F.greatest("_last", "tail.ts"), "west": F.least("_west", "tail.lon"), "south": F.least("_south", "tail.lat"),
        "east": F.greatest("_east", "tail.lon"), "north": F.greatest("_north", "tail.lat")})
    centre = _place((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    return boxes.withColumn("place", centre).select(*[c.split()[0] for c in BOXES.split(", ")])


def trips_in_box(boxes: DataFrame, samples: DataFrame, box: Box, start: Instant, end: Instant) -> DataFrame:
    """Trips that are inside ``box`` at some time from ``start`` up to but without ``end``: their key,
    ``entered`` and ``left``, the first and last such time (to the millisecond), also where the line only passes between two samples.

    ``boxes`` come from ``part_boxes`` over ``samples``, or both from stored tables laid out by day."""
    low, high = _at(start), _at(end)
    met = headers_touching(boxes, low, high).where(
        (F.col("start_ts") < high) & (F.col("end_ts") >= low) & (F.col("west") <= box.east) & (F.col("east") >= box.west)
        & (F.col("south") <= box.north) & (F.col("north") >= box.south)).select(*TRIP_KEY, "part", "start_ts", "end_ts", "tail")
    span = met.agg(F.min("start_ts").alias("first"), F.max("end_ts").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    near = samples_touching(samples.where((F.col("ts") >= first) & (F.col("ts") <= last)), first, last)
    near = near.where("lon is not null and lat is not null").withColumn("part", time_slice(F.col("ts")))
    fixes = near.select(*TRIP_KEY, "part", "ts", "lon", "lat").join(met.select(*TRIP_KEY, "part"), [*TRIP_KEY, "part"], "left_semi")
    tails = met.where("tail is not null").select(*TRIP_KEY, "part", "tail.ts", "tail.lon", "tail.lat")
    # The rows of a part end with its tail; the tail itself starts a segment of the next part only.
    rows = fixes.withColumn("_tail", F.lit(False)).unionByName(tails.withColumn("_tail", F.lit(True)))
    along = Window.partitionBy(*TRIP_KEY, "part").orderBy("ts")  # a part is a trip's samples in one slice
    segments = rows.withColumn("end", F.lead(F.struct("ts", "lon", "lat")).over(along)).where("not _tail")
    return _inside(segments, box, low, high)


def _inside(segments: DataFrame, box: Box, low: Column, high: Column) -> DataFrame:
    """Clips every segment in three dimensions: the share of it that lies in the box and the window."""
    t0 = F.unix_micros("ts")
    run = {"lon": F.coalesce(F.col("end.lon") - F.col("lon"), F.lit(0.0)), "lat": F.coalesce(F.col("end.lat") - F.col("lat"), F.lit(0.0)),
           "t": F.coalesce(F.unix_micros("end.ts") - t0, F.lit(0)).cast("double")}
    sides = {"lon": (F.lit(box.west) - F.col("lon"), F.lit(box.east) - F.col("lon")),
             "lat": (F.lit(box.south) - F.col("lat"), F.lit(box.north) - F.col("lat")),
             "t": ((F.unix_micros(low) - t0).cast("double"), (F.unix_micros(high) - t0).cast("double"))}
    cut = segments.withColumns({f"_{c}": run[c] for c in run} | {f"_{c}{k}": sides[c][k] for c in run for k in (0, 1)})
    # Where a segment does not move along an axis, that axis decides on all of it.
    still = {c: (F.col(f"_{c}0") <= 0) & (F.col(f"_{c}1") >= 0) for c in ("lon", "lat")} | {"t": (F.col("_t0") <= 0) & (F.col("_t1") > 0)}
    for c in run:
        cut = cut.where((F.col(f"_{c}") != 0) | still[c])

    def crossing(c: str, pick) -> Column:
        return F.when(F.col(f"_{c}") != 0, pick(*[F.col(f"_{c}{k}") / F.col(f"_{c}") for k in (0, 1)]))
    enter = F.greatest(F.lit(0.0), *[crossing(c, F.least) for c in run])
    leave = F.least(F.lit(1.0), *[crossing(c, F.greatest) for c in run])
    # The window's end is outside.
    hit = cut.withColumns({"_in": enter, "_out": leave}).where("_in <= _out and (_t = 0 or _in * _t < _t1)")

    def moment(s: str) -> Column:
        return F.timestamp_millis(F.round((t0 + F.col(s) * F.col("_t")) / 1000).cast("long"))
    return hit.groupBy(*TRIP_KEY).agg(F.min(moment("_in")).alias("entered"), F.max(moment("_out")).alias("left"))
