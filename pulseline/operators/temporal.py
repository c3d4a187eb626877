"""Trips as functions of time: value at an instant, restriction to a window."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.geo import lerp
from pulseline.operators.ordered import next_row
from pulseline.operators.trips import TRIP_KEY, headers_touching, samples_touching, time_slice

Instant = datetime | Column


def _at(value: Instant) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def _share(at: Column, start: Column, end: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))


def value_at_instant(samples: DataFrame, at: Instant, trips: DataFrame | None = None,
                     max_gap_s: int | None = None) -> DataFrame:
    """Linear value of every trip at one instant; trips not alive then are absent.

    The trips alive are found first (from the headers ``trips`` if given, else by
    a hash aggregate), and only their samples go on; with headers, only the lines
    and the time these trips span are read. ``max_gap_s`` tells how far apart
    neighbouring samples usually are (300 for linked trips): samples that near the
    instant are read first, and all samples only of trips that have none there on
    one side.
    """
    when = _at(at)
    extents = headers_touching(trips, when, when) if trips is not None else samples.groupBy(*TRIP_KEY).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    alive = extents.where((F.col("start_ts") <= when) & (F.col("end_ts") >= when)).select(*TRIP_KEY, "start_ts", "end_ts")
    near = samples
    if trips is not None:
        # No sample of these trips lies outside; the scan can skip the rest of time.
        span = alive.agg(F.min("start_ts").alias("first"), F.max("end_ts").alias("last"))
        first, last = span.select("first").scalar(), span.select("last").scalar()
        near = samples_touching(near.where((F.col("ts") >= first) & (F.col("ts") <= last)), first, last)
    fix = F.struct("ts", "lon", "lat")

    def neighbours(rows: DataFrame, of: DataFrame) -> DataFrame:
        return (
            rows.join(of.select(*TRIP_KEY), TRIP_KEY, "left_semi").withColumn("_at", when).groupBy(*TRIP_KEY, "_at")
            .agg(F.max_by(fix, F.when(F.col("ts") <= F.col("_at"), F.col("ts"))).alias("a"),
                 F.min_by(fix, F.when(F.col("ts") >= F.col("_at"), F.col("ts"))).alias("b"))
        )

    if max_gap_s is None:
        around = neighbours(near, alive)
    else:
        reach = F.make_dt_interval(secs=F.lit(max_gap_s))
        close = neighbours(near.where((F.col("ts") >= when - reach) & (F.col("ts") <= when + reach)), alive)
        close = close.where("a is not null and b is not null")
        around = close.unionByName(neighbours(near, alive.join(close, TRIP_KEY, "left_anti")))
    t = F.when(F.col("a.ts") == F.col("b.ts"), 0.0).otherwise(_share(F.col("_at"), F.col("a.ts"), F.col("b.ts")))
    return around.withColumn("_t", t).select(
        *TRIP_KEY, F.col("_at").alias("at_ts"), lerp(F.col("a.lon"), F.col("b.lon"), F.col("_t")).alias("lon"),
        lerp(F.col("a.lat"), F.col("b.lat"), F.col("_t")).alias("lat"))


def trip_segments(samples: DataFrame) -> DataFrame:
    """Samples with the following one as ``end`` (NULL on a trip's last)."""
    sliced = samples.withColumn("_slice", time_slice(F.col("ts")))
    return next_row(sliced, TRIP_KEY, "_slice", ["ts"], ["ts", "lon", "lat"], "end").drop("_slice")


# A segment is laid over slices of the finest of these sizes (times the base size)
# that needs at most SPAN slices; a segment of years costs no more than a short one.
SPAN = 32
COARSER = [1, SPAN, SPAN ** 2, SPAN ** 3]


def value_at_many_instants(samples: DataFrame, asks: DataFrame, on: Sequence[str] = ("trip_id",),
                           slice_s: int = 600, max_gap_s: int | None = None) -> DataFrame:
    """Value for each row of ``asks`` (columns ``on`` and ``at_ts``), as an
    interval join: segments are laid over time slices, then an equi-join on
    (``on``, slice) with a short range test. ``max_gap_s`` is the usual time between
    neighbouring samples (300 for linked trips) and spares the slices coarser than it
    needs; a longer gap then lies over more slices, with the same result."""
    sizes = COARSER if max_gap_s is None else COARSER[:1 + sum(s * slice_s * SPAN < max_gap_s for s in COARSER[:-1])]
    segments = trip_segments(samples)
    last = F.coalesce(F.col("end.ts"), F.col("ts"))
    length = (F.unix_micros(last) - F.unix_micros("ts")) / (slice_s * 1_000_000)
    size = F.lit(sizes[-1]).cast("long")
    for finer in reversed(sizes[:-1]):
        size = F.when(length <= finer * SPAN, finer).otherwise(size)

    def slice_of(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / (F.col("_size") * (slice_s * 1_000_000)))

    laid = segments.withColumn("_size", size).withColumn(
        "_slice", F.explode(F.sequence(slice_of(F.col("ts")), slice_of(last))))
    wanted = asks.withColumn("_size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]))).withColumn(
        "_slice", slice_of(F.col("at_ts")))
    inside = (F.col("at_ts") >= F.col("ts")) & (
        (F.col("at_ts") < F.col("end.ts")) | (F.col("end").isNull() & (F.col("at_ts") == F.col("ts"))))
    t = _share(F.col("at_ts"), F.col("ts"), F.col("end.ts"))

    def blended(name: str) -> Column:
        return F.when(F.col("end").isNull(), F.col(name)).otherwise(lerp(F.col(name), F.col(f"end.{name}"), t))

    keep = [*asks.columns, *[c for c in TRIP_KEY if c not in asks.columns]]
    return (
        wanted.join(laid, [*on, "_size", "_slice"]).where(inside)
        .select(*keep, blended("lon").alias("lon"), blended("lat").alias("lat"))
    )


def samples_in_window(samples: DataFrame, start: Instant, end: Instant, clip_bounds: bool = False,
                      trips: DataFrame | None = None) -> DataFrame:
    """Samples with start <= ts < end; with ``clip_bounds`` also the interpolated
    values at both borders for trips that cross them. A trip that starts at the end
    is outside. Headers (``trips``) spare a pass over all samples."""
    low, high = _at(start), _at(end)
    columns = [*TRIP_KEY, "ts", "lon", "lat"]
    inside = samples_touching(samples, low, high).where((F.col("ts") >= low) & (F.col("ts") < high)).select(*columns)
    if not clip_bounds:
        return inside
    extents = trips if trips is not None else samples.groupBy(*TRIP_KEY).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    met = headers_touching(extents, low, high).where((F.col("start_ts") < high) & (F.col("end_ts") >= low))
    borders = value_at_instant(samples, low, met).unionByName(value_at_instant(samples, high, met))
    return inside.unionByName(borders.withColumnRenamed("at_ts", "ts").select(*columns)).distinct()


def active_around(trips: DataFrame, at: Instant, margin: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Trips whose extent meets [at - margin, at + margin)."""
    when, reach = _at(at), F.lit(margin)
    near = headers_touching(trips, when - reach, when + reach)
    return near.where((F.col("start_ts") < when + reach) & (F.col("end_ts") >= when - reach))


def active_between(trips: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Trips with start_ts < end and end_ts > start, both strict."""
    near = headers_touching(trips, _at(start), _at(end))
    return near.where((F.col("start_ts") < _at(end)) & (F.col("end_ts") > _at(start)))
