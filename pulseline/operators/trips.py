"""Trip headers, trip values and the open/closed union.

A trip is one header row plus sample rows (trip_id, ts, lon, lat) with strictly
increasing ``ts``. Where one value per trip is wanted, samples are packed into
arrays per time slice, so that no trip, however long, becomes one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.functions.clock import DAY_SHIFT_MINUTES, ZONE, service_day
from pulseline.operators.ordered import running_number

TRIP_KEY = ["trip_id", "lineid", "direction"]
PART_SECONDS = 3600


def time_slice(ts: Column, seconds: int = PART_SECONDS) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def by_day(rows: DataFrame) -> DataFrame:
    """Headers once for each ``day`` (UTC) their trip touches, with ``first_day``; samples with their day."""
    if "ts" in rows.columns:
        return rows.withColumn("day", F.to_date("ts"))
    spans = F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))
    return rows.withColumn("first_day", F.to_date("start_ts")).withColumn("day", F.explode(spans))


def headers_touching(trips: DataFrame, low: Column, high: Column) -> DataFrame:
    """Of headers laid out by day those that may meet [low, high], each once: on its first day, or on that of
    ``low`` if it began earlier. The days reach the scan as partition filters, scalar subqueries too.
    Headers without that layout come back as they are."""
    if "day" not in trips.columns:
        return trips
    first, last = F.to_date(low), F.to_date(high)
    met = trips.where((F.col("day") >= first) & (F.col("day") <= last))
    return met.where(F.col("day") == F.greatest("first_day", first)).drop("day", "first_day")


def samples_touching(samples: DataFrame, low: Column, high: Column) -> DataFrame:
    """Of samples laid out by day those of the days from ``low`` to ``high``; others come back as they are."""
    if "day" not in samples.columns:
        return samples
    return samples.where((F.col("day") >= F.to_date(low)) & (F.col("day") <= F.to_date(high))).drop("day")


def trip_headers(samples: DataFrame, min_points: int = 2) -> DataFrame:
    """Extent and size per trip; shorter trips are dropped."""
    return (
        samples.groupBy(*TRIP_KEY)
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
             F.count(F.lit(1)).cast("int").alias("point_count"))
        .where(F.col("point_count") >= min_points)
    )


def assemble_trips(samples: DataFrame, part_seconds: int | None = PART_SECONDS) -> DataFrame:
    """Ordered sample arrays per (trip, time slice), each with the extent and size of
    the whole trip; one array per trip (``part`` 0) without ``part_seconds``, where the
    caller knows that trips are short."""
    fix = F.struct("ts", "lon", "lat")
    part = F.lit(0).cast("long") if part_seconds is None else time_slice(F.col("ts"), part_seconds)
    # Written, as the extents come from the parts; the samples are read once.
    packed = materialise(samples.withColumn("part", part).groupBy(*TRIP_KEY, "part").agg(
        F.array_sort(F.collect_list(fix)).alias("samples"), F.min("ts").alias("_first"), F.max("ts").alias("_last"),
        F.count(F.lit(1)).alias("_n")), "trip-parts")
    whole = packed.groupBy(*TRIP_KEY).agg(F.min("_first").alias("start_ts"), F.max("_last").alias("end_ts"),
                                          F.sum("_n").cast("int").alias("point_count"))
    return packed.drop("_first", "_last", "_n").join(whole, TRIP_KEY)


def union_trips(open_trips: DataFrame, closed_trips: DataFrame) -> DataFrame:
    """Open and closed trips as one relation; columns only one side has are NULL."""
    return open_trips.unionByName(closed_trips, allowMissingColumns=True)


def number_by_service_day(trips: DataFrame, zone: str = ZONE,
                          shift_minutes: int = DAY_SHIFT_MINUTES) -> DataFrame:
    """Adds ``service_day``, ``daily_trip_seq`` and the label ``line_NNN``.

    The label keeps three characters, so numbers past 999 are cut on the right.
    """
    dated = trips.withColumns({
        "service_day": service_day(F.col("lineid"), F.col("start_ts"), zone, shift_minutes),
        "_minute": time_slice(F.col("start_ts"), 60),
    })
    numbered = running_number(dated, ["lineid", "service_day"], "_minute",
                              ["start_ts", "trip_id"], "daily_trip_seq").drop("_minute")
    label = F.concat("lineid", F.lit("_"), F.lpad(F.col("daily_trip_seq").cast("string"), 3, "0"))
    return numbered.withColumn("line_trip_id", label)
