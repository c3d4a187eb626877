"""The user-level questions: live map, trajectories, arrivals, search, counts.

Trips and samples may come laid out by day (``Tables.read_by_day``); questions about an
instant or a window then read only the days they need.

``numbering`` says what the label ``line_NNN`` counts: "window" numbers the trips
that pass the request's filters, "service_day" all trips of the line's day.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions.clock import service_day
from pulseline.operators import catalogue as cat
from pulseline.operators import shapes as sh
from pulseline.operators.ordered import earliest_per_key
from pulseline.operators.temporal import (Instant, active_around, active_between, samples_in_window,
                                          value_at_instant)
from pulseline.operators.trips import headers_touching, number_by_service_day
from pulseline.plans.filters import filter_trips

# Trips of one service day start at most this far apart.
DAY_REACH = timedelta(days=2)


def _numbered(trips: DataFrame, chosen: DataFrame, numbering: str) -> DataFrame:
    if numbering == "window":
        return number_by_service_day(chosen)
    # Only the days of the chosen trips are numbered, all trips of each.
    span = chosen.agg(F.min("start_ts").alias("first"), F.max("start_ts").alias("last"))
    low, high = span.select("first").scalar() - F.lit(DAY_REACH), span.select("last").scalar() + F.lit(DAY_REACH)
    dated = headers_touching(trips, low, high).withColumn("_day", service_day(F.col("lineid"), F.col("start_ts")))
    asked = chosen.select("lineid", service_day(F.col("lineid"), F.col("start_ts")).alias("_day")).distinct()
    near = dated.where((F.col("start_ts") >= low) & (F.col("start_ts") <= high))
    labels = number_by_service_day(near.join(asked, ["lineid", "_day"], "left_semi").drop("_day")).select("trip_id", "line_trip_id")
    return chosen.drop("line_trip_id", "daily_trip_seq").join(labels, "trip_id")


def positions_at(trips: DataFrame, samples: DataFrame, shapes: DataFrame, at: Instant,
                 lines: list[str] | None = None, direction: int | None = None, numbering: str = "window",
                 limit: int | None = None, max_gap_s: int | None = None) -> DataFrame:
    """Where every vehicle is at one instant."""
    chosen = active_around(filter_trips(trips, lines, direction), at)
    numbered = _numbered(trips, chosen, numbering).select("trip_id", "line_trip_id")
    here = value_at_instant(samples, at, chosen, max_gap_s).join(numbered, "trip_id")
    found = here.join(cat.line_metadata(shapes), "lineid", "left").select(
        "trip_id", "lineid", "direction", "line_trip_id", "lon", "lat", "route_color", "route_text_color", "mode")
    return found if limit is None else found.orderBy("lineid", "line_trip_id", "trip_id").limit(limit)


def trajectories(trips: DataFrame, samples: DataFrame, line_stops: DataFrame, shapes: DataFrame,
                 start: Instant, end: Instant, lines: list[str] | None = None, direction: int | None = None,
                 numbering: str = "window", network: str = "local", clip_bounds: bool = False) -> DataFrame:
    """One row per sample of every trip in a window, with the trip's labels;
    ``pack_trajectories`` folds them into one row per trip."""
    chosen = active_between(filter_trips(trips, lines, direction), start, end)
    labels = cat.direction_labels(line_stops).withColumnRenamed("pointid", "_stop")
    described = (
        _numbered(trips, chosen, numbering).select("trip_id", "lineid", "direction", "line_trip_id")
        .withColumn("_stop", F.col("direction").cast("string"))
        .join(labels, ["lineid", "_stop"], "left")
        .join(cat.line_metadata(shapes), "lineid", "left")
        .select("trip_id", "dir_label", F.coalesce("line_trip_id", "lineid").alias("line_trip_id"),
                F.when(F.col("dir_label").isNotNull(),
                       F.concat_ws(":", F.lit(network), "lineid", "dir_label")).alias("shape_id"),
                "mode", "route_color", "route_text_color")
    )
    inside = samples_in_window(filter_trips(samples, lines, direction), start, end, clip_bounds, chosen)
    return inside.join(described, "trip_id").select(
        "trip_id", "lineid", "dir_label", "line_trip_id", "shape_id", "mode", "route_color", "route_text_color",
        F.round(F.unix_micros("ts") / 1000).cast("long").alias("t_ms"), "lon", "lat")


def pack_trajectories(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per trip with ordered samples [t_ms, lon, lat]. The caller's
    window bounds a trip's share."""
    key = [c for c in rows.columns if c not in ("t_ms", "lon", "lat")]
    packed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t_ms", "lon", "lat"))).alias("samples"))
    return packed if limit is None else packed.orderBy("lineid", "line_trip_id", "trip_id").limit(limit)


ETA_ORDER = [F.desc, F.asc_nulls_last, F.asc_nulls_last, F.asc_nulls_last, F.asc_nulls_last]
RANK_BUCKETS = 64
ETA_COLUMNS = ["poll_ts", "expected", "lineid", "destination", "message"]


def _eta_order():
    return [direction(name) for direction, name in zip(ETA_ORDER, ETA_COLUMNS)]


def waiting_times_for_stop(waiting_times: DataFrame, pointid: str, limit: int = 200,
                           counts: DataFrame | None = None) -> DataFrame:
    """Latest arrival estimates at a stop, newest poll first. With ``counts`` (rows per ``pointid`` and
    ``poll_date``, or fewer) the days before the newest ones that hold ``limit`` rows are not read."""
    here = waiting_times.where(F.col("pointid") == pointid)
    if counts is not None:
        # One row per day of one stop.
        days = counts.where((F.col("pointid") == pointid) & F.col("poll_date").isNotNull()).groupBy("poll_date").agg(F.sum("n").alias("n"))
        so_far = days.withColumn("n", F.sum("n").over(Window.orderBy(F.desc("poll_date"))))
        oldest = so_far.where(F.col("n") >= limit).agg(F.max("poll_date")).scalar()
        here = here.where(oldest.isNull() | (F.col("poll_date") >= oldest))
    return here.orderBy(*_eta_order()).limit(limit).select("poll_ts", "lineid", "expected", "destination", "message")


def waiting_times_per_stop(waiting_times: DataFrame, limit: int = 200) -> DataFrame:
    """The same for all stops at once. The rank limit is applied per task before
    the shuffle, then per (stop, bucket) and only then per stop, so the rows of a busy
    stop meet in ``RANK_BUCKETS`` tasks first, and one task ranks ``limit`` of each."""
    first = Window.partitionBy("pointid", "_bucket").orderBy(*_eta_order())
    rank = F.row_number().over(Window.partitionBy("pointid").orderBy(*_eta_order()))
    bucketed = waiting_times.withColumn("_bucket", F.pmod(F.xxhash64(*ETA_COLUMNS), F.lit(RANK_BUCKETS)))
    best = bucketed.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= limit).drop("_rn", "_bucket")
    return best.withColumn("rn", rank).where(F.col("rn") <= limit)


def search(stops: DataFrame, shapes: DataFrame, points: DataFrame, query: str, per_category: int = 5,
           categories: tuple[str, str] = ("Arrêt", "Ligne"), line_label: str = "Ligne ") -> DataFrame:
    """Up to five stops and five lines whose name or id contains the query, case
    ignored; ``%`` and ``_`` work as wildcards. Under two characters finds nothing."""
    pattern = f"%{query}%"
    long_enough = F.lit(len(query) >= 2)

    def matches(*names: str):
        hit = F.lit(False)
        for name in names:
            hit = hit | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
        return hit & long_enough

    found_stops = (
        stops.where(matches("stop_name_fr", "stop_name_nl", "pointid") & F.col("lon").isNotNull())
        .select(F.lit("stop").alias("type"), F.lit(categories[0]).alias("category"), F.col("pointid").alias("id"),
                F.coalesce("stop_name_fr", "stop_name_nl", "pointid").alias("label"), F.col("pointid").alias("sub"),
                "lat", "lon")
        .orderBy("label", "id").limit(per_category)
    )
    named = earliest_per_key(shapes.where(matches("lineid")), ["lineid"], ["direction"])
    chosen = named.orderBy("lineid").limit(per_category)
    centres = sh.line_centroids(sh.shape_segments(points.join(chosen, ["lineid", "direction"], "left_semi")))
    found_lines = chosen.join(centres, ["lineid", "direction"]).select(
        F.lit("line").alias("type"), F.lit(categories[1]).alias("category"), F.col("lineid").alias("id"),
        F.concat(F.lit(line_label), "lineid").alias("label"), F.coalesce("mode", F.lit("")).alias("sub"), "lat", "lon")
    rank = F.when(F.col("type") == "stop", 0).otherwise(1)
    return found_stops.unionByName(found_lines).orderBy(rank, "label", "id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counted = [df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))
               for name, df in tables.items()]
    names = list(tables)
    spark = tables[names[0]].sparkSession
    every = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("table_name"))
    found = counted[0]
    for other in counted[1:]:
        found = found.unionByName(other)
    return every.join(found, "table_name", "left").select("table_name", F.coalesce("n", F.lit(0)).alias("n"))
