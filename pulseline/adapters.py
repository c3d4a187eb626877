"""Transit-shaped views over the benchmark's star-schema tables.

They turn customers into stops and line sequences, events into vehicle pings and
arrival estimates, and order lines into trip samples, so that every operator can
be run on whole tables and compared with plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.operators.ordered import running_number

EPOCH_2024_US = 1_704_067_200_000_000
ORDER_SPACING_US = 47_000_000
SAMPLE_SPACING_US = 240_000_000
# Customer keys per numbering bucket; keys are unique, so this bounds a bucket.
CUSTKEY_BUCKET = 65_536


def instant(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("long"))


def micros_of(ntz: Column) -> Column:
    """Microseconds of a zone-less Parquet timestamp, read as UTC."""
    return F.unix_micros(ntz.cast("timestamp"))


class Adapter:
    """Lazily built views for one data folder. Views named in ``stored`` are
    written once and read back, as the loaded tables of a deployment would be;
    that pays where a query uses a view, or what is built on it, several times."""

    def __init__(self, spark: SparkSession, folder: str, stored: Sequence[str] = ()):
        self.spark = spark
        self.folder = folder
        self.stored = stored
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        build = _BUILDERS.get(name)
        if build is None:
            raise AttributeError(name)
        if name not in self._views:
            view = build(self)
            self._views[name] = materialise(view, name) if name in self.stored else view
        return self._views[name]


def _line_stops(a: Adapter) -> DataFrame:
    customers = a.table("customer").select(
        F.col("c_nationkey").alias("nk"), (F.col("c_custkey") % 2).cast("int").alias("par"),
        "c_custkey", "c_name", F.floor(F.col("c_custkey") / CUSTKEY_BUCKET).alias("_bucket"))
    numbered = running_number(customers, ["nk", "par"], "_bucket", ["c_custkey"], "sequence_idx")
    nations = a.table("nation").select(F.col("n_nationkey").alias("nk"), "n_name")
    side = F.when(F.col("par") == 0, " C").otherwise(" S")
    return numbered.join(nations, "nk").select(
        F.when(F.col("nk") % 8 == 7, F.concat(F.lit("N"), F.col("nk").cast("string")))
        .otherwise((F.col("nk") + 1).cast("string")).alias("lineid"),
        F.when(F.col("par") == 0, "City").otherwise("Suburb").alias("direction"),
        F.col("sequence_idx").cast("int").alias("sequence_idx"),
        F.col("c_custkey").cast("string").alias("pointid"),
        F.when(F.col("nk") % 10 != 9, F.concat("n_name", side)).alias("destination"),
        "nk", "par", "c_name", "c_custkey",
    )


def _lon() -> Column:
    return F.lit(4.3) + F.col("nk") * F.lit(0.004) + F.col("sequence_idx") * F.lit(0.003)


def _lat(base: float) -> Column:
    return F.lit(base) + F.col("par") * F.lit(0.02) + (F.col("sequence_idx") % 3) * F.lit(0.001)


def _stops(a: Adapter) -> DataFrame:
    return a.line_stops.select(
        "pointid", F.col("c_name").alias("stop_name_fr"),
        F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("NL "), "c_name")).alias("stop_name_nl"),
        _lon().alias("lon"), _lat(50.8).alias("lat"))


def _patchy_stops(a: Adapter) -> DataFrame:
    """All stops; some were never surveyed and have no coordinates, as positions meet them."""
    surveyed = F.col("pointid").cast("long") % 11 != 10
    return a.stops.withColumns({c: F.when(surveyed, F.col(c)) for c in ("lon", "lat")})


def _patchy_shape_points(a: Adapter) -> DataFrame:
    """All vertices; those of one line in six have no coordinates."""
    drawn = F.col("nk") % 6 != 4
    return a.line_stops.select("lineid", "direction", F.col("sequence_idx").alias("seq"),
                               F.when(drawn, _lon()).alias("lon"), F.when(drawn, _lat(50.8001)).alias("lat"))


def _shape_points(a: Adapter) -> DataFrame:
    return a.line_stops.select(
        "lineid", "direction", F.col("sequence_idx").alias("seq"),
        _lon().alias("lon"), _lat(50.8001).alias("lat"))


def _line_shapes(a: Adapter) -> DataFrame:
    mode = F.element_at(F.array(F.lit("metro"), F.lit("tram"), F.lit("bus"), F.lit(None)), F.col("nk") % 4 + 1)
    return (
        a.line_stops.select("lineid", "direction", "nk", "par").distinct()
        .select("lineid", "direction", F.col("par").alias("variant"), mode.alias("mode"),
                F.concat(F.lit("#"), F.lpad((F.col("nk") * 1111 + 100000).cast("string"), 6, "0")).alias("route_color"),
                F.lit("#FFFFFF").alias("route_text_color"))
    )


def _line_terminus(a: Adapter) -> DataFrame:
    last = F.max_by(F.struct("pointid", "destination"), "sequence_idx")
    return (
        a.line_stops.groupBy("lineid", "direction").agg(last.alias("last"))
        .select("lineid", F.col("last.pointid").alias("terminus_pointid"), "direction",
                F.col("last.destination").alias("destination"))
    )


def _feed(a: Adapter) -> DataFrame:
    return feed_of(a, a.table("events"))


def feed_of(a: Adapter, events: DataFrame) -> DataFrame:
    """Pings as text fields, exactly as a poller would land them. ``events`` may
    be a stream."""
    length = a.line_stops.groupBy("nk", "par").agg(F.count(F.lit(1)).alias("n"))
    polled = (
        events.select(F.floor(F.col("event_id") / 30).alias("poll"), (F.col("event_id") % 30).alias("slot"))
        .select("poll", (F.col("slot") % 5).cast("int").alias("nk"),
                (F.floor(F.col("slot") / 5) % 2).cast("int").alias("par"),
                (F.col("poll") * 60 + F.floor(F.col("slot") / 10) * 700).alias("along"))
    )
    placed = polled.join(length, ["nk", "par"]).withColumn(
        "sequence_idx", (F.floor(F.col("along") / 200) % F.col("n") + 1).cast("int"))
    stops = a.line_stops.select("nk", "par", "sequence_idx", "lineid", "direction", "pointid")
    micros = (F.col("poll") * 20 + F.floor(F.col("poll") / 40) * 3600) * 1_000_000 + EPOCH_2024_US
    return (
        placed.join(stops, ["nk", "par", "sequence_idx"])
        .join(a.line_terminus.select("lineid", "direction", "terminus_pointid"), ["lineid", "direction"])
        .select("lineid", F.col("terminus_pointid").alias("directionId"), F.col("pointid").alias("pointId"),
                (F.col("along") % 200).cast("double").cast("string").alias("distanceFromPoint"),
                F.date_format(instant(micros), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("poll_ts"))
    )


def _trip_samples(a: Adapter) -> DataFrame:
    orders = a.table("orders").select("o_orderkey", "o_custkey")
    lines = (a.table("lineitem").groupBy("l_orderkey", "l_linenumber")
             .agg(F.min("l_partkey").alias("pk")))
    stops = a.line_stops.select("lineid", F.col("direction").alias("label"), F.col("c_custkey").alias("o_custkey"))
    terminus = a.line_terminus.select("lineid", F.col("direction").alias("label"), "terminus_pointid")
    micros = (F.col("o_orderkey") * ORDER_SPACING_US + F.col("l_linenumber").cast("long") * SAMPLE_SPACING_US + EPOCH_2024_US)
    # The catalogue sides go first, so the large side meets one small table.
    bearing = stops.join(terminus, ["lineid", "label"]).select(
        "o_custkey", "lineid", F.col("terminus_pointid").cast("int").alias("direction"))
    return (
        lines.join(orders.join(bearing, "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_orderkey").cast("string").alias("trip_id"), "lineid", "direction",
                instant(micros).alias("ts"),
                (F.lit(4.3) + (F.col("pk") % 100) * F.lit(0.001)).alias("lon"),
                (F.lit(50.8) + (F.col("pk") % 37) * F.lit(0.001)).alias("lat"))
    )


def _trips(a: Adapter) -> DataFrame:
    from pulseline.operators.trips import trip_headers
    return trip_headers(a.trip_samples)


def _waiting_times(a: Adapter) -> DataFrame:
    e = a.table("events")
    polled = micros_of(F.col("ts"))
    return e.select(
        instant(polled).alias("poll_ts"), F.col("user_id").cast("string").alias("pointid"),
        F.col("event_type").alias("lineid"),
        F.when(F.col("event_id") % 9 != 0,
               instant(polled + F.floor("value").cast("long") * 1_000_000)).alias("expected"),
        F.when(F.col("event_id") % 2 == 0, "City").alias("destination"),
        F.col("props").alias("message"))


_BUILDERS = {
    "line_stops": _line_stops, "stops": _stops, "shape_points": _shape_points,
    "line_shapes": _line_shapes, "line_terminus": _line_terminus, "feed": _feed,
    "patchy_stops": _patchy_stops, "patchy_shape_points": _patchy_shape_points,
    "trip_samples": _trip_samples, "trips": _trips, "waiting_times": _waiting_times,
}
