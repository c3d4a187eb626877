"""Ping, assignment, arrival-estimate and live-payload scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions import text
from pulseline.operators.positions import coerce_pings
from pulseline.sources.files import csv_records, json_records

ASSIGNMENT_FIELDS = ["position_id", "fetched_at_utc", "lineId", "direction", "pointId", "distance",
                     "latitude", "longitude"]
# A file without these has no usable row.
LOCATED_FIELDS = ["fetched_at_utc", "latitude", "longitude"]


def scan_pings(spark: SparkSession, paths: list[str] | str, spread: int | None = None,
               kind: str | None = None) -> DataFrame:
    return coerce_pings(json_records(spark, paths, spread, kind))


def scan_ping_records(spark: SparkSession, paths: list[str] | str, spread: int | None = None) -> DataFrame:
    """Raw records of the ping dumps below folders, with their ``file``."""
    return json_records(spark, paths, spread, kind="positions")


def scan_assignments(spark: SparkSession, paths: list[str] | str, search: bool = False) -> DataFrame:
    """Pings that come with coordinates and their own id. With ``search``, ``paths`` are folders
    looked through for assignment files, each read by its own header."""
    raw = csv_records(spark, paths, ASSIGNMENT_FIELDS, LOCATED_FIELDS, kind="assignments" if search else None)
    return raw.select(
        "position_id", F.lit(None).cast("string").alias("vehicle_uuid"), F.col("lineId").alias("lineid"),
        text.to_int(F.col("direction")).alias("direction"),
        F.nullif("pointId", F.lit("")).alias("pointid"), text.to_double(F.col("distance")).alias("distance_from_point"),
        text.to_instant(F.col("fetched_at_utc")).alias("fetched_at"),
        text.to_double(F.col("longitude")).alias("lon"), text.to_double(F.col("latitude")).alias("lat"),
    ).dropna(subset=["lon", "lat", "fetched_at"])


def observed_stops(assignments: DataFrame) -> DataFrame:
    """Last coordinate seen per stop, a stand-in where stops are not known."""
    last = F.max_by(F.struct("lon", "lat"), F.struct("fetched_at", "position_id"))
    return (assignments.where("pointid is not null").groupBy("pointid").agg(last.alias("_last"))
            .select("pointid", "_last.lon", "_last.lat"))


def scan_waiting_times(spark: SparkSession, paths: list[str] | str, spread: int | None = None,
                       kind: str | None = None) -> DataFrame:
    r = F.col("record")
    return json_records(spark, paths, spread, kind).select(
        text.to_instant(r["poll_ts"]).alias("poll_ts"), r["pointid"].alias("pointid"), r["lineid"].alias("lineid"),
        text.to_instant(r["expected"]).alias("expected"), r["destination"].alias("destination"),
        r["message"].alias("message"),
    ).dropna(subset=["poll_ts"])


def flatten_payload(items: DataFrame, fetched_at_text: Column) -> DataFrame:
    """Live payload rows (``item`` text: a line with nested vehicle positions, as
    list or as JSON text) to ping records. Zero and empty values fall through to
    the next alias here; a direction must be a whole number."""
    names = ["lineid", "direction", "pointid", "distance_from_point", "fetched_at"]

    def distance(vehicle: Column) -> Column:
        # The camelCase key hides the other one even when it is null.
        camel = F.try_variant_get(vehicle, "$.distanceFromPoint", "variant")
        return F.when(camel.isNotNull(), F.try_variant_get(vehicle, "$.distanceFromPoint", "string")).otherwise(
            F.try_variant_get(vehicle, "$.distance_from_point", "string"))

    def ping(vehicle: Column) -> Column:
        return F.struct(
            text.to_int(text.first_truthy(vehicle, "directionId", "direction")).cast("string").alias("direction"),
            text.first_truthy(vehicle, "pointId", "pointid", "point_id").alias("pointid"),
            distance(vehicle).alias("distance_from_point"))

    lines = items.select(F.try_parse_json("item").alias("line"), fetched_at_text.alias("fetched_at"))
    vehicles = F.from_json(text.first_truthy(F.col("line"), "vehiclepositions", "vehicle_positions"), "array<variant>")
    return (
        lines.select(text.first_truthy(F.col("line"), "lineid", "lineId").alias("lineid"), "fetched_at",
                     F.explode(F.transform(vehicles, ping)).alias("ping"))
        .where("lineid is not null and ping.direction is not null and ping.pointid is not null")
        .select("lineid", "ping.*", "fetched_at")
        .select(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("record"))
    )


def mirror_records(pings: DataFrame) -> DataFrame:
    """Pings in the shape of the raw dumps, for replay."""
    return pings.select(
        F.col("fetched_at_text").alias("poll_ts"), "lineid", F.col("direction").alias("directionId"),
        F.col("pointid").alias("pointId"), F.col("distance_from_point").alias("distanceFromPoint"))
