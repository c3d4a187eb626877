"""GTFS tables from an unpacked feed directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.text import colour, to_double, to_int

# GTFS route_type to mode name; anything else is "other".
ROUTE_TYPE_MODE = {"0": "tram", "1": "metro", "2": "rail", "3": "bus", "7": "funicular"}
BYTE_ORDER_MARK = "﻿"


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted text columns, trimmed, with ``row_no`` growing along the file, or the
    file's own column of that name where a feed in many files has one."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.replace(BYTE_ORDER_MARK, "").strip() for c in raw.columns])
    missing = F.lit(None).cast("string")
    place = F.col("row_no").cast("long") if "row_no" in raw.columns else F.monotonically_increasing_id()
    return raw.select(
        *[(F.trim(F.col(c)) if c in raw.columns else missing).alias(c) for c in columns], place.alias("row_no"))


def scan_routes(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/routes.txt",
                      ["route_id", "route_short_name", "route_type", "route_color", "route_text_color"])


def scan_trips(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, f"{folder}/trips.txt", ["route_id", "direction_id", "shape_id"])
    return raw.withColumn("direction_id", to_int(F.col("direction_id"))).where(
        "route_id <> '' and shape_id <> '' and direction_id is not null")


def scan_shapes(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, f"{folder}/shapes.txt",
                     ["shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"])
    sequence = F.coalesce(F.nullif("shape_pt_sequence", F.lit("")), F.lit("0"))
    return raw.select(
        "shape_id", to_int(sequence).alias("seq"), to_double(F.col("shape_pt_lon")).alias("lon"),
        to_double(F.col("shape_pt_lat")).alias("lat")).dropna()


def route_attributes(routes: DataFrame) -> DataFrame:
    """Line id, mode and colours per route; the last row of a route id wins,
    and an unusable colour does not undo an earlier one."""
    mode = F.coalesce(F.create_map(*[F.lit(x) for kv in ROUTE_TYPE_MODE.items() for x in kv])[F.col("route_type")],
                      F.lit("other"))
    typed = routes.where("route_id <> '' and route_short_name <> ''").select(
        "route_id", F.col("route_short_name").alias("lineid"), mode.alias("mode"),
        colour(F.col("route_color")).alias("route_color"), colour(F.col("route_text_color")).alias("route_text_color"),
        "row_no")

    def last(name: str):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("row_no"))).alias(name)

    return typed.groupBy("route_id").agg(*[last(c) for c in ("lineid", "mode", "route_color", "route_text_color")])
