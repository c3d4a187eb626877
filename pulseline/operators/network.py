"""Building line shapes from GTFS: canonical shape, polyline, direction label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.geo import haversine_m
from pulseline.operators.ordered import running_number
from pulseline.operators.shapes import SEQ_BUCKET

# Fixed value: how far a shape's end may lie from its terminus.
TERMINUS_TOLERANCE_M = 500.0


def canonical_shapes(trips: DataFrame) -> DataFrame:
    """Most frequent shape per (route, direction); on a tie the one seen first.
    ``row_no`` tells the order in which trips appear."""
    counts = trips.groupBy("route_id", "direction_id", "shape_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("_seen"))
    best = F.max_by(F.struct("shape_id", "n"), F.struct(F.col("n"), -F.col("_seen")))
    return counts.groupBy("route_id", "direction_id").agg(best.alias("_b"), F.min("_seen").alias("first_row")).select(
        "route_id", "direction_id", F.col("_b.shape_id").alias("shape_id"), F.col("_b.n").alias("trips"), "first_row")


def assemble_polylines(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vertices of the wanted shapes, numbered from 1 along each; shapes with
    under two vertices are dropped. Adds ``n_points``."""
    chosen = (
        vertices.join(wanted.select("shape_id").distinct(), "shape_id", "left_semi")
        .withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    )
    numbered = running_number(chosen, ["shape_id"], "_bucket", ["seq", "lon", "lat"], "idx").drop("_bucket")
    sizes = numbered.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_points")).where("n_points >= 2")
    return numbered.join(sizes, "shape_id").select("shape_id", "idx", "lon", "lat", "n_points")


def label_directions(candidates: DataFrame, termini: DataFrame) -> DataFrame:
    """Direction label per candidate (key columns plus lineid and the two end
    points): nearest terminus within reach of the end, else of the start with
    ``reverse``, else a skip reason."""
    def nearest(lon: str, lat: str) -> Column:
        metres = haversine_m(F.col(lon), F.col(lat), F.col("lon"), F.col("lat"))
        return F.min_by(F.struct("direction", metres.alias("metres")), F.struct(metres, "terminus_pointid", "direction"))

    key = candidates.columns
    matched = (
        candidates.join(termini, "lineid", "left").groupBy(*key)
        .agg(nearest("end_lon", "end_lat").alias("at_end"), nearest("start_lon", "start_lat").alias("at_start"),
             F.count("terminus_pointid").alias("_n"))
    )
    end_ok = F.col("at_end.metres") <= TERMINUS_TOLERANCE_M
    start_ok = F.col("at_start.metres") <= TERMINUS_TOLERANCE_M
    return matched.select(
        *key,
        F.when(end_ok, F.col("at_end.direction")).when(start_ok, F.col("at_start.direction")).alias("dir_label"),
        F.when(end_ok, F.col("at_end.metres")).when(start_ok, F.col("at_start.metres")).alias("metres"),
        F.when(end_ok, False).when(start_ok, True).alias("reverse"),
        F.when(F.col("_n") == 0, "no_terminus").when(~(end_ok | start_ok), "far").alias("skipped"),
    )


def shape_directions(canonical: DataFrame, polylines: DataFrame, routes: DataFrame,
                     termini: DataFrame) -> DataFrame:
    """Every canonical shape with its label, reversal or reason to be skipped."""
    ends = polylines.where("idx = 1 or idx = n_points").groupBy("shape_id").agg(
        F.min_by(F.struct("lon", "lat"), "idx").alias("s"), F.max_by(F.struct("lon", "lat"), "idx").alias("e"))
    known = (
        canonical.join(routes.select("route_id", "lineid"), "route_id", "left").join(ends, "shape_id", "left")
        .select("route_id", "direction_id", "first_row", "shape_id", "lineid", F.col("s.lon").alias("start_lon"),
                F.col("s.lat").alias("start_lat"), F.col("e.lon").alias("end_lon"), F.col("e.lat").alias("end_lat"))
    )
    labelled = label_directions(known, termini)
    reason = (F.when(F.col("lineid").isNull(), "unknown_route")
              .when(F.col("end_lon").isNull(), "short").otherwise(F.col("skipped")))
    return labelled.withColumn("skipped", reason)


def gtfs_line_shapes(directions: DataFrame, polylines: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shape attributes, shape vertices) per (line, direction label). Where two
    routes give the same pair, the one that appears last in the trips wins."""
    usable = directions.where("skipped is null")
    winner = F.max_by(F.struct("route_id", "direction_id", "shape_id", "reverse"), "first_row")
    chosen = usable.groupBy("lineid", F.col("dir_label").alias("direction")).agg(winner.alias("w")).select(
        "lineid", "direction", "w.*")
    attributes = chosen.join(routes.drop("lineid"), "route_id", "left").select(
        "lineid", "direction", F.col("direction_id").alias("variant"), F.coalesce("mode", F.lit("other")).alias("mode"),
        "route_color", "route_text_color")
    vertices = chosen.join(polylines, "shape_id").select(
        "lineid", "direction",
        F.when(F.col("reverse"), F.col("n_points") - F.col("idx") + 1).otherwise(F.col("idx")).cast("int").alias("seq"),
        "lon", "lat")
    return attributes, vertices
