"""Catalogue dumps and catalogue documents.

Rows carry ``file`` and ``row_no``, so that an upsert can let the last one win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.geo import linestring_points
from pulseline.functions.text import first_truthy, to_double, to_int
from pulseline.operators.ordered import earliest_per_key
from pulseline.sources.files import json_records

PLACE = ["file", "row_no"]


def _fields(*names: str) -> list[Column]:
    return [F.col("record")[n].alias(n) for n in names]


def scan_stops(spark: SparkSession, paths: list[str] | str, kind: str | None = None) -> DataFrame:
    r = F.col("record")
    return json_records(spark, paths, kind=kind).select(
        *_fields("pointid", "stop_name_fr", "stop_name_nl"), to_double(r["lon"]).alias("lon"),
        to_double(r["lat"]).alias("lat"), *PLACE).dropna(subset=["pointid", "lon", "lat"])


def scan_line_stops(spark: SparkSession, paths: list[str] | str, kind: str | None = None) -> DataFrame:
    return json_records(spark, paths, kind=kind).select(
        *_fields("lineid", "direction"), to_int(F.col("record")["sequence_idx"]).alias("sequence_idx"),
        *_fields("pointid", "destination"), *PLACE,
    ).dropna(subset=["lineid", "direction", "sequence_idx", "pointid"])


def scan_line_terminus(spark: SparkSession, paths: list[str] | str, kind: str | None = None) -> DataFrame:
    return json_records(spark, paths, kind=kind).select(
        *_fields("lineid", "terminus_pointid", "direction", "destination"), *PLACE,
    ).dropna(subset=["lineid", "terminus_pointid", "direction"])


def scan_line_shapes(spark: SparkSession, paths: list[str] | str, kind: str | None = None) -> DataFrame:
    """Shape attributes with ``path``: array of (seq, lon, lat)."""
    r = F.col("record")
    return json_records(spark, paths, kind=kind).where(F.length(r["geom_wkt"]) > 0).select(
        *_fields("lineid", "direction"), to_int(r["variant"]).alias("variant"),
        *_fields("mode", "route_color", "route_text_color"), linestring_points(r["geom_wkt"]).alias("path"), *PLACE,
    ).dropna(subset=["lineid", "direction", "path"])


def shape_vertices(shapes: DataFrame) -> DataFrame:
    return shapes.select("lineid", "direction", F.inline("path"))


def documents(spark: SparkSession, paths: list[str] | str, placed: bool = False) -> DataFrame:
    """Items of document files; ``placed`` adds their place, ``file`` and ``row_no``."""
    files = spark.read.text(paths, wholetext=True)
    if placed:
        files = files.select("value", F.col("_metadata.file_path").alias("file"))
    return document_items(files)


def document_items(files: DataFrame) -> DataFrame:
    """Items of JSON documents (``value``: one file's text), one ``item`` text
    each, besides the other columns; next to a column ``file`` also the item's ``row_no``.
    A file is an array or a page object with results, data or items, or holds one item
    per line."""
    page = F.from_json("value", "results array<string>, data array<string>, items array<string>")
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(
        F.coalesce(page["results"], page["data"], page["items"]))
    items = F.coalesce(listed, F.split("value", "\n"))
    kept = [c for c in files.columns if c != "value"]
    if "file" in kept:
        return files.select(*kept, F.posexplode(items).alias("row_no", "item")).where(F.trim("item") != "")
    return files.select(*kept, F.explode(items).alias("item")).where(F.trim("item") != "")


def _places(items: DataFrame) -> list[str]:
    return [c for c in PLACE if c in items.columns]


def _nested(parsed: Column, *names: str) -> tuple[Column, Column]:
    """(text, parsed value) of a field that holds JSON directly or as text; the
    value is NULL where the text is not JSON."""
    raw = first_truthy(parsed, *names)
    return raw, F.try_parse_json(raw)


def decode_stop_documents(items: DataFrame) -> DataFrame:
    """Stop documents to stop rows; those without id or coordinates are dropped.
    A name is a bilingual object, such an object in text, or plain text."""
    def stop(doc: Column) -> Column:
        gps = _nested(doc, "gpscoordinates", "gpsCoordinates")[1]
        name, names = _nested(doc, "name")

        def localised(language: str) -> Column:
            return F.when(names.isNull(), name).otherwise(F.try_variant_get(names, f"$.{language}", "string"))

        return F.struct(
            first_truthy(doc, "id", "pointId", "pointid").alias("pointid"), localised("fr").alias("stop_name_fr"),
            localised("nl").alias("stop_name_nl"), to_double(first_truthy(gps, "longitude", "lon", "lng")).alias("lon"),
            to_double(first_truthy(gps, "latitude", "lat")).alias("lat"))

    docs = F.array(F.try_parse_json("item"))
    return items.select(*_places(items), F.inline(F.transform(docs, stop))).dropna(subset=["pointid", "lon", "lat"])


def decode_line_documents(items: DataFrame) -> DataFrame:
    """Stops-by-line documents to (lineid, direction, sequence_idx, pointid,
    destination). A point without a usable order takes its place in the list. Items with
    a place keep it, and ``point_no`` tells a point's place in its document."""
    place = _places(items)
    docs = items.select(*place, F.try_parse_json("item").alias("doc"))
    named, names = _nested(F.col("doc"), "destination")
    is_object = F.schema_of_variant(F.col("names")).startswith("OBJECT")
    opened = docs.select(
        *place, first_truthy(F.col("doc"), "lineid", "lineId").alias("lineid"),
        F.try_variant_get("doc", "$.direction", "string").alias("direction"), named.alias("named"), names.alias("names"),
        F.from_json(F.try_variant_get("doc", "$.points", "string"), "array<variant>").alias("points"))

    def point(p: Column, i: Column) -> Column:
        quoted = F.schema_of_variant(F.try_variant_get(p, "$.order", "variant")) == "STRING"
        order = F.when(quoted, to_int(F.try_variant_get(p, "$.order", "string"))).otherwise(
            F.try_variant_get(p, "$.order", "double").cast("int"))
        return F.struct(F.coalesce(order, i + 1).alias("sequence_idx"), *([i.alias("point_no")] if place else []),
                        first_truthy(p, "id", "pointId", "pointid").alias("pointid"))

    return opened.select(
        *place, "lineid", "direction", F.explode(F.transform("points", point)).alias("point"),
        F.when(is_object, first_truthy(F.col("names"), "fr", "nl")).otherwise(F.col("named")).alias("destination"),
    ).select(*place, "lineid", "direction", "point.*", "destination").dropna(subset=["lineid", "direction", "pointid"])


def terminus_of(line_stops: DataFrame) -> DataFrame:
    """The last stop of every line direction. Where two directions of a line end
    at the same stop, the later direction name is kept."""
    last = F.max_by(F.struct("pointid", "destination"), F.struct("sequence_idx", "pointid"))
    ends = line_stops.groupBy("lineid", "direction").agg(last.alias("_last")).select(
        "lineid", F.col("_last.pointid").alias("terminus_pointid"), "direction",
        F.col("_last.destination").alias("destination"))
    return earliest_per_key(ends, ["lineid", "terminus_pointid"], ["direction"], latest=True)
