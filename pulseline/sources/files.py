"""Finding dump files and reading JSON-lines records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dataset kinds in load order; later ones read earlier ones.
LOAD_ORDER = ["static_stops", "static_line_stops", "static_line_terminus", "static_line_shapes",
              "assignments", "positions", "waiting_times"]
DUMPS = "*.{jsonl,json,csv}.gz"
RECORD_DUMPS = "*.{jsonl,json}.gz"
CSV_DUMPS = "*.csv.gz"


def kind_of(path: Column) -> Column:
    """Dataset kind of a dump from its lower-cased path. Mirrored pings end in
    .json.gz, as Spark names them; all other records in .jsonl.gz."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    folders = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    jsonl = name.endswith(".jsonl.gz")

    def inside(folder: str) -> Column:
        return F.array_contains(folders, folder)

    catalogue = F.when(
        inside("static") & name.isin("stops.jsonl.gz", "line_stops.jsonl.gz", "line_terminus.jsonl.gz",
                                     "line_shapes.jsonl.gz"),
        F.concat(F.lit("static_"), F.substring_index(name, ".", 1)))
    return (
        F.when(name.startswith("assignments") & name.endswith(".csv.gz"), "assignments")
        .when(catalogue.isNotNull(), catalogue)
        .when(jsonl & (name.startswith("wt") | inside("waiting_times")), "waiting_times")
        .when((jsonl | name.endswith(".json.gz")) & inside("positions"), "positions")
        .otherwise("unknown")
    )


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind) of every dump under ``paths``, unknown kinds included.

    The binary-file source lists the files; their content is not read.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", DUMPS).load(paths).select("path")
    )
    return listed.withColumn("kind", kind_of(F.col("path")))


def in_load_order(files: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in LOAD_ORDER]), F.col("kind"))
    return files.orderBy(F.when(rank == 0, 99).otherwise(rank), F.substring_index("path", "/", -1))


def text_lines(spark: SparkSession, paths: list[str] | str, kind: str | None = None, names: str = RECORD_DUMPS) -> DataFrame:
    """Lines with their place: ``file`` and a ``row_no`` that grows along a file.
    With ``kind``, ``paths`` are folders searched for the dumps of that kind; the
    test on the path prunes the other files before anything is read."""
    reader = spark.read
    if kind:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    lines = reader.text(paths)
    if kind:
        lines = lines.where(kind_of(F.col("_metadata.file_path")) == kind)
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"))


def json_records(spark: SparkSession, paths: list[str] | str, spread: int | None = None,
                 kind: str | None = None) -> DataFrame:
    """One ``record`` map<string,string> per JSON object line; blank and
    malformed lines are skipped. A map keeps "key is null" apart from "no such
    key". ``spread`` shuffles the lines out of few unsplittable gzip files
    before they are parsed."""
    lines = text_lines(spark, paths, kind).where(F.trim("value") != "")
    if spread:
        lines = lines.repartition(spread)
    return lines.withColumn("record", F.from_json("value", "map<string,string>")).where("record is not null").drop("value")


def csv_records(spark: SparkSession, paths: list[str] | str, fields: list[str], required: list[str],
                kind: str | None = None) -> DataFrame:
    """Text columns ``fields`` of CSV files that may order their columns differently, each by its own header: the line
    that names all ``required`` fields. Fields a file does not have are NULL, files without a header have no rows."""
    lines = text_lines(spark, paths, kind, CSV_DUMPS).select("file", F.regexp_replace("value", "^\uFEFF|\r$", "").alias("value"))
    named = F.lit(True)
    for name in required:
        named = named & F.col("value").contains(name)
    width = lines.where(named).agg(F.max(F.size(F.split("value", ",")))).first()[0]
    if width is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in fields))
    parsed = F.from_csv("value", ", ".join(f"c{n} string" for n in range(width)))
    cells = lines.where(F.trim("value") != "").select("file", parsed.alias("_row")).select(
        "file", F.array(*[F.col("_row")[f"c{n}"] for n in range(width)]).alias("cells"))
    is_header = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "cells")) == 0
    # One row per file.
    headers = cells.where(is_header).groupBy("file").agg(F.min("cells").alias("header"))
    return cells.where(~is_header).join(headers, "file").select(
        *[F.get("cells", (F.array_position("header", c) - 1).cast("int")).alias(c) for c in fields])
