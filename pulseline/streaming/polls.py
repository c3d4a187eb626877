"""Landed poll payloads to stored positions with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.durable import materialise, scratch_scope
from pulseline.functions import text
from pulseline.operators.positions import ShapeIndex, coerce_pings, typed_pings
from pulseline.plans.pipelines import resolve_against
from pulseline.sinks.tables import Tables
from pulseline.sources.catalogue import document_items
from pulseline.sources.pings import flatten_payload, mirror_records

LATENESS = "10 minutes"


# A poll's time in a file name, as in polls_2026-05-04T09-00-20Z.json.
TIME_IN_NAME = r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})"


def landed_payloads(spark: SparkSession, folder: str, files_per_batch: int = 200,
                    by_modification: bool = False) -> DataFrame:
    """One row per landed file: its text and the time of the poll, which its name tells
    (NULL if it does not). Ping ids contain that time, so it must survive a copy of the
    file; ``by_modification`` takes the time a file was written where nothing else is known."""
    name = F.substring_index("_metadata.file_path", "/", -1)
    day, *clock = [F.regexp_extract(name, TIME_IN_NAME, k) for k in range(1, 5)]
    named = F.when(day != "", F.concat(day, F.lit("T"), F.concat_ws(":", *clock), F.lit("+00:00")))
    written = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return (
        spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch)
        .text(folder, wholetext=True)
        .select("value", (written if by_modification else named).alias("polled"))
    )


def payload_pings(payloads: DataFrame, fetched_at_text: Column | None = None) -> DataFrame:
    """Payload files (``value``, ``polled``) to coerced pings; batch and stream
    alike. ``fetched_at_text`` reads the poll's time from the payload instead."""
    if fetched_at_text is not None:
        payloads = payloads.withColumn("polled", fetched_at_text)
    return coerce_pings(flatten_payload(document_items(payloads), F.col("polled")))


def unique_stream(pings: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each ping id once within the lateness bound, with bounded state."""
    timed = pings.withColumn("event_ts", text.to_instant(F.col("fetched_at_text")))
    return (timed.withWatermark("event_ts", lateness)
            .dropDuplicatesWithinWatermark(["position_id"]).drop("event_ts"))


def start_position_stream(pings: DataFrame, tables: Tables, checkpoint: str, mirror: str | None = None,
                          **trigger):
    """Starts the stream that locates pings and stores each one once.

    Duplicates within the watermark are dropped by the stream; the insert itself
    ignores ids already stored, so a replayed batch or checkpoint adds nothing.
    The shapes are those at the start of the stream.
    """
    index = ShapeIndex.build(tables.read("shape_points"))

    def store(batch: DataFrame, number: int) -> None:
        with scratch_scope(tables.spark):
            landed = materialise(batch, "poll", within=tables.spark)
            if mirror:
                (mirror_records(landed).write.mode("overwrite").option("compression", "gzip")
                 .option("ignoreNullFields", "false").json(f"{mirror.rstrip('/')}/positions/batch={number}"))
            if landed.isEmpty():  # a batch that only moves the watermark on
                return
            tables.insert_positions(resolve_against(tables, typed_pings(landed), index))

    return (unique_stream(pings).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
