"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm import codec, licences, mixing, near_dup, nearest, prefix_trie, quality, repeats, revisits, simhash, spelling, token_counts, toxicity
from pulseline.llm.oracles import ORACLES
from pulseline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return nearest.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of the pages: each is captured in full once, a minute after
    the one before, and asked for again 600 minutes later under another spelling of its
    URL, which is answered by a revisit. What the revisit carries goes round by page."""
    etag, modified = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    turn = F.pmod("page_id", F.lit(8))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 60).alias("captured_at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), modified,
                     F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.lit("origin")).alias("headers"),
        F.md5("html").alias("digest"), F.col("html").alias("payload"))
    validator = (
        F.when(turn < 4, F.create_map(F.lit("ETag"), etag))
        .when(turn == 4, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), etag)))
        .when(turn == 5, F.create_map(F.lit("last-modified"), modified))
        .when(turn == 6, F.create_map(F.lit("ETag"), F.lit('"other"')))
        .otherwise(F.create_map(F.lit("Server"), F.lit("edge"))))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (F.col("page_id") * 60 + 36000).alias("captured_at"), F.lit("revisit").alias("kind"),
        F.map_concat(F.create_map(F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Type"), F.lit("text/plain"),
                                  F.lit("Cache-Control"), F.lit("max-age=600")), validator).alias("headers"),
        F.when(turn == 7, F.md5("html")).alias("digest"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(again)


def op5_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit with the response it stands for; payloads as digests."""
    resolved = revisits.resolve(captures(table(spark, folder, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select("record_id", "canonical_url", "refers_to", "outcome", F.array_join(lines, "\n").alias("headers"),
                           F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), window=50, joined=True)
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op8_codec(spark: SparkSession, folder: str) -> DataFrame:
    coded = codec.encoded(table(spark, folder, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_exact").alias("round_trip"), F.col("_ids").alias("ids"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return rated.select("doc_id", "_n.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), size=3, distance=3)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def registered() -> dict[str, Query]:
    return {run.__name__: run for run in (
        op1_nearest, op2_near_dup, op3_mixing, op4_token_counts, op5_revisits, op6_repeats, op7_licences, op8_codec,
        op9_quality, op10_toxicity, op11_prefix_trie, op12_simhash, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
