"""Documents to training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes what a stage returns to the shared folder
as Parquet and reads it again as the next stage's input.

1. quality: documents that the base rules or the log-likelihood ratio reject go.
2. near duplicates: five-word shingles, similarity of 0.8 or more; one row of each
   group stays, that of the smallest doc_id. Rows without doc_id stay, and so do texts that share
   a doc_id and nothing else.
3. repeats: words of 50-word windows that an earlier document has are cut out; the rest
   of a text keeps its white space. A document whose words all go leaves no row.
4. mixing: what the targets take of each source; a document taken twice is two rows,
   and the one at which a source's budget ends is cut there.
5. sequences: SentencePiece ids, with the columns of documents before them.

Columns may have any names. Those named like what a stage adds (``n_tokens``, ``round_trip``, ``ids``
in the last one) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseline.durable import materialise
from pulseline.llm import codec, mixing, near_dup, quality, repeats
from pulseline.llm.rows import packed, unpacked
from pulseline.session import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = quality.judged(packed(docs, "doc_id", "text"), labels).where("_kept")
    return unpacked(rated, docs.columns, ["doc_id", "text"], [])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.one_of_each(docs, size=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = repeats.without_repeats(packed(docs, "doc_id", "text"), window=50)
    left = cut.where("_n_removed = 0 or _n_removed < _n_words")
    return unpacked(left, docs.columns, ["doc_id", "text"], [])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    coded = codec.encoded(packed(docs, "text"))
    found = coded.withColumnsRenamed({"_n_tokens": "n_tokens", "_exact": "round_trip", "_ids": "ids"})
    return unpacked(found, docs.columns, ["text"], ["n_tokens", "round_trip", "ids"])


STAGES = [("quality", keep_good), ("near_duplicates", one_of_each), ("repeats", without_repeats), ("mixing", mixed), ("sequences", sequences)]

#: Log-likelihood ratios and subword ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
