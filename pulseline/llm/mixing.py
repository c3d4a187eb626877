"""Mixing sources to target weights, with exact budgets.

Sizes are words. Sources, in the order of their names' code points with null last,
have the weights 3, 1, 2, 3, 1, 2, ...; together they are to give 150 % of all words,
none more than twice its own. What a source cannot give is shared by weight among the
others until none is above: targets are ``min(2 * size, level * weight)`` for the one
level at which they add up, found from running sums over the (few) sources.

Inside a source every document has a hash-random key. Keys are cut into ranges of
about ``RANGE_ROWS`` documents; sums run inside a range, and ranges are joined by the
running sum over their totals, one row each. So a source of any size is sorted in
parts, by any number of tasks. The source's budget is its target rounded to whole
words. It repeats whole epochs while they fit, and the last one is cut at the exact
budget, inside a document if need be: what is taken adds up to the budget, and no
document gives more than twice its words.

Defined results: a null text has no words; a document without words gives none, and so
does a source without any. Null is a source of its own. The order of a source's
documents depends on doc_id, text and size only, so repeated rows share a key and any
run agrees; of fully equal rows it does not matter which is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
RANGE_ROWS = 1 << 13
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds ``target``."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("place") % len(WEIGHTS) + 1)
    weighed = (sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
               .withColumn("cap", F.lit(float(MOST)) * F.col("source_size")))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("goal", SHARE * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("full")) / F.col("open"))
        # caps fill up in this order; the first source whose cap exceeds its level sets the level for the rest
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    )
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and with
    ``carry`` the whole row as a struct ``row``."""
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    kept = [F.struct(*docs.columns).alias("row")] if carry else []
    sized = materialise(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size"), F.md5(F.concat_ws(":", *identity)).alias("key"), *kept), "sized")
    totals = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    planned = materialise(
        targets(totals.select("source", "source_size"))
        .join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
        .select("s", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest"),
                F.ceil(F.col("rows") / RANGE_ROWS).cast("long").alias("ranges")), "planned")
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = (sized.join(planned, F.col("source").eqNullSafe(F.col("s"))).drop("s")
              .withColumn("range", F.shiftright(head * F.col("ranges"), 32)))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
            .select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("before")))
    placed = (ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))))
    cut = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.col("inside")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"),
                         *(["row"] if carry else []))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself with the columns of ``docs``: a document once for each time that
    it is taken whole, and cut to its first words where the budget ends inside it."""
    taken = mix(docs, carry=True).where("taken > 0")
    none = F.array().cast("array<long>")
    copies = F.concat(
        F.when(F.col("taken") >= F.col("size"), F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))).otherwise(none),
        F.when(F.col("taken") % F.col("size") > 0, F.array(F.lit(0).cast("long"))).otherwise(none))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), (F.col("taken") % F.col("size")).cast("int")), " ")
    parts = taken.withColumn("copy", F.explode(copies)).withColumn(
        "row", F.col("row").withField("text", F.when(F.col("copy") == 0, first).otherwise(F.col("row.text"))))
    return parts.select("row.*").select(*docs.columns)
