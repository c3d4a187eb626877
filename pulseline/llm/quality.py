"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.

Every word and every pair of successive words is hashed into one of ``BUCKETS``. Two
multinomials over the buckets are compared: the raw corpus, counted over all documents,
and the trusted target, counted over documents labelled as good. A document's score is
the mean over its n-grams of ``ln(target share) - ln(raw share)``, with ``SMOOTHING``
added to each count, so its length plays no part. It is kept if the score reaches the
threshold, which is fitted once: the cut that tells the labelled documents apart
best, counting a lost good document ``CARE`` times. Target and threshold are taken from
all labelled documents.

All of it is DataFrame expressions. Raw counts and scores read the texts where they
lie. For the target counts the texts are shuffled once, to meet their labels; for the
threshold labels meet scores alone. Costs of cuts are running sums inside score ranges of
``SCORE_STEP``. The driver sees the model, ``BUCKETS`` weights and one threshold, and one
row per score range.

Defined results: a null text, an empty one and one without words has counts of zero
and fails the base rules. Without usable labels of both kinds the method keeps what
the base rules keep. Rows repeated in ``labels`` count once; if they disagree, bad wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.llm.rows import packed, unpacked

WORD = r"[^\x20\x09-\x0D]+"
BETWEEN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
BUCKETS = 4096
SMOOTHING = 1.0
SCORE_STEP = 1 / 2048
CARE = 20
WINDOW = 5


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Cut between words, which costs less than a match for each. What stands before a text's first word and after
    its last one is empty."""
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def hash_of(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def zipped(values: Column, distance: int, combine) -> Column:
    """``combine`` of each element and the one ``distance`` places on."""
    rest = F.greatest(F.size(values) - distance, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(distance + 1), rest), combine)


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_words``, ``_hashes``, one per word, and ``_pairs``, one per pair of successive words."""
    cut = rows.withColumn("_words", words_of(F.col("text").cast("string")))
    return cut.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_pairs", zipped(F.col("_hashes"), 1, hash_of))


def n_repeat_words(hashes: Column, fours: Column) -> Column:
    """Words inside a 5-word window that stands twice or more. ``hashes``: one per word; ``fours``: one per
    4-word window. A 5-word window can stand twice only if its first four words do, so most texts need no more."""
    def covered(starts: Column) -> Column:
        steps = zipped(starts, 1, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, step: total + step)

    def repeated(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        equal = let(placed, lambda s: F.flatten(zipped(s, 1, lambda a, b: F.when(
            a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        return let(F.sort_array(F.array_distinct(equal)), lambda starts: F.when(F.size(starts) > 0, covered(starts)).otherwise(F.lit(0)))

    rest = F.greatest(F.size(fours) - 1, F.lit(0))
    grams = F.zip_with(F.slice(fours, F.lit(1), rest), F.slice(hashes, F.lit(WINDOW), rest), hash_of)
    return F.when(F.size(F.array_distinct(fours)) < F.size(fours), let(grams, repeated)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) with ``_n``: the counts of the base rules, ``_hashes`` and ``_pairs``."""
    text = F.col("text").cast("string")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def n_dup_lines(every: Column) -> Column:
        with_words = F.filter(every, lambda line: line.rlike(WORD))
        return F.when(F.size(F.array_distinct(every)) < F.size(every), let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))

    fours = hashed(docs).withColumns({"_fours": zipped(F.col("_pairs"), 2, hash_of), "_lines": lines})
    return fours.withColumn("_n", F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        n_dup_lines(F.col("_lines")).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("_hashes"), F.col("_fours")).alias("n_repeat_words"),
    )).drop("_words", "_fours", "_lines")


def base_failed(n: Column) -> Column:
    return (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])


def bucket(hash_: Column) -> Column:
    """The remainder modulo ``BUCKETS``, a power of two."""
    return hash_.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


@dataclass
class Model:
    weights: list[float]
    threshold: float

    def score(self, hashes: Column, pairs: Column) -> Column:
        """Mean log-likelihood ratio of the n-grams; null without any."""
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")

        def added(found: Column, start: Column) -> Column:
            return F.aggregate(found, start, lambda total, h: total + F.get(weights, bucket(h)))
        total = added(pairs, added(hashes, F.lit(0.0))) / (F.size(hashes) + F.size(pairs))
        return F.when(F.size(hashes) > 0, total)


def labelled(labels: DataFrame) -> DataFrame:
    """Labelled documents (_label_id, _good)."""
    usable = labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("quality").cast("int").alias("quality"))
    return usable.where("_label_id is not null and quality in (0, 1)").groupBy("_label_id").agg((F.min("quality") == 1).alias("_good"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, same = labelled(labels), F.col("doc_id") == F.col("_label_id")

    def counts(rows: DataFrame) -> list[float]:
        found = [SMOOTHING] * BUCKETS
        for row in hashed(rows).select(F.explode(F.concat("_hashes", "_pairs")).alias("hash")).groupBy(bucket(F.col("hash")).alias("bucket")).count().collect():
            found[row["bucket"]] += row["count"]
        return found

    raw, target = counts(texts), counts(texts.join(known.where("_good").hint("merge"), same))
    shift = math.log(sum(raw)) - math.log(sum(target))
    model = Model([round(math.log(t) - math.log(r) + shift, 9) for t, r in zip(target, raw)], -math.inf)
    # No filter on the number of words: it would go down to the scan and cut each text a second time.
    score = F.when(F.size("_hashes") >= 10, model.score(F.col("_hashes"), F.col("_pairs"))).alias("score")
    model.threshold = fitted_cut(hashed(texts).select("doc_id", score).join(known, same).select("_good", "score"))
    return model


def fitted_cut(scored: DataFrame) -> float:
    """``best_cut`` of any number of rows (score, _good); those without a score take no part."""
    steps = scored.groupBy("score").agg(
        F.count(F.when(F.col("_good"), 1)).alias("good"), F.count(F.when(~F.col("_good"), 1)).alias("bad"))
    steps = steps.withColumns({"part": F.floor(F.col("score") / F.lit(SCORE_STEP)), "step": CARE * F.col("good") - F.col("bad")})
    inside = Window.partitionBy("part").orderBy("score")
    ordered = steps.withColumns({"cost": F.sum("step").over(inside), "above": F.lead("score").over(inside)})
    parts = ordered.groupBy("part").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("step").alias("step"),
        F.min("score").alias("low"), F.max("score").alias("high"),
        F.min(F.when(F.col("above").isNotNull(), F.struct("cost", "score", "above"))).alias("least")).orderBy("part").collect()
    parts = [p for p in parts if p.part is not None]
    if not sum(p.good for p in parts) or not sum(p.bad for p in parts):
        return -math.inf
    cost = best = 0  # beside that of keeping all
    cut = -math.inf
    for part, after in zip(parts, [*parts[1:], None]):
        if part.least and cost + part.least.cost < best:
            best, cut = cost + part.least.cost, (part.least.score + part.least.above) / 2
        cost += part.step
        if after and cost < best:
            best, cut = cost, (part.high + after.low) / 2
    return cut


def best_cut(scored: list[tuple[float, bool]]) -> float:
    """The score from which documents are kept: least cost, a lost good one counting
    ``CARE`` bad ones kept; halfway between neighbours, the lowest such cut."""
    scored = sorted(scored)
    if not scored or all(good for _, good in scored) or not any(good for _, good in scored):
        return -math.inf
    cost = best = sum(not good for _, good in scored)
    cut = -math.inf
    for n, (score, good) in enumerate(scored):
        cost += CARE if good else -1
        above = scored[n + 1][0] if n + 1 < len(scored) else score
        if cost < best and above > score:
            best, cut = cost, (score + above) / 2
    return cut


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``_n`` (struct of counts), ``_base_failed``, ``_score`` and ``_kept``; own columns of
    these names are replaced, all others stay whatever their names are."""
    model = fit(docs, labels)
    scored = measured(packed(docs, "text")).withColumn("_score", model.score(F.col("_hashes"), F.col("_pairs"))).withColumn("_base_failed", base_failed(F.col("_n")))
    passed = F.col("_score") >= F.lit(model.threshold) if math.isfinite(model.threshold) else F.lit(True)
    rated = scored.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(passed, F.lit(False)))
    return unpacked(rated, docs.columns, ["text"], ["_n", "_base_failed", "_score", "_kept"])
