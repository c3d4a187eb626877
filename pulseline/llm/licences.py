"""Licence scans by a positional index over rare template words.

Templates are short licence notices. Each posts its ``LOOKUPS`` rarest words, by
inverse document frequency over all documents, with their positions. A text looks up
its licence words, rarest first, and every hit votes for (template, relative position):
place in the text minus place in the template. The weight of the words that agree on
one relative position, over the weight of all words the template posts, is the
template's score there. A template names its label if the score reaches ``ENOUGH`` and
its mandatory key phrase stands in the text.

Base phrases are searched word by word at every place, and their labels always stay.

All of it is array expressions inside a row: nothing is shuffled but one row per
licence word and task for the frequencies. Words that no template has are dropped
before anything is compared, and texts without a rare word of a key phrase stop there.

Defined results: a null or empty text has no words, labels "" and score 0; without a
base phrase first_word and last_word are null. The score is 1 with a base phrase, else
that of the best accepted template, else 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.llm.quality import let

# What stands between words, which are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOOKUPS = 6
ENOUGH = 0.6

# Base phrases and labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Wording of public licence notices (label, notice, mandatory key phrase).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial license", "attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike license", "attribution sharealike"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} | {w for phrase, _ in BASE for w in phrase.split()})


def words_of(text: Column) -> Column:
    """Cut between words, not matched word by word: a match costs the engine far more than a cut. What stands before a
    text's first word and after its last one is empty."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequencies(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each licence word. One row per word."""
    counts = dict(texts.select(F.explode(F.array_append(F.array_intersect("words", _strings(VOCABULARY)), F.lit(""))).alias("word"))
                  .groupBy("word").count().collect())
    return counts.pop("", 0), counts


def rarity(n: int, frequencies: dict[str, int]) -> dict[str, float]:
    """Inverse document frequency in millionths; whole numbers add up the same anywhere."""
    return {w: round(1e6 * math.log((n + 1) / (frequencies.get(w, 0) + 1))) + 1 for w in VOCABULARY}


def _places(words: Column, phrase: str) -> Column:
    """Starts of ``phrase`` among ``words`` (a lambda's variable)."""
    parts = phrase.split()
    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _postings(weights: dict[str, float]) -> list[tuple[str, list[tuple[str, int]], int, str]]:
    """(label, postings, weight of all postings, key phrase) of each template."""
    index = []
    for label, notice, key in TEMPLATES:
        words = notice.split()
        rare = sorted(set(words), key=lambda w: (-weights[w], w))[:LOOKUPS]
        posts = [(w, k) for k, w in enumerate(words) if w in rare]
        index.append((label, posts, sum(weights[w] for w, _ in posts), key))
    return index


def _scores(words: Column, weights: dict[str, float]) -> Column:
    """Array of struct(label, score) of the accepted templates."""
    index = _postings(weights)
    lookups = sorted({w for _, posts, _, _ in index for w, _ in posts})
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(lookups))
    weight = F.create_map(*[x for w in lookups for x in (F.lit(w), F.lit(weights[w]))])

    def one(hits: Column, label: str, posts: list[tuple[str, int]], total: int, key: str) -> Column:
        table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w, k in posts])
        votes = F.flatten(F.transform(hits, lambda h: F.transform(
            F.filter(table, lambda p: p["w"] == h["w"]), lambda p: F.struct((h["i"] - p["k"]).alias("at"), F.element_at(weight, h["w"]).alias("weight")))))
        def agreed(v: Column) -> Column:
            return F.array_max(F.transform(F.array_distinct(F.transform(v, lambda x: x["at"])), lambda at: F.aggregate(
                F.filter(v, lambda x: x["at"] == at), F.lit(0).cast("long"), lambda s, x: s + x["weight"])))
        score = F.coalesce(let(votes, agreed), F.lit(0)) / F.lit(float(total))
        return F.struct(F.lit(label).alias("label"), F.when(F.size(_places(words, key)) > 0, score).otherwise(F.lit(0.0)).alias("score"))

    every = let(hits, lambda h: F.array(*[one(h, *t) for t in index]))
    return F.filter(every, lambda t: t["score"] >= ENOUGH)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text).cast("string")).alias("words"))
    weights = rarity(*document_frequencies(texts))
    triggers = sorted({max(phrase.split(), key=lambda w: (weights[w], w)) for phrase in
                       [p for p, _ in BASE] + [key for _, _, key in TEMPLATES]})

    def found(words: Column) -> Column:
        base = F.array(*[F.struct(F.lit(label).alias("label"), _places(words, phrase).alias("at")) for phrase, label in BASE])
        return F.struct(F.filter(base, lambda b: F.size(b["at"]) > 0).alias("base"), _scores(words, weights).alias("templates"))

    kind = "struct<base:array<struct<label:string,at:array<int>>>,templates:array<struct<label:string,score:double>>>"
    seen = F.when(F.arrays_overlap("words", _strings(triggers)), let(F.col("words"), found).cast(kind))
    at = F.flatten(F.transform("seen.base", lambda b: b["at"]))
    base_labels = F.coalesce(F.transform("seen.base", lambda b: b["label"]), _strings([]))
    labels = F.array_union(base_labels, F.coalesce(F.transform("seen.templates", lambda t: t["label"]), _strings([])))
    best = F.array_max(F.transform("seen.templates", lambda t: t["score"]))
    return (
        texts.withColumn("seen", seen)
        .select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_base"),
                F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
                F.array_join(F.sort_array(F.array_distinct(base_labels)), ",").alias("base_labels"),
                F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"),
                F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
    )
