import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pulseline.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, labels string, words int"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def places(words, phrase):
    parts = phrase.split()
    return [i for i in range(len(words)) if words[i:i + len(parts)] == parts]


def brute(rows):
    split = [(i, words_of(t)) for i, t in rows]
    df = {w: sum(w in ws for _, ws in split) for w in licences.VOCABULARY}
    rarity = {w: round(1e6 * math.log((len(rows) + 1) / (n + 1))) + 1 for w, n in df.items()}
    result = []
    for i, words in split:
        base = {label: places(words, phrase) for phrase, label in licences.BASE if places(words, phrase)}
        at = sorted(p for found in base.values() for p in found)
        accepted = {}
        for label, notice, key in licences.TEMPLATES:
            template = notice.split()
            rare = sorted(set(template), key=lambda w: (-rarity[w], w))[:licences.LOOKUPS]
            posts = [(w, k) for k, w in enumerate(template) if w in rare]
            best = max((sum(rarity[w] for w, k in posts if 0 <= o + k < len(words) and words[o + k] == w)
                        for o in range(-len(template), len(words) + 1)), default=0)
            score = best / float(sum(rarity[w] for w, _ in posts))
            if places(words, key) and score >= licences.ENOUGH:
                accepted[label] = max(score, accepted.get(label, 0))
        result.append((i, len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)),
                       ",".join(sorted({*base, *accepted})), 1.0 if base else max(accepted.values(), default=0.0)))
    return sorted(result, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in licences.scan(df).collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    notices = [n for _, n, _ in licences.TEMPLATES] + [p for p, _ in licences.BASE] + [k for *_, k in licences.TEMPLATES]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(["the", "of", "mit", "und", "license", "wort", "é", "2", "by"]) for _ in range(rng.randint(0, 12))]
            notice = rng.choice(notices).split()
            if rng.random() < 0.4 and len(notice) > 2:
                notice.pop(rng.randrange(len(notice)))
            words += notice
        rows.append((k, "".join(w.upper() + rng.choice([" ", ", ", "-", "\n"]) if rng.random() < 0.3 else w + rng.choice([" ", ". "]) for w in words)))
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(1 for r in got if r[6] != r[5]) > 5 and any(not r[5] and r[6] for r in got)


@pytest.mark.parametrize("text,labels,n", [
    ("Released under the MIT License.", "mit", 1), ("cc-by-nc CC BY NC", "cc-by-nc", 2), ("Apache License, Version 2.0", "apache-2", 1),
    ("under the mit-license under the MIT license", "mit", 2)])
def test_base_phrases(spark, text, labels, n):
    row = run(spark, [(1, text), (2, "other words")])[0]
    assert row[2] == n and row[5] == labels and labels in row[6].split(",") and row[7] == 1.0


def test_words_are_cut_not_matched(spark):
    texts = [None, "", " ", "\n", "a", " a", "a ", ",a,,b-C.", "\x00a\x7fb\x1f", "a\u00a0b\u2028c", "1a_2", "\U0001F600 x\U0001F600y", "ÀB É", "a" * 999 + "!" * 999, "..--.."]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", licences.words_of(F.col("text")).alias("words"))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.words for r in found.collect()} == {k: WORD.findall((t or "").lower()) for k, t in enumerate(texts)}


def test_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, " .,;"), (4, "word " * 30_000 + "cc by nc"), (4, "word " * 30_000 + "cc by nc"), (None, "under the mit license"),
            (5, "under the mit"), (6, "the mit license"), (7, "É\x7f\x00ß")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
