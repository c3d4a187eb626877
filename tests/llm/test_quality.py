import math
import random
import re
from collections import Counter

import pytest
import xxhash

from pulseline.llm import quality

WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, n_words int, quality string"


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def word_hash(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def pair_hash(a, b):
    first = xxhash.xxh64(a.to_bytes(8, "little", signed=True), seed=42).intdigest()
    return signed(xxhash.xxh64(b.to_bytes(8, "little", signed=True), seed=first).intdigest())


def counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def buckets(text):
    h = [word_hash(w) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in h] + [pair_hash(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]


def brute(rows, labels):
    good = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            good[i] = min(good.get(i, 1), q)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if good.get(i) == 1:
            target.update(buckets(t))
    n_raw, n_target = (sum(c.values()) + quality.BUCKETS for c in (raw, target))
    weight = [round(math.log(target[b] + 1) - math.log(raw[b] + 1) + math.log(n_raw) - math.log(n_target), 9) for b in range(quality.BUCKETS)]

    def score(text):
        own = buckets(text)
        return sum(weight[b] for b in own) / len(own) if own else None

    scored = [(score(t), good[i] == 1) for i, t in rows if i in good and len(WORD.findall(t or "")) >= 10]
    cut = quality.best_cut(scored)
    result = []
    for i, t in rows:
        n = counts(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        s = score(t)
        result.append((i, *n, failed, not failed and (cut == -math.inf or s >= cut)))
    return sorted(result, key=repr)


def run(spark, rows, labels):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS)
    known = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    rated = quality.judged(df, known).select("doc_id", "_n.*", "_base_failed", "_kept")
    return sorted((tuple(r) for r in rated.collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    fine, junk = [f"fine{k}" for k in range(80)], [f"junk{k}$$" for k in range(80)]
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(junk if bad and rng.random() < 0.7 else fine) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.3:
            start = rng.randrange(len(words))
            words[start:start] = words[start:start + rng.randint(4, 9)] * rng.randint(1, 4)
        rows.append((k, "".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words)))
        if rng.random() < 0.5:
            labels.append((k, 0 if bad else 1))
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows, labels = corpus(seed, 150)
    got = run(spark, rows, labels)
    assert got == brute(rows, labels)
    good = {i for i, q in labels if q == 1}
    tried = [r for r in got if r[0] in good and not r[6]]
    assert sum(r[7] for r in tried) >= 0.95 * len(tried)
    assert sum(not r[7] for r in got if r[0] in {i for i, q in labels if q == 0}) > 10


@pytest.mark.parametrize("text", ["a b c d e " * 2, "a b c d e f a b c d e", "x " * 30, "a b c d", "a b c d e", "q a b c d e r a b c d e a b c d e z",
                                  "l one\nl one\n\n \nl one\r\nl one", "#*$%&|<> ##", " ".join(str(k % 4999) for k in range(20_000))])
def test_counts(spark, text):
    df = spark.createDataFrame([(1, text, 0, "x")], DOCS)
    assert tuple(quality.measured(df).select("_n.*").first()) == counts(text)


def test_awkward_rows(spark):
    rows, labels = corpus(3, 40)
    rows += [(900, None), (901, ""), (902, "\n \t"), (None, "a b c d e f g h i j k"), (3, rows[3][1]), (903, "é ü " * 10)]
    labels += [(None, 1), (5, None), (6, 7), labels[0], (labels[0][0], 0), (12345, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)
    assert run(spark, [], labels) == []
    assert run(spark, rows, []) == brute(rows, [])


def test_best_cut():
    assert quality.best_cut([]) == quality.best_cut([(1.0, True)]) == quality.best_cut([(1.0, False)]) == -math.inf
    assert quality.best_cut([(0.0, False), (1.0, True)]) == 0.5
    assert quality.best_cut([(0.0, True)] + [(0.1, False)] * 5 + [(1.0, True)]) == -math.inf  # one good costs more than five bad


def test_every_label_counts(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(10 + k % 3))) for k in range(20_600)]
    labels = [(k, int(rng.random() < 0.6)) for k, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    raw, target = Counter(), Counter()
    for (_, text), (_, good) in zip(rows, labels):
        own = buckets(text)
        raw.update(own)
        target.update(own if good else [])
    n_raw, n_target = (sum(c.values()) + quality.BUCKETS for c in (raw, target))
    weights = [round(math.log(target[b] + 1) - math.log(raw[b] + 1) + math.log(n_raw) - math.log(n_target), 9) for b in range(quality.BUCKETS)]
    assert model.weights == weights
    scored = []
    for (_, text), (_, good) in zip(rows, labels):
        own = buckets(text)
        scored.append((sum(weights[b] for b in own) / len(own), good == 1))
    assert model.threshold == pytest.approx(quality.best_cut(scored), rel=1e-12)


@pytest.mark.parametrize("seed", range(6))
def test_cut_over_score_ranges(spark, seed):
    rng = random.Random(seed)
    spread = rng.choice([0.0001, 0.01, 3])
    scored = [(round(rng.gauss(0.5 * good, 1) * spread, 5 if spread < 1 else 2), good) for good in [rng.random() < 0.1 for _ in range(300)]]
    got = quality.fitted_cut(spark.createDataFrame(scored, "score double, _good boolean"))
    assert got == quality.best_cut(scored)
    for only in ([], [(1.0, True)], [(1.0, False)]):
        assert quality.fitted_cut(spark.createDataFrame(only, "score double, _good boolean")) == -math.inf


def test_rows_without_score_take_no_part_in_the_cut(spark):
    schema, missing = "score double, _good boolean", [(None, True), (None, False)] * 30
    scored = [(0.0, False), (0.4, False), (1.0, True)]
    assert quality.fitted_cut(spark.createDataFrame(missing + scored, schema)) == quality.best_cut(scored) == 0.7
    assert quality.fitted_cut(spark.createDataFrame(missing, schema)) == -math.inf


@pytest.mark.parametrize("text", ["a b c d x a b c d y " * 4 + "z", "a b c d q a b c d r", "a a a a", "a a a a a", "a a a a a a", " a b c d e\x0ba b c d e ",
                                  "a b c d e f g h\n\n\n", "same line\n\n\nsame line\n", "\u00a0 \u2003 \U0001f600 #\u00a0", "\x1f a\x1cb \x0c"])
def test_counts_where_only_parts_repeat(spark, text):
    df = spark.createDataFrame([(1, text, 0, "x")], DOCS)
    assert tuple(quality.measured(df).select("_n.*").first()) == counts(text)


def test_texts_are_cut_once_per_pass(spark, tmp_path, monkeypatch):
    """No filter on what is derived from a text, as it goes down to the scan and derives it a second time."""
    rows, labels = corpus(5, 60)
    spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    seen = []
    cut = quality.fitted_cut
    monkeypatch.setattr(quality, "fitted_cut", lambda scored: seen.append(scored) or cut(scored))
    quality.fit(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(labels, "doc_id long, quality int"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\b(?:split|regexp_extract_all)\(text", plan)) == 1
