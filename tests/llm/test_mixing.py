import random
import re
from collections import defaultdict

import pytest

from pulseline.llm import mixing

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, taken int"


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes):
    """Rounds of sharing out by weight, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[n % 3] for n, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = (goal - sum(full.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not above:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in above}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "size", 1) for i, t, s in rows], SCHEMA)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    return [(k, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40, 400]))), rng.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("seed,sources", [(1, ["a", "b", "c", "d"]), (2, ["a"] * 9 + ["b", "Z", None]), (3, ["é", "z", "\U0001F600", "￮"])])
def test_targets_and_exact_budgets(spark, seed, sources, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)  # several ranges per source
    rows = corpus(seed, 200, sources)
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    by_id = {i: (t, s) for i, t, s in rows}
    for i, t, s in rows:
        sizes[s] += size(t)
    wanted = brute_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        t, s = by_id[r.doc_id]
        assert (r["size"], r.source_size) == (size(t), sizes[s]) and r.target == pytest.approx(wanted[s], rel=1e-12)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 0.5
    assert len([1 for r in got if r["size"] and r.taken % r["size"]]) <= len(sizes)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1000)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert sum(r.taken for r in again) == sum(r.taken for r in got)


def test_reruns_agree(spark):
    rows = corpus(5, 120, ["a", "b", None]) * 2  # repeated rows
    one = sorted(mixing.mix(frame(spark, rows)).collect())
    assert one == sorted(mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect())


def test_awkward_rows(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    rows = [(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, " \t\x0b\x0c\r\n", None), (4, "a b c\x1cd", "y")]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert [got[i]["size"] for i in (None, 1, 2, 3, 4)] == [2, 0, 0, 0, 2]
    assert got[2].source_size == 0 and got[2].target == 0 and got[2].taken == 0
    assert got[None].taken + got[4].taken == 6


def test_rows_of_the_mix(spark):
    rows = [(k, " ".join(f"d{k}w{n}" for n in range(k % 9)), "abc"[k % 3]) for k in range(60)]
    df = frame(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    words, texts = defaultdict(int), {i: t for i, t, _ in rows}
    for r in mixed.collect():
        words[r.doc_id] += size(r.text)
        assert r["size"] == "size" and texts[r.doc_id].startswith(r.text) and r.text
    assert {i: n for i, n in taken.items() if n} == dict(words)
