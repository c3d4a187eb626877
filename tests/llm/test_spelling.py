import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from pulseline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word int, n string"


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def without_one(w):
    return {w[:k] + w[k + 1:] for k in range(len(w))}


def brute_groups(counts):
    """Words one edit apart share what is left of both with one letter less, or one of them is such a rest."""
    rests = defaultdict(set)
    for w in counts:
        for rest in {w} | without_one(w):
            rests[rest].add(w)
    rows = {}
    for w, n in counts.items():
        near = [o for o in set().union(*(rests[r] for r in {w} | without_one(w))) if one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        rows[w] = (best if best and counts[best] >= 5 * n else None, len(near))
    def root(w):
        return root(rows[w][0]) if rows[w][0] else w
    return sorted((w, f, root(w), counts[w], k, counts[f] if f else None) for w, (f, k) in rows.items())


def run(spark, rows):
    got = spelling.variants(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed):
    rng = random.Random(seed)
    letters = "abéÿn÷"
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 12]))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    words = []
    for w in bases:
        for _ in range(6):
            k = rng.randrange(len(w))
            other = rng.choice([w, w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])
            words += [other] * rng.choice([4, 5, 6, 30, 200])
    rng.shuffle(words)
    return [(k, rng.choice([" ", "-", "5", "Ā"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[k::40])) for k in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    wanted = brute_groups(brute_counts(rows))
    assert run(spark, rows) == wanted and sum(r[1] is not None for r in wanted) > 10


def test_whole_table_equals_brute_force(spark):
    from pulseline.llm.queries import registered
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in registered()["op13_spelling"](spark, folder).collect())
    assert got == brute_groups(brute_counts(rows))


def test_awkward_rows(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (None, "wonder " * 9), (3, "WONDER wÉnder"), (3, "WONDER wÉnder"), (4, "short " * 50), (5, "12 _ ß×" * 3), (6, "wınder" * 9)]
    assert run(spark, rows) == brute_groups(brute_counts(rows))
    assert [r[0] for r in run(spark, [(None, "wonder " * 5 + "wander " * 25)])] == ["wander", "wonder"]


def test_very_long_words_and_texts(spark, monkeypatch):
    long = "ab" * 30_000
    rows = [(None, f"{long} {long[1:]} {long}\n" * 5), (None, (long[:-1] + "x ") * 30)]
    assert run(spark, rows) == sorted([
        (long, None, long, 10, 2, None), (long[1:], None, long[1:], 5, 1, None),
        (long[:-1] + "x", None, long[:-1] + "x", 30, 1, None)])
    text = "wonder wander, winter " * 200 + "w" * 99
    counts = Counter(w for p in spelling.pieces(text, 7) for w in RUN.findall(p))
    assert counts == Counter(RUN.findall(text)) and "".join(spelling.pieces(text, 7)) == text


def test_lists_in_blocks(spark, monkeypatch):
    """A list much longer than a block gives what it gives as one."""
    rng = random.Random(5)
    counts = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.choice([5, 6]))): rng.randint(5, 900) for _ in range(400)}
    monkeypatch.setattr(spelling, "BLOCK", 30)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best) for r in spelling.near_words(words).collect()}
    for w in counts:
        near = [o for o in counts if one_edit(w, o)]
        assert got.get(w, (0, None)) == (len(near), min(near, key=lambda o: (-counts[o], o), default=None))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k:02}", f"w{k + 1:02}") for k in range(20)] + [("x", "w05")]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w20" for w, _ in chain}
