import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulseline.llm import near_dup
from pulseline.llm.components import components

SCHEMA = "doc_id long, text string, n_shingles string, component_id int"
WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    postings = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in postings[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            postings[s].append(i)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in rows)


def corpus(seed, n_groups=25):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    rng.shuffle(texts)
    return [(k * 3 + 7, t) for k, t in enumerate(texts)]


def run(spark, rows, size=3, percent=85):
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], SCHEMA)
    return sorted(tuple(r) for r in near_dup.near_duplicates(df, size, percent).collect())


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)  # groups fall into several blocks
    rows = corpus(4)
    assert run(spark, rows, size, percent) == brute(rows, size, percent)


def test_awkward_texts(spark):
    long = " ".join(f"x{k % 977}y{k % 13}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "one \n two"),
            (9, long), (10, long + " end"), (11, "É é"), (12, "é é"), (13, "a b c"), (13, "a b c")]
    got = run(spark, rows)
    assert got == sorted([*brute(rows[:-1], 3, 85), (13, 1, 13, True)])
    assert dict((r[0], r[2]) for r in got)[8] == 6 and dict((r[0], r[2]) for r in got)[10] == 9


def test_null_ids_and_empty_table(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d", "", 0), (2, "a b c d", "", 0)], SCHEMA)
    assert sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=repr) == [(2, 2, 2, True), (None, 2, None, True)]


def test_match_threshold_loses_next_to_nothing():
    rng = np.random.default_rng(0)
    for similarity in (0.8, 0.85, 0.95):
        agreeing = rng.binomial(near_dup.COORDINATES, similarity, 400_000)
        assert np.mean(agreeing < near_dup.match_threshold(similarity)) < 1e-5
    assert near_dup.match_threshold(0.85) == 27


def test_signatures_agree_as_often_as_sets(spark):
    a, b = [f"t{k}" for k in range(600)], [f"t{k}" for k in range(60, 660)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    one, two = (r.signature for r in near_dup.signatures(df).orderBy("doc_id").collect())
    assert 0.6 < np.mean(np.array(one) == np.array(two)) <= 1  # similarity 0.818


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, **{k: 100 for k in range(101, 130)}, 200: 199}
    assert components(df.where("a < 0"), "a", "b").count() == 0


def test_templates_tie_nobody(spark):
    """Texts that share a part are no candidates of each other: too few coordinates agree."""
    shared = " ".join(f"t{k}" for k in range(40))
    rows = [(k, f"{shared} " + " ".join(f"u{k}v{j}" for j in range(60))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dup.signatures(df)
    reps = signed.select(signed.doc_id.alias("node"), "signature")
    assert near_dup.retained_pairs(near_dup.postings(reps, 27), 27).count() == 0
    assert run(spark, rows) == brute(rows, 3, 85)


@pytest.mark.parametrize("seed", range(4))
def test_collisions_in_parts_equal_all_pairs(spark, seed, monkeypatch):
    """Forests of the retained pairs connect what all pairs at the threshold connect."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, (4, near_dup.COORDINATES))
    signatures = np.array([np.where(rng.random(near_dup.COORDINATES) < 0.25, rng.integers(0, 9, near_dup.COORDINATES), base[k % 4]) for k in range(90)])
    monkeypatch.setattr(near_dup, "LIST_PART", 7)
    reps = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signatures)], "node long, signature array<int>")
    forest = near_dup.retained_pairs(near_dup.postings(reps, 24), 24).collect()
    agree = (signatures[:, None, :] == signatures[None, :, :]).sum(axis=2)
    assert all(agree[a, b] >= 24 for a, b in forest)
    def roots(pairs):
        root = list(range(90))
        for a, b in pairs:
            a, b = sorted((root[a], root[b]))
            root = [a if r == b else r for r in root]
        return root
    assert roots(forest) == roots([(a, b) for a in range(90) for b in range(a) if agree[a, b] >= 24])


def test_one_doc_id_on_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a, "x"), (3, b, "x"), (5, a + " more", "y"), (9, c, "z"), (9, c, "z"), (9, c, "y"), (3, a, "x"), (None, c, "n"), (7, None, "o"), (7, "", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string")
    found = sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(df, 5, 80).collect() if r.doc_id)
    assert found == [(3, 3), (3, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 9), (9, 9), (9, 9)]
    kept = sorted(((r.doc_id or 0), r.text or "", r.rest) for r in near_dup.one_of_each(df).collect())
    assert [(i, t) for i, t, _ in kept] == [(0, c), (3, a), (3, b), (7, ""), (7, ""), (9, c)]
