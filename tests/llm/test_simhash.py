import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pulseline.llm import simhash

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, bits string, rep int, component string"


def brute_fingerprint(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [words] if 0 < len(words) < size else [words[k:k + size] for k in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, size=3, distance=3):
    """Breadth first over all pairs of texts; a node is a text."""
    marks = [(i, brute_fingerprint(t, size)) for i, t in rows]
    distinct = sorted({m for i, m in marks if i is not None})
    near = {m: [o for o in distinct if (m ^ o).bit_count() <= distance] for m in distinct}
    least, done = {}, set()
    for m in distinct:
        if m not in done:
            group, edge = {m}, [m]
            while edge:
                edge = [o for e in edge for o in near[e] if o not in group]
                group |= set(edge)
            done |= group
            smallest = min(i for i, o in marks if i is not None and o in group)
            least.update(dict.fromkeys(group, smallest))
    return sorted(((i, f"{m:016x}", None if i is None else least[m]) for i, m in marks), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df, **more)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(300)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300, 600]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\t", " \n\x0b"]).join(copy))
    return [(k * 3 - 5, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,size,distance", [(1, 3, 3), (2, 3, 3), (3, 1, 2), (4, 5, 1)])
def test_equals_brute_force(spark, seed, size, distance):
    rows = corpus(seed)
    assert run(spark, rows, size=size, distance=distance) == brute(rows, size, distance)


def test_whole_table_equals_brute_force(spark):
    from pulseline.llm.queries import registered
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in registered()["op12_simhash"](spark, folder).collect()), key=repr)
    assert got == brute(rows)


def test_awkward_rows(spark):
    same = "one two three four five"
    rows = [(5, None), (3, ""), (None, "  "), (9, " \t\n"), (7, "One"), (8, "oNE"), (None, same), (4, same), (4, same),
            (6, same), (6, "quite another text it is"), (1, "a b"), (2, "é è")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (3, "0" * 16, 3) in got and (5, "0" * 16, 3) in got and (None, "0" * 16, None) in got
    assert run(spark, [(None, None)]) == [(None, "0" * 16, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_go_in_pieces(monkeypatch):
    rng = random.Random(7)
    text = " ".join(rng.choice(["A", "bc", "dé", "f\n\n"]) for _ in range(5000))
    for size in (1, 3, 7):
        whole = np.concatenate(list(simhash.shingle_hashes(text.encode(), size)))
        monkeypatch.setattr(simhash, "pieces", lambda d, cut=simhash.pieces: cut(d, 11))
        assert np.array_equal(np.concatenate(list(simhash.shingle_hashes(text.encode(), size))), whole)
        monkeypatch.undo()
    votes = simhash.Votes(2)
    votes.add(1, np.arange(1, 100_000, dtype=np.uint64))
    assert votes.fingerprints().tolist() == [0, sum(1 << b for b in range(17) if 2 * sum(k >> b & 1 for k in range(1, 100_000)) > 99_999)]
    assert list(simhash.pieces(b"x" * 50, 7)) == [b"x" * 50, b""] and b"".join(simhash.pieces(text.encode(), 9)) == text.encode()


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_close_pairs_share_a_key(distance):
    rng = random.Random(distance)
    masks = [m % (1 << 64) for m in simhash.block_masks(distance)]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), distance))
        assert any(a & m == b & m for m in masks)


def test_a_bucket_in_parts(spark, monkeypatch):
    """One bucket holds all fingerprints; parts give the same components as one piece."""
    rng = random.Random(3)
    low = sorted({rng.getrandbits(14) for _ in range(500)})
    monkeypatch.setattr(simhash, "PART", 60)
    edges = simhash.links(spark.createDataFrame([(x,) for x in low], "bits long"), 2).collect()
    near, reach = defaultdict(set), {}
    for a, b in edges:
        assert (a ^ b).bit_count() > 0
        near[a].add(b), near[b].add(a)
    wanted = {x: {y for y in low if (x ^ y).bit_count() <= 2} for x in low}
    def component(of, x):
        group, edge = {x}, {x}
        while edge:
            edge = {y for e in edge for y in of[e]} - group
            group |= edge
        return min(group)
    assert {x: component(near, x) for x in low} == {x: component(wanted, x) for x in low}


def test_forest():
    rows, root = simhash.forest(np.array([5, 3, 1]), np.array([3, 1, 0]), 7)
    assert dict(zip(rows.tolist(), root.tolist())) == {1: 0, 3: 0, 5: 0}
