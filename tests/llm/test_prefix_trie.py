import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from pulseline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, part string"


def brute(rows):
    """A dictionary of prefixes and a plain recursion from the leaves up."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        lender = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums, result = {}, []
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if built[c] == node)
        result.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                       len(below), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df, **more)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(seed, conversations=60, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        start = rng.randrange(3)
        for turn in range(rng.randint(1, longest)):
            text = f"é{start if turn < 2 else rng.randrange(2)}" * (turn + 1)
            rows.append((c * rng.choice([1, 1, 1, -1]), turn * 2 - 3, rng.choice(["user", "user", None]) if turn % 2 else "user", text))
    return rows


@pytest.mark.parametrize("seed,task_nodes", [(1, None), (2, 8), (3, 1)])
def test_equals_brute_force(spark, seed, task_nodes):
    rows = corpus(seed, *((60, 12) if task_nodes != 1 else (12, 6)))
    assert run(spark, rows, task_nodes=task_nodes) == brute(rows)


def test_whole_table_equals_brute_force(spark):
    from pulseline.llm.queries import registered
    folder = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = sorted((tuple(r) for r in registered()["op11_prefix_trie"](spark, folder).collect()), key=repr)
    assert got == brute(rows)


def test_awkward_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, 3, "user", "b"), (7, 3, "user", "a"), (7, 3, "user", "a"),
            (10, 0, "", ""), (11, 0, "", ""), (12, None, "user", "é" * 5000), (-3, 1, "a", "b"), (-5, 1, "a", "b"), (0, 0, "ab", ""), (5, 0, "a", "b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(4, 0, "user", "x")]) == brute([(4, 0, "user", "x")])  # its lender is absent


def test_a_long_conversation_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS_IN_A_RANGE", 7)
    monkeypatch.setattr(prefix_trie, "IDS_IN_A_RANGE", 16)
    rows = [(5, k, "user", f"t{k % 3}") for k in range(300)] + [(c, k, "user", f"t{k % 3}") for c in range(100, 160) for k in range(9)]
    assert run(spark, rows, task_nodes=40) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_split_all_equals_plain_sums(seed):
    """Random forests, paths and stars; weights as members would give them."""
    rng = np.random.default_rng(seed)
    n = [1, 2, 50, 400, 400, 300][seed]
    parent = np.array([-1] + [{0: k - 1, 1: 0}.get(seed % 3, int(rng.integers(-1, k))) for k in range(1, n)])
    depth, top = np.zeros(n, int), np.zeros(n, int)
    for k in range(n):
        depth[k], top[k] = (0, k) if parent[k] < 0 else (depth[parent[k]] + 1, top[parent[k]])
    weight, sums = rng.integers(1, 9, n), rng.integers(0, 99, (n, 2))
    wanted = sums.copy()
    for k in range(n - 1, 0, -1):
        if parent[k] >= 0:
            weight[parent[k]] += weight[k]
            wanted[parent[k]] += wanted[k]
    order = rng.permutation(n)
    place = np.argsort(order)
    got = prefix_trie.split_all(top[order], np.where(parent[order] < 0, -1, place[parent[order]]), depth[order], weight[order], sums[order])
    assert np.array_equal(got, wanted[order])
