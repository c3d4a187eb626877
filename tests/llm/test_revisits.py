import random

import pytest
from pyspark.sql import functions as F

from pulseline.llm import revisits

SCHEMA = "record_id long, url string, captured_at long, kind string, headers map<string,string>, digest string, payload string, found string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute(rows, keys):
    result = []
    for i, url, at, kind, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        low = {}
        for k, v in sorted((k.lower(), v) for k, v in (headers or {}).items()):
            low[k] = v
        earlier = [(r[2], r[0], r) for r in rows if r[3] == "response" and r[0] is not None and None not in (r[1], r[2], url, at)
                   and keys[r[1]] == keys[url] and r[2] < at]
        if not earlier:
            result.append((i, None, "no earlier response", None, None))
            continue
        target = max(earlier, key=lambda e: e[:2])[2]
        stored = {}
        for k, v in sorted((k.lower(), v) for k, v in (target[4] or {}).items()):
            stored[k] = v
        name = next((n for n in ("etag", "last-modified") if low.get(n) is not None), "digest" if digest is not None else None)
        strip = lambda v: v[2:] if v and v.startswith("W/") else v
        mine, theirs = (digest, target[5]) if name == "digest" else (low.get(name), stored.get(name)) if name else (None, None)
        if name == "etag":
            mine, theirs = strip(mine), strip(theirs)
        outcome = "unverified" if name is None else name if mine == theirs else "changed"
        if outcome in ("unverified", "changed"):
            result.append((i, None, outcome, None, None))
        else:
            merged = stored | {k: v for k, v in low.items() if k not in revisits.NOT_PERMITTED}
            result.append((i, target[0], outcome, tuple(sorted(merged.items())), target[6]))
    return sorted(result, key=repr)


def run(spark, rows):
    got = revisits.resolve(frame(spark, rows)).collect()
    return sorted(((r.record_id, r.refers_to, r.outcome, None if r.headers is None else tuple(sorted(r.headers.items())), r.payload) for r in got), key=repr)


def keys_of(spark, rows):
    urls = [(r[1],) for r in rows if r[1] is not None]
    df = spark.createDataFrame(urls or [("",)], "url string")
    return {r.url: r.k for r in df.select("url", revisits.canonical_url(F.col("url")).alias("k")).collect()} | {None: None}


@pytest.mark.parametrize("slice_rows", [7, 1 << 13])
def test_equals_brute_force(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(revisits, "SLICE_ROWS", slice_rows)
    rng = random.Random(8)
    spellings = ["http://a.org/p", "https://www.a.org/p/", "HTTP://A.org:80/p#x", "http://a.org/p?utm_source=y", "http://b.org/?b=2&a=1", "b.org?a=1&b=2"]
    rows = []
    for k in range(160):
        full = rng.random() < 0.4
        headers = {n: rng.choice(["1", "2", 'W/"e"', '"e"']) for n in rng.sample(["ETag", "Last-Modified", "Server", "content-type", "Age", "etag"], rng.randint(0, 4))}
        rows.append((k, "http://a.org/p" if rng.random() < 0.5 else rng.choice(spellings), rng.randrange(90), "response" if full else "revisit",
                     headers if rng.random() < 0.9 else None, rng.choice([None, "d1", "d2"]), f"body {k}" if full else None))
    assert run(spark, rows) == brute(rows, keys_of(spark, rows))


def test_awkward_rows(spark):
    ok = {"ETag": "1"}
    rows = [(1, "http://a/", 10, "response", ok, None, ""), (2, "http://a/", 10, "revisit", ok, None, None), (3, "http://a", 11, "revisit", ok, None, None),
            (3, "http://a", 11, "revisit", ok, None, None), (4, None, 12, "revisit", ok, None, None), (5, "http://a/", None, "revisit", ok, None, None),
            (None, "http://a/", 11, "response", ok, None, "x"), (6, "http://a/", 13, "revisit", None, None, None), (None, "http://a/", 14, "revisit", ok, None, None),
            (7, "http://a/", 9, "metadata", ok, None, None), (8, "", 20, "revisit", {}, "d", None)]
    assert run(spark, rows) == brute(rows, keys_of(spark, rows))
    assert run(spark, []) == []


@pytest.mark.parametrize("left,right", [
    ("http://WWW.A.org:80/x/?b=1&a=2#f", "https://a.org/x?a=2&b=1"), ("http://u:p@a.org", "a.org/"), ("https://a.org:443/x", "http://www2.a.org/x"),
    ("http://a.org/?PHPSESSID=9", "http://a.org"), ("http://a.org/x?utm_campaign=1&c", "http://a.org/x?c")])
def test_spellings_of_one_url(spark, left, right):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    row = df.select(revisits.canonical_url(F.col("l")).alias("l"), revisits.canonical_url(F.col("r")).alias("r")).first()
    assert row.l == row.r


def test_different_urls_stay_apart(spark):
    urls = ["http://a.org/X", "http://a.org/x", "http://a.org/x?p=1", "http://a.org/x?p=2", "http://b.a.org/x", "http://a.org:81/x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert df.select(revisits.canonical_url(F.col("u")).alias("k")).distinct().count() == len(urls)
