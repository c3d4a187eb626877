import math
import random

import pytest

from pulseline.operators import simplify, tiles


def area(a, b, c):
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def by_hand(points, min_area):
    """One vertex at a time, searching all of them for the smallest."""
    alive = list(range(len(points)))
    rank = {i: (area(points[i - 1], points[i], points[i + 1]), 0, i) for i in alive[1:-1]}
    while rank:
        now = min(rank.values())
        if now[0] >= min_area:
            break
        at = alive.index(now[2])
        del rank[now[2]], alive[at]
        for j in (at - 1, at):
            if 0 < j < len(alive) - 1:
                size = area(*[points[alive[k]] for k in (j - 1, j, j + 1)])
                i = alive[j]
                rank[i] = (size, 0, i) if size > now[0] else (now[0], now[1] + 1, i)
    return alive


def wiggle(seed, n, step=1.0):
    rng = random.Random(seed)
    return [(i * step, rng.choice([0, 0.5, 1, 3]) * rng.random() if seed % 2 else float(rng.choice([0, 1, 2]))) for i in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_thinning_equals_the_search_by_hand(seed):
    points = wiggle(seed, 120)
    kept, _, _ = simplify.thin_out([p[0] for p in points], [p[1] for p in points], 0.9)
    assert kept == by_hand(points, 0.9) and kept[0] == 0 and kept[-1] == 119


@pytest.mark.parametrize("chunk_points", [1000, 40, 7])
def test_chunks_give_the_whole_polyline_result(spark, chunk_points):
    lines = {(f"{s}", "A"): wiggle(s, 60 + 25 * s) for s in range(3)}
    rows = [(*k, i * 3 + 1, float(x), float(y)) for k, pts in lines.items() for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "lineid string, direction string, seq int, x double, y double")
    got = {}
    for r in simplify.simplify(df, 1.1, chunk_points).collect():
        got.setdefault((r["lineid"], r["direction"]), []).append(r["idx"])
    assert {k: sorted(v) for k, v in got.items()} == {k: by_hand(pts, 1.1) for k, pts in lines.items()}


def test_clipping_keeps_what_lies_inside(spark):
    rng = random.Random(4)
    raw = [(i, *[float(rng.randrange(-300, 400)) for _ in range(4)]) for i in range(400)]
    raw += [(900, 0.0, 0.0, 100.0, 100.0), (901, -50.0, 50.0, -50.0, 80.0), (902, 50.0, -300.0, 50.0, 400.0)]
    df = spark.createDataFrame(raw, "i int, ax double, ay double, bx double, by double")
    got = {r["i"]: (r["ax"], r["ay"], r["bx"], r["by"]) for r in tiles.clip_segments(df, -10, 110).collect()}
    for i, ax, ay, bx, by in raw:
        steps = [(ax + (bx - ax) * k / 2000, ay + (by - ay) * k / 2000) for k in range(2001)]
        inside = [p for p in steps if -10 <= p[0] <= 110 and -10 <= p[1] <= 110]
        if i in got:
            assert all(-10 <= v <= 110 for v in got[i])
            if inside:
                assert math.dist(inside[0], got[i][:2]) < 1.5 and math.dist(inside[-1], got[i][2:]) < 1.5
        else:
            assert not inside or math.dist(inside[0], inside[-1]) < 1.5
    assert got[902] == (50.0, -10.0, 50.0, 110.0) and 901 not in got


def test_tiles_of_stops(spark):
    stops = spark.createDataFrame([("1", "Centre", None, 0.0, 0.0), ("2", "Brussels", None, 4.3517, 50.8466), ("3", "x", None, None, 1.0)],
                                  "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double")
    got = {}
    for r in tiles.tile_stops(stops, [0, 1, 12]).collect():
        got.setdefault((r["pointid"], r["z"]), []).append((r["x"], r["y"], r["px"], r["py"]))
    # On the border of four tiles, a stop is in all of them.
    assert got[("1", 0)] == [(0, 0, 2048, 2048)]
    assert sorted(got[("1", 1)]) == [(0, 0, 4096, 4096), (0, 1, 4096, 0), (1, 0, 0, 4096), (1, 1, 0, 0)]
    y = (1 - math.asinh(math.tan(math.radians(50.8466))) / math.pi) / 2 * 4096
    x = (4.3517 + 180) / 360 * 4096
    assert got[("2", 12)] == [(int(x), int(y), round(x % 1 * 4096), round(y % 1 * 4096))] and len(got) == 6
    line_stops = spark.createDataFrame([("1", "71")], "pointid string, lineid string")
    assert {r["pointid"] for r in tiles.tile_stops(stops, [5], line_stops, ["71"]).collect()} == {"1"}


def test_tiles_of_lines(spark):
    points = spark.createDataFrame([("1", "A", i, 4.30 + i * 0.004, 50.80 + (i % 2) * 0.002) for i in range(30)],
                                   "lineid string, direction string, seq int, lon double, lat double")
    shapes = spark.createDataFrame([("1", "A", 0, None, "#1", "#2")], tiles_shape())
    rows = tiles.tile_lines(points, shapes, [10, 13]).collect()
    assert {r["mode"] for r in rows} == {"other"}
    assert all(-64 <= r[c] <= 4160 for r in rows for c in ("x0", "y0", "x1", "y1"))
    assert len({(r["x"], r["y"]) for r in rows if r["z"] == 13}) > len({(r["x"], r["y"]) for r in rows if r["z"] == 10})
    # Inside a tile consecutive segments meet.
    whole = sorted((r for r in rows if r["z"] == 10), key=lambda r: (r["x"], r["y"], r["seq"]))
    assert all((a["x1"], a["y1"]) == (b["x0"], b["y0"]) for a, b in zip(whole, whole[1:]) if (a["x"], a["y"]) == (b["x"], b["y"]))
    assert tiles.tile_lines(points, shapes, [10], lines=["2"]).count() == 0


def test_a_long_segment_reaches_every_tile_it_crosses(spark):
    points = spark.createDataFrame([("1", "A", 1, 4.0, 50.0), ("1", "A", 2, 4.9, 51.1), ("2", "A", 1, 4.0, 50.0), ("2", "A", 2, 4.0, 50.4)],
                                   "lineid string, direction string, seq int, lon double, lat double")
    shapes = spark.createDataFrame([("1", "A", 0, "bus", None, None)], tiles_shape())
    side = 2 ** 12
    want = set()
    for line, (lon2, lat2) in (("1", (4.9, 51.1)), ("2", (4.0, 50.4))):
        def unit(lon, lat):
            return (lon / 360 + 0.5) * side, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * side
        (ax, ay), (bx, by) = unit(4.0, 50.0), unit(lon2, lat2)
        for k in range(20001):
            want.add((line, int(ax + (bx - ax) * k / 20000), int(ay + (by - ay) * k / 20000)))
    got = {(r["lineid"], r["x"], r["y"]) for r in tiles.tile_lines(points, shapes, [12]).collect()}
    # Everything crossed, and beyond that only tiles met within the clip margin.
    assert want <= got and len(got) < 2 * len(want)


def tiles_shape():
    return "lineid string, direction string, variant int, mode string, route_color string, route_text_color string"
