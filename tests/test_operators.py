import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseline.operators import catalogue as cat
from pulseline.operators import ordered, positions, shapes, temporal, trips
from pulseline.plans import queries as plans
from pulseline.plans.filters import TimeFilter, parse_instant, parse_lines

START = datetime(2026, 5, 4, 6, tzinfo=timezone.utc)
SAMPLES = "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_ordered_operators_equal_plain_windows(spark):
    from pyspark.sql import Window
    rng = random.Random(3)
    data = [(rng.choice("ab"), i, rng.randrange(50), rng.random()) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "g string, k int, v int, w double").withColumn("b", F.floor(F.col("k") / 17))
    plain = Window.partitionBy("g").orderBy("k")
    got = ordered.running_number(df, ["g"], "b", ["k"], "n")
    got = ordered.running_total(got, ["g"], "b", ["k"], "v", "s")
    got = ordered.next_row(got, ["g"], "b", ["k"], ["k", "w"], "nx")
    both = got.select("n", "s", "nx", F.row_number().over(plain).alias("n2"),
                      F.coalesce(F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s2"),
                      F.lead(F.struct("k", "w")).over(plain).alias("nx2")).collect()
    assert len(both) == 200
    assert [r for r in both if (r["n"], r["s"], r["nx"]) != (r["n2"], r["s2"], r["nx2"])] == []


def test_first_and_last_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 5, "y")], "k string, o int, v string")
    assert rows(ordered.earliest_per_key(df, ["k"], ["o"])) == [("a", 1, None), ("b", 5, "y")]
    assert rows(ordered.earliest_per_key(df, ["k"], ["o"], latest=True)) == [("a", 2, "x"), ("b", 5, "y")]


def zigzag(n, line="1", direction="A"):
    rng = random.Random(n)
    return [(line, direction, i, 4.0 + i * 0.001 + rng.uniform(-4e-4, 4e-4), 50.0 + rng.uniform(-8e-4, 8e-4))
            for i in range(1, n + 1)]


def nearest_fraction(line, place):
    best, before = None, 0.0
    total = sum(((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2) ** 0.5 for a, b in zip(line, line[1:]))
    for a, b in zip(line, line[1:]):
        vx, vy = b[3] - a[3], b[4] - a[4]
        length = (vx * vx + vy * vy) ** 0.5
        if not length:
            continue
        t = max(0.0, min(1.0, ((place[0] - a[3]) * vx + (place[1] - a[4]) * vy) / (vx * vx + vy * vy)))
        d = (place[0] - a[3] - vx * t) ** 2 + (place[1] - a[4] - vy * t) ** 2
        if best is None or d < best[0]:
            best = (d, (before + t * length) / total)
        before += length
    return best[1]


@pytest.mark.parametrize("levels", [1, 2])
def test_locating_by_boxes_finds_the_nearest_segment(spark, levels):
    line = zigzag(700) + [("1", "A", 701, *zigzag(700)[-1][3:])]  # ends with an empty segment
    rng = random.Random(9)
    places = [(f"p{i}", rng.uniform(3.9, 4.8), rng.uniform(49.9, 50.1)) for i in range(60)]
    points = spark.createDataFrame(line, "lineid string, direction string, seq int, lon double, lat double")
    stops = spark.createDataFrame([("1", "A", *p) for p in places],
                                  "lineid string, direction string, pointid string, lon double, lat double")
    got = shapes.locate_on_shapes(stops, shapes.measured_segments(shapes.shape_segments(points)), levels).collect()
    want = {p[0]: nearest_fraction(line, p[1:]) for p in places}
    assert len(got) == 60 and max(abs(r["fraction"] - want[r["pointid"]]) for r in got) < 1e-9


def test_locating_sorts_no_candidates(spark):
    """Boxes and segments are searched inside a row, so that a place sorts a row for each box it keeps, not for each it meets."""
    measured = shapes.measured_segments(shapes.shape_segments(spark.createDataFrame(
        zigzag(3000), "lineid string, direction string, seq int, lon double, lat double"))).localCheckpoint()
    places = spark.createDataFrame([("1", "A", "p", 4.2, 50.0), ("1", "A", "none", None, 50.0)], "lineid string, direction string, pointid string, lon double, lat double")
    found = shapes.locate_on_shapes(places, measured)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["pointid"], round(r["fraction"], 9)) for r in found.collect()] == [("p", round(nearest_fraction(zigzag(3000), (4.2, 50.0)), 9))]


def test_interpolation_where_short_segments_crowd(spark, monkeypatch):
    monkeypatch.setattr(shapes, "CELL_BLOCK", 16)
    # A few long segments, and hundreds within a thousandth of the length.
    xs = [0.0, 1.0, 2.0] + [2.0 + 1e-5 * i for i in range(1, 400)] + [3.0, 10.0]
    line = [("1", "A", i, x, 50.0 + (i % 2) * 1e-6) for i, x in enumerate(xs)]
    points = spark.createDataFrame(line, "lineid string, direction string, seq int, lon double, lat double")
    measured = shapes.measured_segments(shapes.shape_segments(points))
    segments = sorted(tuple(r) for r in measured.select("f0", "f1", "lon1", "lon2", "n_segments").collect())
    assert shapes.fraction_cells(measured)[1].count() >= 1
    rng = random.Random(8)
    asked = [rng.random() for _ in range(200)] + [s[0] + rng.random() * 1e-6 for s in segments] + [0.0, 1.0, None]
    df = spark.createDataFrame([(i, "1", "A", f, segments[0][4]) for i, f in enumerate(asked)],
                               "i int, lineid string, dir_label string, fraction double, n_segments long")
    got = {r["i"]: r["on_lon"] for r in shapes.interpolate_on_shapes(df, measured).collect()}
    assert len(got) == len(asked) and got[len(asked) - 1] is None
    for i, f in enumerate(asked[:-1]):
        f0, f1, a, b, _ = max(s for s in segments if s[0] <= f)
        want = a + (b - a) * min(1.0, (f - f0) / ((1.0 if f1 is None else f1) - f0))
        assert abs(got[i] - want) < 1e-9


def network_tables(spark):
    stops = spark.createDataFrame([("10", 4.300, 50.8), ("12", 4.301, 50.8), ("13", 4.302, 50.8), ("20", 4.5, 50.9)],
                                  "pointid string, lon double, lat double")
    terminus = spark.createDataFrame([("1", "13", "A", "End")], "lineid string, terminus_pointid string, direction string, destination string")
    points = spark.createDataFrame([("1", "A", i, 4.3 + 0.001 * i, 50.8) for i in range(3)],
                                   "lineid string, direction string, seq int, lon double, lat double")
    return stops, terminus, points


def test_positions_walk_the_shape_from_the_stop(spark):
    metres = 70.46  # one thousandth of a degree of longitude at this latitude, about
    pings = [("mid", "1", 13, "10", metres / 2), ("null", "1", 13, "12", None), ("past", "1", 13, "12", 900.0),
             ("neg", "1", 13, "12", -900.0), ("nostop", "1", 13, "99", 5.0), ("noshape", "9", 7, "20", 5.0),
             ("neither", "9", 7, "99", 5.0), ("othersense", "1", 10, "12", 50.0)]
    df = spark.createDataFrame([(*p, START) for p in pings], "position_id string, lineid string, direction int, "
                               "pointid string, distance_from_point double, fetched_at timestamp")
    stops, terminus, points = network_tables(spark)
    resolved = positions.resolve_positions(df, stops, terminus, positions.ShapeIndex.build(points))
    got = {r["position_id"]: (r["lon"], r["lat"]) for r in resolved.collect()}
    assert set(got) == {p[0] for p in pings} - {"neither"}
    assert got["nostop"] == (None, None) and got["noshape"] == (4.5, 50.9) and got["othersense"] == (4.301, 50.8)
    assert got["past"] == (4.302, 50.8) and got["neg"] == (4.3, 50.8)
    assert abs(got["null"][0] - 4.301) < 1e-12 and abs(got["mid"][0] - 4.3005) < 1e-6


def trip(name, *fixes, line="1", direction=13):
    return [(name, line, direction, at(s), lon, 50.0) for s, lon in fixes]


def test_value_at_an_instant(spark, rows):
    samples = spark.createDataFrame(trip("t", (0, 4.0), (100, 4.1), (400, 4.4)), SAMPLES)
    def value(s, **more):
        return [round(r["lon"], 9) for r in temporal.value_at_instant(samples, at(s), **more).collect()]
    assert [value(s) for s in (-1, 0, 50, 100, 250, 400, 401)] == [[], [4.0], [4.05], [4.1], [4.25], [4.4], []]
    assert value(50, trips=trips.trip_headers(samples), max_gap_s=300) == [4.05]
    asks = spark.createDataFrame([(s, "t", at(s)) for s in (-1, 0, 50, 100, 250, 400, 401)], "ask int, trip_id string, at_ts timestamp")
    for more in ({"slice_s": 60}, {"slice_s": 1}, {"slice_s": 60, "max_gap_s": 300}, {"slice_s": 1, "max_gap_s": 300}):
        many = temporal.value_at_many_instants(samples, asks, **more)
        assert rows(many.select("ask", F.round("lon", 9))) == [(0, 4.0), (100, 4.1), (250, 4.25), (400, 4.4), (50, 4.05)]


def test_segments_of_all_lengths_meet_their_instants(spark):
    rng = random.Random(6)
    fixes, t = [], 0
    for i in range(60):
        fixes.append((t, float(i)))
        t += rng.choice([1, 40, 700, 30_000, 2_000_000, 90_000_000])
    samples = spark.createDataFrame(trip("t", *fixes), SAMPLES)
    moments = sorted(rng.sample(range(fixes[-1][0]), 200)) + [f[0] for f in fixes]
    asks = spark.createDataFrame([(s, "t", at(s)) for s in moments], "ask long, trip_id string, at_ts timestamp")
    got = {r["ask"]: r["lon"] for r in temporal.value_at_many_instants(samples, asks, slice_s=20).collect()}
    for s in moments:
        k = max(i for i, f in enumerate(fixes) if f[0] <= s)
        share = 0 if fixes[k][0] == s else (s - fixes[k][0]) / (fixes[k + 1][0] - fixes[k][0])
        assert abs(got[s] - (k + share)) < 1e-9


def test_windows(spark, rows):
    samples = spark.createDataFrame(trip("t", (0, 4.0), (100, 4.1), (200, 4.2)) + trip("u", (0, 4.0), (50, 4.1)), SAMPLES)
    inside = temporal.samples_in_window(samples, at(50), at(200))
    assert rows(inside, "trip_id", "lon") == [("t", 4.1), ("u", 4.1)]
    clipped = temporal.samples_in_window(samples, at(50), at(150), clip_bounds=True)
    assert rows(clipped.select("trip_id", F.round("lon", 6))) == [("t", 4.05), ("t", 4.1), ("t", 4.15), ("u", 4.1)]
    headers = trips.trip_headers(samples)
    assert rows(temporal.active_between(headers, at(50), at(500)), "trip_id") == [("t",)]
    assert rows(temporal.active_around(headers, at(50 + 1800)), "trip_id") == [("t",), ("u",)]
    assert rows(temporal.active_around(headers, at(51 + 1800)), "trip_id") == [("t",)]
    assert rows(temporal.active_around(headers, at(-1800)), "trip_id") == []


def test_the_thousandth_trip_of_a_day_keeps_three_characters(spark):
    headers = spark.range(1001).select(
        F.format_string("t%05d", "id").alias("trip_id"), F.lit("1").alias("lineid"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("start_ts"))
    got = {r["daily_trip_seq"]: r["line_trip_id"] for r in trips.number_by_service_day(headers).collect()}
    assert (got[1], got[999], got[1000], got[1001]) == ("1_001", "1_999", "1_100", "1_100")


def test_numbering_counts_the_request_or_the_day(spark, rows):
    samples = spark.createDataFrame(trip("a", (0, 4.0), (60, 4.1)) + trip("b", (7200, 4.0), (7300, 4.1)), SAMPLES)
    headers = trips.trip_headers(samples)
    meta = spark.createDataFrame([("1", "A", "tram", None, None)], "lineid string, direction string, mode string, route_color string, route_text_color string")
    for numbering, label in (("window", "1_001"), ("service_day", "1_002")):
        got = plans.positions_at(headers, samples, meta, at(7250), numbering=numbering)
        assert rows(got, "trip_id", "line_trip_id", "mode") == [("b", label, "tram")]
    assert plans.positions_at(headers, samples, meta, at(7250), lines=["2"]).count() == 0
    assert plans.positions_at(headers, samples, meta, at(7250), direction=13, limit=5000).count() == 1


def test_trajectories_pack_into_one_row_per_trip(spark):
    samples = spark.createDataFrame(trip("a", (0, 4.0), (60, 4.1)) + trip("b", (30, 4.0), (90, 4.2), line="2"), SAMPLES)
    meta = spark.createDataFrame([("1", "A", "tram", "#1", "#2")], "lineid string, direction string, mode string, route_color string, route_text_color string")
    stops = spark.createDataFrame([("1", "A", 1, "13"), ("1", "B", 9, "13")], "lineid string, direction string, sequence_idx int, pointid string")
    packed = plans.pack_trajectories(plans.trajectories(trips.trip_headers(samples), samples, stops, meta, at(0), at(61)))
    got = {r["trip_id"]: r for r in packed.collect()}
    assert (got["a"]["dir_label"], got["a"]["shape_id"], len(got["a"]["samples"])) == ("B", "local:1:B", 2)
    assert (got["b"]["dir_label"], got["b"]["shape_id"], got["b"]["mode"]) == (None, None, None)
    assert got["a"]["samples"][0]["t_ms"] == int(START.timestamp() * 1000)


def test_catalogue_of_lines(spark):
    meta = spark.createDataFrame([(x, "A", m, None, None) for x, m in (("10", "bus"), ("2", "bus"), ("N4", "bus"), ("5", "metro"), ("7", None))],
                                 "lineid string, direction string, mode string, route_color string, route_text_color string")
    none = spark.createDataFrame([], "lineid string, direction string, sequence_idx int, pointid string, destination string")
    terminus = spark.createDataFrame([("2", str(d), "x", n) for d, n in ((1, "P"), (2, "P"), (3, "Q"), (4, "R"), (5, "S"), (6, "T"))],
                                     "lineid string, terminus_pointid string, direction string, destination string")
    stops = spark.createDataFrame([("9", "Named by stop")], "pointid string, stop_name_fr string")
    counts = {1: 2, 2: 3, 3: 4, 4: 4, 5: 1, 6: 1, 7: 1, 8: 2, 9: 2}
    heads = [(f"first-{d}", "2", d, at(0), at(10)) for d in (1,)]
    heads += [(f"{d}-{i}", "2", d, at(60 + i), at(90 + i)) for d, n in counts.items() for i in range(n)]
    trip_table = spark.createDataFrame(heads, "trip_id string, lineid string, direction int, start_ts timestamp, end_ts timestamp")
    got = cat.line_catalogue(meta, none, terminus, stops, trip_table).collect()
    assert [r["lineid"] for r in got] == ["5", "2", "10", "N4", "7"]
    detail = {r["lineid"]: [tuple(d) for d in r["directions_detail"]] for r in got}
    # The earliest trip is not counted; P adds up to five, its busier direction is 2.
    assert detail["2"] == [(2, "P", 5), (3, "Q", 4), (4, "R", 4), (9, "Named by stop", 2)]
    assert detail["5"] == [] and {r["mode"] for r in got} == {"metro", "bus", "other"}


def test_stop_details(spark):
    stops = spark.createDataFrame([("1", "Gare", None, 4.3, 50.8), ("2", "Parc", None, 4.3, 50.8)],
                                  "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double")
    seq = spark.createDataFrame([("N4", "B", 1, "1", None), ("10", "B", 1, "1", "Y"), ("10", "A", 4, "1", "X"), ("2", "A", 1, "1", "Z")],
                                "lineid string, direction string, sequence_idx int, pointid string, destination string")
    meta = spark.createDataFrame([("10", "A", "bus", "#AA", "#BB")], "lineid string, direction string, mode string, route_color string, route_text_color string")
    got = {r["pointid"]: r["lines"] for r in cat.stop_details(stops, seq, meta).collect()}
    assert [e["lineid"] for e in got["1"]] == ["2", "10", "N4"] and got["2"] == []
    assert tuple(got["1"][1]) == ("10", "bus", "#AA", "#BB", ["X", "Y"], ["A", "B"])
    assert got["1"][2]["destinations"] is None
    assert cat.stop_details(stops, seq, meta, ["nowhere"]).count() == 0
    assert len(cat.stop_details(stops, seq, meta, ["1"]).first()["lines"]) == 3


def test_search(spark):
    stops = spark.createDataFrame([("a%b", "Gare", None, 4.3, 50.8), ("x1", None, "Park", 4.3, 50.8), ("x2", "gare du nord", None, None, None)],
                                  "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double")
    meta = spark.createDataFrame([("N71", "A", None)], "lineid string, direction string, mode string")
    points = spark.createDataFrame([("N71", "A", 1, 4.0, 50.0), ("N71", "A", 2, 4.2, 50.0)], "lineid string, direction string, seq int, lon double, lat double")
    find = lambda q: [(r["type"], r["label"], r["sub"]) for r in plans.search(stops, meta, points, q).collect()]
    assert find("GARE") == [("stop", "Gare", "a%b")] and find("ark") == [("stop", "Park", "x1")]
    assert find("n71") == [("line", "Ligne N71", "")] and find("g") == []
    assert find("x_") == [("stop", "Park", "x1")]
    assert find("%%") == [("stop", "Gare", "a%b"), ("stop", "Park", "x1"), ("line", "Ligne N71", "")]


def test_arrivals_put_unknown_times_last(spark):
    df = spark.createDataFrame([(at(0), "1", "71", None, None, None), (at(0), "1", "72", at(60), None, None),
                                (at(60), "1", "73", None, None, None), (at(60), "2", "74", None, None, None)],
                               "poll_ts timestamp, pointid string, lineid string, expected timestamp, destination string, message string")
    assert [r["lineid"] for r in plans.waiting_times_for_stop(df, "1").collect()] == ["73", "72", "71"]
    assert [r["lineid"] for r in plans.waiting_times_for_stop(df, "1", 1).collect()] == ["73"]
    assert plans.waiting_times_per_stop(df, 2).where("pointid = '1'").count() == 2


def test_time_filters(spark):
    assert parse_instant("2026-05-04T12:00:00+02:00") == parse_instant("2026-05-04T10:00:00") == parse_instant(" 2026-05-04T10:00:00Z ")
    assert parse_instant("soon") is None and parse_instant("") is None and parse_instant(None) is None
    assert parse_lines("71, 92,,") == ["71", "92"] and parse_lines(" ,") is None and parse_lines(None) is None
    assert [TimeFilter.parse(hours=h).hours for h in ("0", "99", "x", None, "2")] == [0.05, 24.0, 1.0, 1.0, 2.0]
    back = TimeFilter.parse(start="2026-05-04T10:00:00Z", end="2026-05-04T09:00:00Z")
    assert back.start is None and back.end is None
    heads = spark.createDataFrame([("t", at(0), at(7200))], "trip_id string, start_ts timestamp, end_ts timestamp")
    row = TimeFilter.parse(hours="1").window(heads).select(F.unix_seconds("w_start"), F.unix_seconds("w_end")).first()
    assert tuple(row) == (int(at(3600).timestamp()), int(at(7200).timestamp()))
    assert heads.where(F.col("end_ts") == TimeFilter().instant(heads)).count() == 1
    start, end = TimeFilter.parse(hours="2").bounds(heads)
    assert temporal.active_between(heads, start, end).count() == 1
    fixed = TimeFilter.parse(start="2026-05-04T10:00:00Z", end="2026-05-04T11:00:00Z").window(heads)
    assert fixed.select(F.unix_seconds("w_end") - F.unix_seconds("w_start")).first()[0] == 3600


def test_geojson_comes_in_parts_that_join_up(spark):
    points = spark.createDataFrame([("1", "A", i, 4.0 + i, 50.0) for i in range(1, 12)], "lineid string, direction string, seq int, lon double, lat double")
    whole = shapes.shape_geojson(points).collect()
    assert len(whole) == 1 and whole[0]["geometry"].startswith('{"type":"LineString","coordinates":[[5.0,50.0],[6.0,50.0]')
    parts = [r["geometry"] for r in shapes.shape_geojson(points, part_points=5).orderBy("part").collect()]
    assert len(parts) == 3 and parts[0].endswith("[9.0,50.0]]}") is True and parts[1].split("[[")[1].startswith("9.0")
