"""Work that has to stay in proportion to its input: what a plan holds and who runs it."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from checks import queries
from pulseline.operators.spacetime import PLACE_DIGITS, part_boxes
from pulseline.operators.tiles import quadkey_of
from pulseline.sinks.tables import Tables
from pulseline.streaming import polls

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_boxes_sort_parts_not_samples(spark):
    """One aggregate and one window over its rows; against a loop, with places by the plain quadkey."""
    made = random.Random(3)
    rows = [(f"t{k % 7}", "1", 1, START + timedelta(minutes=17 * k), made.uniform(-179, 179), made.uniform(-80, 80)) for k in range(300)]
    rows += [("t0", "1", 1, START, None, 50.0), (None, "1", 1, START, 4.0, 50.0), ("t0", None, 1, START, 4.0, 50.0)]
    found = part_boxes(spark.createDataFrame(rows, "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Window [") == 1 and "Join" not in plan
    want = {}
    for trip in {r[0] for r in rows[:300]}:
        fixes = sorted(r[3:] for r in rows[:300] if r[0] == trip)
        for part in {(f[0] - START) // timedelta(hours=1) for f in fixes}:
            own = [f for f in fixes if (f[0] - START) // timedelta(hours=1) == part]
            met = own + fixes[fixes.index(own[-1]) + 1:][:1]
            want[trip, own[0][0].timestamp()] = (met[-1][0].timestamp(), min(f[1] for f in met), min(f[2] for f in met), max(f[1] for f in met),
                                                 max(f[2] for f in met), met[-1][1:] if len(met) > len(own) else None)
    got = found.withColumns({c: F.unix_seconds(c).cast("double") for c in ("start_ts", "end_ts")}).collect()
    assert {(r.trip_id, r.start_ts): (r.end_ts, r.west, r.south, r.east, r.north, r.tail and (r.tail.lon, r.tail.lat)) for r in got} == want
    from pulseline.functions import geo
    unit = spark.createDataFrame([((r.west + r.east) / 2, (r.south + r.north) / 2) for r in got], "lon double, lat double").select(
        geo.mercator_unit_x(F.col("lon")), geo.mercator_unit_y(F.col("lat"))).collect()
    assert [r.place for r in got] == [quadkey_of(PLACE_DIGITS, *[int(u * 2 ** PLACE_DIGITS) for u in us]) for us in unit]


def test_the_newest_end_lists_one_day(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path))
    ends = [START + timedelta(days=2 * k, hours=1) for k in range(4)]
    tables.replace_trips(spark.createDataFrame([(f"t{k}", None, "1", 1, end - timedelta(minutes=9), end, 2, None, None) for k, end in enumerate(ends)], (
        "trip_id string, vehicle_uuid string, lineid string, direction int, start_ts timestamp, end_ts timestamp, point_count int, line_trip_id string, daily_trip_seq int")),
        spark.createDataFrame([], "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"))
    monkeypatch.setattr(Tables, "read_by_day", lambda *_: pytest.fail("lists all days"))
    assert tables.latest_end() == ends[-1]


def test_batches_of_the_stream_adapt_their_plans(spark, tmp_path, monkeypatch):
    """Pings of a micro-batch are located in the tables' session; a batch without pings locates none."""
    seen = []
    monkeypatch.setattr(polls, "resolve_against", lambda tables, typed, index: seen.append(
        (typed.sparkSession.conf.get("spark.sql.adaptive.enabled"), typed.count())) or typed.withColumns(
            {"vehicle_uuid": F.lit(None).cast("string"), "lon": F.lit(4.0), "lat": F.lit(50.0)}))
    landed = str(tmp_path / "landed")
    spark.createDataFrame([({"lineid": "71", "direction": "14", "pointid": str(k), "poll_ts": f"2026-01-01T0{k}:00:00+00:00"},) for k in range(3)],
                          "record map<string,string>").coalesce(1).write.parquet(landed)
    tables = Tables(spark, str(tmp_path / "tables"))
    stream = polls.coerce_pings(spark.readStream.schema("record map<string,string>").parquet(landed))
    polls.start_position_stream(stream, tables, str(tmp_path / "checkpoint")).awaitTermination(240)
    assert seen == [("true", 3)] and tables.read("positions").count() == 3


def test_a_replayed_feed_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    class Read(Exception):
        pass

    def load(tables, records):
        raise Read(records.select("file").distinct().count(), records.count())

    monkeypatch.setattr(queries.pipelines, "load_pings", load)
    monkeypatch.setattr(queries, "DUMP_ROWS", 50)
    folder = tmp_path / "in"
    spark.createDataFrame([(k, f"c{k}", k % 5) for k in range(60)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, f"n{k}") for k in range(5)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(k, START, k, "view", 1.0, "{}") for k in range(900)],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    with pytest.raises(Read) as told:
        queries.registered()["replay_counts"](spark, str(folder))
    files, rows = told.value.args
    assert rows == 900 and files >= 18
