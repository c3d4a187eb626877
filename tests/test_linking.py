import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseline.operators import linking
from pulseline.streaming.linker import TripLinker, late_rows

START = datetime(2026, 5, 4, 6, tzinfo=timezone.utc)
SCHEMA = "position_id string, lineid string, direction int, fetched_at timestamp, lon double, lat double"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def by_hand(pings):
    """Trips per line-direction, straight from the rule; as sets of ping ids."""
    trips = []
    for key in {(p[1], p[2]) for p in pings}:
        here = []
        for p in sorted((p for p in pings if (p[1], p[2]) == key), key=lambda p: (p[3], p[4], p[5], p[0])):
            fits = [(metres(t[-1][4:6], p[4:6]), i) for i, t in enumerate(here)
                    if 0 < (p[3] - t[-1][3]).total_seconds() <= 300 and metres(t[-1][4:6], p[4:6]) <= 500]
            if fits:
                here[min(fits)[1]].append(p)
            else:
                here.append([p])
        trips += here
    return sorted(tuple(sorted(p[0] for p in t)) for t in trips)


def linked(spark, pings, chunk_rows=linking.CHUNK_ROWS):
    df = spark.createDataFrame(pings, SCHEMA)
    return grouped(linking.link_pings(df, chunk_rows))


def grouped(df):
    trips = df.groupBy("lineid", "direction", "head").agg(F.sort_array(F.collect_list("position_id")).alias("ids"))
    return sorted(tuple(r["ids"]) for r in trips.collect())


def some_pings(seed, n=160, spread=0.02, pauses=True, lines=(("71", 1), ("71", 2), ("N4", 9))):
    rng, pings = random.Random(seed), []
    for line, direction in lines:
        t = START
        for i in range(n):
            t += timedelta(seconds=rng.choice([0, 5, 20, 20, 60, 120]))
            if pauses and rng.random() < 0.04:
                t += timedelta(seconds=rng.choice([299, 301, 900]))
            pings.append((f"{line}-{direction}-{i:04}", line, direction, t,
                          4.3 + rng.randrange(12) * spread / 12, 50.8 + rng.randrange(3) * 0.001))
    rng.shuffle(pings)
    return pings


@pytest.mark.parametrize("seed", range(3))
def test_links_as_by_hand(spark, seed):
    pings = some_pings(seed)
    assert linked(spark, pings) == by_hand(pings)


@pytest.mark.parametrize("seed,chunk_rows", [(11, 7), (12, 25), (13, 60)])
def test_one_line_without_pause_cut_into_chunks(spark, seed, chunk_rows):
    pings = some_pings(seed, n=400, pauses=False, lines=(("1", 5),)) + some_pings(seed + 1, n=20)
    assert linked(spark, pings, chunk_rows) == by_hand(pings)


def ping(name, seconds, lon=4.3, lat=50.8):
    return (name, "71", 1, START + timedelta(seconds=seconds), lon, lat)


def test_limits_in_time(spark):
    assert linked(spark, [ping("a", 0), ping("b", 300)]) == [("a", "b")]
    assert linked(spark, [ping("a", 0), ping("b", 301)]) == [("a",), ("b",)]
    assert linked(spark, [ping("a", 0), ping("b", 0)]) == [("a",), ("b",)]


def test_limits_in_space(spark):
    step = math.degrees(500 / 6371000.0)
    assert linked(spark, [ping("a", 0), ping("b", 20, lat=50.8 + step * 0.9999)]) == [("a", "b")]
    assert linked(spark, [ping("a", 0), ping("b", 20, lat=50.8 + step * 1.0001)]) == [("a",), ("b",)]


def test_nearest_open_trip_wins_and_the_oldest_on_a_tie(spark):
    near = [ping("a", 0, lon=4.300), ping("b", 0, lon=4.303), ping("c", 20, lon=4.302)]
    assert linked(spark, near) == [("a",), ("b", "c")]
    tie = [ping("b", 0), ping("a", 10, lon=4.32), ping("c", 10, lon=4.3), ping("d", 20)]
    assert linked(spark, tie) == by_hand(tie)
    same = [ping("a", 0), ping("b", 0), ping("c", 20)]
    assert linked(spark, same) == [("a", "c"), ("b",)]


def test_single_pings_are_no_trips_and_null_places_are_ignored(spark):
    df = spark.createDataFrame([ping("a", 0), ping("b", 60), ping("z", 9000), ("n", "71", 1, START, None, None)], SCHEMA)
    headers, samples = linking.build_trips(linking.trip_samples(linking.link_pings(df)))
    row = headers.collect()
    assert [(r["point_count"], r["start_ts"] < r["end_ts"]) for r in row] == [(2, True)]
    assert {r["trip_id"] for r in samples.collect()} == {row[0]["trip_id"]}


def test_a_rebuild_keeps_trip_ids(spark):
    df = spark.createDataFrame(some_pings(4), SCHEMA)
    ids = [sorted(r["trip_id"] for r in linking.build_trips(linking.trip_samples(linking.link_pings(d, c)))[0].collect())
           for d, c in ((df, 10 ** 6), (df.repartition(7), 30))]
    assert ids[0] == ids[1] and len(ids[0]) > 3


def online(spark, tmp_path, lateness_s):
    """A linker, its feed's folder, and a function that lands some pings as one file and runs the stream on."""
    linker, landed = TripLinker(spark, str(tmp_path / "linker"), lateness_s=lateness_s), str(tmp_path / "landed")

    def land(rows):
        df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(landed)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)
        query = linker.start(stream)
        assert query.awaitTermination(240) and query.exception() is None
        return query

    return linker, land, run


def heads_of(samples):
    return grouped(samples.select("lineid", "direction", F.col("first_position_id").alias("head"), "position_id"))


def test_online_linking_gives_the_batch_trips(spark, tmp_path):
    """Pings out of order within the lateness bound, a row twice, and a stop and a restart between batches."""
    pings = sorted(some_pings(21, n=90), key=lambda p: p[3])
    rng = random.Random(2)
    shuffled = sorted(pings, key=lambda p: p[3] + timedelta(seconds=rng.uniform(0, 60)))
    linker, land, run = online(spark, tmp_path, lateness_s=120)
    size = len(shuffled) // 4 + 1
    for number in range(4):
        land(shuffled[number * size:(number + 1) * size] + shuffled[number * size:][:1])
        if number in (1, 3):
            assert late_rows(run()) == 0
    newest = max(p[3] for p in pings)
    watermark = newest - timedelta(seconds=120)
    open_trips, closed = linker.trips(watermark)
    assert open_trips.count() > 0 and "last_point" in open_trips.columns
    ends = {r.trip_id: r.end_ts.replace(tzinfo=START.tzinfo) for r in open_trips.unionByName(closed, allowMissingColumns=True).collect()}
    running = {r.trip_id for r in open_trips.collect()}
    limit = (watermark - timedelta(seconds=300)).replace(tzinfo=START.tzinfo)
    assert running == {t for t, end in ends.items() if end >= limit} and len(running) < len(ends)
    for r in open_trips.collect():
        last = linker.samples().where(F.col("trip_id") == r.trip_id).orderBy(F.desc("ts")).first()
        assert (r.last_point.lon, r.last_point.lat) == (last.lon, last.lat)

    land(linker.heartbeat(newest + timedelta(hours=1)))
    run()
    assert heads_of(linker.samples()) == by_hand(pings)
    land([ping("late", -9000)])
    assert late_rows(run()) == 1  # the engine drops and counts it
    opened, finished = linker.trips(newest + timedelta(hours=1))
    assert opened.count() == 0 and finished.count() == len([t for t in by_hand(pings) if len(t) > 1])


def test_state_goes_when_nothing_can_extend_a_trip(spark, tmp_path):
    """Timers clear what is over: an idle key has no open trip left in the store."""
    linker, land, run = online(spark, tmp_path, lateness_s=10)
    land([ping("a", 0), ping("b", 60), ("z", "9", 2, START, 4.0, 50.0), ("n", "71", 1, START, None, None)])
    land(linker.heartbeat(START + timedelta(seconds=200)))
    run()
    held = spark.read.format("statestore").option("stateVarName", "open").load(linker.checkpoint)
    assert sorted(r.list_element.head for r in held.collect()) == ["a", "z"]
    land(linker.heartbeat(START + timedelta(seconds=2000)))
    run()
    assert spark.read.format("statestore").option("stateVarName", "open").load(linker.checkpoint).count() == 0
    assert linker.open_trips(START + timedelta(seconds=200), batch=2).count() == 2  # an earlier version can be asked for
    assert heads_of(linker.samples()) == [("a", "b"), ("z",)]


def test_linker_keeps_the_session_as_it_was(spark, tmp_path):
    from pulseline.streaming.linker import PROVIDER
    before = spark.conf.get(PROVIDER, None)
    linker, land, run = online(spark, tmp_path, lateness_s=10)
    land([ping("a", 0)])
    run()
    assert spark.conf.get(PROVIDER, None) == before


def test_waiting_pings_are_kept_in_blocks(spark, tmp_path, monkeypatch):
    """A micro-batch's pings wait in few state rows, not in one each; the trips stay those of the batch job."""
    pings = sorted(some_pings(8, n=400), key=lambda p: p[3])
    linker, land, run = online(spark, tmp_path, lateness_s=120)
    land(pings)
    run()
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(linker.checkpoint, batchId=0)
    assert 0 < held.count() <= len({p[1:3] for p in pings})
    land(linker.heartbeat(max(p[3] for p in pings) + timedelta(hours=1)))
    run()
    assert heads_of(linker.samples()) == by_hand(pings)


def test_blocks_hold_pings_as_they_were():
    from pulseline.streaming.linker import _packed, _unpacked
    pings = [(1_704_067_200_000_001, 4.3, -50.8, "a"), (-5, 0.1 + 0.2, 1e-300, "é"), (7, 1.0, 2.0, None)]
    assert list(_unpacked(_packed(pings))) == pings
