"""Trips in a box and a window: against a plain loop, and over stored tables that are read in part."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseline.operators.spacetime import Box, part_boxes, trips_in_box
from pulseline.operators.trips import trip_headers
from pulseline.sinks.tables import Tables

START = datetime(2026, 1, 1, 22, tzinfo=timezone.utc)
SAMPLES = "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"


def sample_rows():
    """Zigzags over ten days, sampled every few minutes to hours; some of one sample, some that stand still."""
    made, rows = random.Random(5), []
    for k in range(60):
        at, lon, lat = START + timedelta(hours=4 * k), made.uniform(4, 5), made.uniform(50, 51)
        for _ in range(made.choice([1, 2, 9, 30])):
            rows.append((f"t{k}", str(k % 3), k % 2, at, lon, lat))
            at += timedelta(minutes=made.choice([1, 7, 59, 60, 61, 1700]))
            if made.random() < 0.8:
                lon, lat = made.uniform(4, 5), made.choice([lat, made.uniform(50, 51)])
    return rows


def by_loop(rows, box, start, end, steps=2000):
    """Walks each segment in small steps."""
    found, trips = {}, {}
    for row in rows:
        trips.setdefault(row[0], []).append(row[3:])
    for trip, fixes in trips.items():
        fixes.sort()
        for a, b in zip(fixes, fixes[1:] + fixes[-1:]):
            for k in range(steps + 1):
                at, lon, lat = (x + (y - x) * (k / steps) for x, y in zip(a, b))
                if box.west <= lon <= box.east and box.south <= lat <= box.north and start <= at < end:
                    first, last = found.get(trip, (at, at))
                    found[trip] = (min(first, at), max(last, at))
    return found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    found = Tables(spark, str(tmp_path_factory.mktemp("tables")))
    samples = spark.createDataFrame(sample_rows(), SAMPLES)
    none = F.lit(None).cast("string")
    found.replace_trips(trip_headers(samples, 1).withColumns(
        {"vehicle_uuid": none, "line_trip_id": none, "daily_trip_seq": F.lit(None).cast("int")}), samples)
    return found


@pytest.mark.parametrize("box, first, hours", [
    (Box(4.4, 50.4, 4.6, 50.6), 30, 20), (Box(4.0, 50.0, 5.0, 51.0), 0, 300), (Box(4.9, 50.0, 5.0, 50.2), 100, 3), (Box(7, 7, 8, 8), 0, 300)])
def test_against_a_walk_in_steps(spark, tables, box, first, hours):
    start, end = START + timedelta(hours=first), START + timedelta(hours=first + hours)
    samples = spark.createDataFrame(sample_rows(), SAMPLES)
    plain = trips_in_box(part_boxes(samples), samples, box, start, end)
    stored = trips_in_box(tables.read_by_day("trip_boxes"), tables.read_by_day("trip_samples"), box, start, end)
    mine = {r.trip_id: (r.entered, r.left) for r in plain.select("trip_id", F.unix_millis("entered").alias("entered"), F.unix_millis("left").alias("left")).collect()}
    assert mine == {r.trip_id: (r.entered, r.left) for r in stored.select("trip_id", F.unix_millis("entered").alias("entered"), F.unix_millis("left").alias("left")).collect()}
    walked = by_loop(sample_rows(), box, start, end)
    assert set(walked) <= set(mine)
    for trip, (entered, left) in mine.items():
        if trip in walked:  # the walk may step over a corner that is cut for a moment
            near = timedelta(minutes=1700 / 2000 + 0.1).total_seconds() * 1000
            assert abs(walked[trip][0].timestamp() * 1000 - entered) <= near and abs(walked[trip][1].timestamp() * 1000 - left) <= near
        else:
            assert left - entered <= 60_000


def test_borders_points_and_missing_coordinates(spark):
    at = lambda m: START + timedelta(minutes=m)
    samples = spark.createDataFrame([
        ("point", "1", 1, at(0), 4.5, 50.5),                                            # one sample, on the border
        ("pass", "1", 1, at(0), 4.0, 50.55), ("pass", "1", 1, at(10), 5.0, 50.55),       # only between its samples
        ("late", "1", 1, at(5), 4.55, 50.55), ("early", "1", 1, at(-9), 4.55, 50.55),
        ("gap", "1", 1, at(0), 4.0, 50.55), ("gap", "1", 1, at(1), None, None), ("gap", "1", 1, at(200), 5.0, 50.55),
        ("nowhere", "1", 1, at(0), None, None)], SAMPLES)
    found = trips_in_box(part_boxes(samples), samples, Box(4.5, 50.5, 4.6, 50.6), at(0), at(5))
    assert {r.trip_id: (r.entered, r.left) for r in found.select(
        "trip_id", *[((F.unix_millis(c) - int(START.timestamp() * 1000)) / 60_000).alias(c) for c in ("entered", "left")]).collect()} == {"point": (0, 0)}
    found = trips_in_box(part_boxes(samples), samples, Box(4.5, 50.5, 4.6, 50.6), at(0), at(110))
    assert {r.trip_id for r in found.collect()} == {"point", "pass", "late", "gap"}
    assert trips_in_box(part_boxes(samples.limit(0)), samples.limit(0), Box(4, 50, 5, 51), at(0), at(9)).count() == 0


def test_reads_the_days_asked_for(tables):
    found = trips_in_box(tables.read_by_day("trip_boxes"), tables.read_by_day("trip_samples"), Box(4, 50, 5, 51), START + timedelta(days=4), START + timedelta(days=4, hours=1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(day") >= 3
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "west" in line)
    assert "DataFilters: [" in scan and "(west" in scan.split("DataFilters: [")[1].split("Format")[0]
