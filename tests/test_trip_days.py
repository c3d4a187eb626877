"""Stored trips by day: each day a trip touches has a header row, and questions read few days."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseline.operators import temporal
from pulseline.operators.trips import trip_headers
from pulseline.plans import queries as plans
from pulseline.sinks.tables import Tables

UTC = timezone.utc
START = datetime(2026, 1, 1, 22, tzinfo=UTC)
SAMPLES = "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"
LINE_STOPS = "lineid string, direction string, sequence_idx int, pointid string, destination string"
LINE_SHAPES = "lineid string, direction string, variant int, mode string, route_color string, route_text_color string"


def sample_rows():
    """A trip every 5 hours for 12 days, on three lines; some cross midnight, one lasts four days."""
    rows = []
    for k in range(58):
        start, steps, step = START + timedelta(hours=5 * k), (12, 3 + k % 4)[k != 7], timedelta(minutes=(480, 40)[k != 7])
        rows += [(f"t{k}", ("1", "2", "N3")[k % 3], 10 + k % 2, start + step * n, 4.0 + n, 50.0 + k) for n in range(steps)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    found = Tables(spark, str(tmp_path_factory.mktemp("tables")))
    samples = spark.createDataFrame(sample_rows(), SAMPLES)
    none = F.lit(None).cast("string")
    heads = trip_headers(samples).withColumns({"vehicle_uuid": none, "line_trip_id": none, "daily_trip_seq": F.lit(None).cast("int")})
    found.replace_trips(heads, samples)
    return found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_trip_once_for_plain_readers(tables):
    assert tables.read("trips").count() == 58 and "day" not in tables.read("trips").columns
    assert tables.read("trip_samples").count() == len(sample_rows())
    days = {r.trip_id: r.n for r in tables.read_by_day("trips").groupBy("trip_id").agg(F.count("*").alias("n")).collect()}
    assert days["t7"] == 5 and days["t0"] == 1 + (START + timedelta(minutes=80)).day - START.day
    assert tables.trip_days()[0] == START.date() and tables.latest_end() == max(r[3] for r in sample_rows())


@pytest.mark.parametrize("hours", [0, 1.5, 26, 36, 47.9, 60, 140, 400])
def test_same_answers_as_without_days(spark, tables, hours):
    at = START + timedelta(hours=hours)
    trips, samples, by_day = tables.read("trips"), tables.read("trip_samples"), (tables.read_by_day("trips"), tables.read_by_day("trip_samples"))
    shapes = spark.createDataFrame([("1", "City", 0, "bus", None, None)], LINE_SHAPES)
    stops = spark.createDataFrame([("1", "City", 1, "10", None)], LINE_STOPS)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    for numbering in ("window", "service_day"):
        assert same(plans.positions_at(trips, samples, shapes, at, numbering=numbering), plans.positions_at(*by_day, shapes, at, numbering=numbering))
    window = (at - timedelta(hours=9), at)
    assert same(plans.trajectories(trips, samples, stops, shapes, *window, clip_bounds=True), plans.trajectories(*by_day, stops, shapes, *window, clip_bounds=True))
    assert same(temporal.active_between(trips, *window), temporal.active_between(by_day[0], *window))


def test_an_instant_reads_its_days_only(spark, tables):
    """Partition filters on headers and samples, from a literal and from a scalar subquery."""
    at = START + timedelta(days=9)
    alive = temporal.active_around(tables.read_by_day("trips"), at)
    alive.collect()
    files = alive._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numPartitions").get().value()
    assert files == 1 < len(tables.trip_days())
    shapes = spark.createDataFrame([], LINE_SHAPES)
    asked = F.lit(at).cast("timestamp")
    for when in (at, spark.range(1).select(asked.alias("at")).select("at").scalar()):
        plan = plan_of(plans.positions_at(tables.read_by_day("trips"), tables.read_by_day("trip_samples"), shapes, when))
        assert plan.count("PartitionFilters: [isnotnull(day") >= 2
    plan = plan_of(plans.trajectories(tables.read_by_day("trips"), tables.read_by_day("trip_samples"), spark.createDataFrame([], LINE_STOPS), shapes, at - timedelta(hours=2), at))
    assert plan.count("PartitionFilters: [isnotnull(day") >= 2


def test_a_rebuild_of_some_lines_is_a_joint_snapshot(spark, tables, tmp_path, monkeypatch):
    """The other lines stay; a failure between headers and samples leaves readers where they were."""
    own = Tables(spark, str(tmp_path))
    trips, samples = tables.read("trips"), tables.read("trip_samples")
    own.replace_trips(trips, samples)
    own.replace_trips(trips.where("lineid = '1'").limit(0), samples.where("lineid = '1'").limit(0), lines=["1"])
    assert {r.lineid for r in own.read("trips").collect()} == {"2", "N3"} == {r.lineid for r in own.read("trip_samples").collect()}
    write = Tables.replace

    def broken(self, name, *rest):
        if name == "trip_samples":
            raise OSError("lost")
        write(self, name, *rest)

    monkeypatch.setattr(Tables, "replace", broken)
    with pytest.raises(OSError):
        own.replace_trips(trips, samples, lines=["1"])
    monkeypatch.undo()
    assert {r.lineid for r in own.read("trips").collect()} == {"2", "N3"} == {r.lineid for r in own.read("trip_samples").collect()}
    own.replace_trips(trips.where("lineid = '1'"), samples.where("lineid = '1'"), lines=["1"])
    assert own.read("trips").count() == 58 and own.read("trip_samples").count() == samples.count()
