"""Stored arrival estimates: a stop's newest ones come from the newest days that hold enough of them."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from pulseline.plans import pipelines, queries
from pulseline.sinks.tables import Tables

START = datetime(2026, 3, 1, 0, 30, tzinfo=timezone.utc)
SCHEMA = "poll_ts timestamp, pointid string, lineid string, expected timestamp, destination string, message string"


def estimates(days, seed):
    """Busy stop "a", stop "b" with an estimate every few days, times that tie and times that are missing."""
    rng, rows = random.Random(seed), []
    for day in days:
        for k in range(30):
            poll = START + timedelta(days=day, minutes=rng.randrange(40) * 30)
            rows.append((poll, "a", str(rng.randrange(4)), poll + timedelta(minutes=rng.randrange(9)), rng.choice(["x", None]), None))
        if day % 4 == 0:
            rows.append((START + timedelta(days=day), "b", "71", None, None, "late"))
    return rows + [(None, "a", "9", None, None, f"{seed}"), (None, "b", None, None, None, None), (START, None, "1", None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    found = Tables(spark, str(tmp_path_factory.mktemp("arrivals")))
    # Out of order, the same days twice, and rows that are there already.
    for seed, days, once in ((1, range(8, 14), False), (2, range(0, 9), False), (3, range(12, 16), False), (1, range(8, 14), True)):
        found.append_waiting_times(spark.createDataFrame(estimates(days, seed), SCHEMA), once)
    return found


def listed(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("stop,limit", [("a", 1), ("a", 30), ("a", 31), ("a", 200), ("a", 569), ("a", 573), ("a", 5000), ("b", 1), ("b", 2),
                                        ("b", 4), ("b", 200), ("nowhere", 5)])
def test_same_rows_as_from_all_days(tables, stop, limit):
    whole = queries.waiting_times_for_stop(tables.read("waiting_times"), stop, limit)
    assert listed(pipelines.arrivals(tables, stop, limit)) == listed(whole)


def test_counts_are_those_of_the_rows(tables):
    rows = tables.read("waiting_times").groupBy("pointid", "poll_date").count()
    kept = tables.read("waiting_counts").groupBy("pointid", "poll_date").agg({"n": "sum"})
    assert sorted(map(str, listed(rows))) == sorted(map(str, listed(kept)))


@pytest.mark.parametrize("stop,limit,days", [("a", 20, 1), ("a", 70, 3), ("b", 1, 4), ("a", 5000, 17)])
def test_reads_the_newest_days_only(tables, stop, limit, days):
    found = pipelines.arrivals(tables, stop, limit)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "ubquery" in plan[plan.index("PartitionFilters"):]
    found.collect()
    leaves = found._jdf.queryExecution().executedPlan().executedPlan().plan().collectLeaves()
    assert leaves.head().metrics().get("numPartitions").get().value() == days


def test_lost_counts_only_widen_the_reading(spark, tables):
    counts = tables.read("waiting_counts").where("poll_date <> date'2026-03-15'")
    rows = tables.read("waiting_times")
    assert listed(queries.waiting_times_for_stop(rows, "a", 40, counts)) == listed(queries.waiting_times_for_stop(rows, "a", 40))
    none = counts.where("false")
    assert listed(queries.waiting_times_for_stop(rows, "b", 2, none)) == listed(queries.waiting_times_for_stop(rows, "b", 2))


def test_empty_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert listed(pipelines.arrivals(tables, "a")) == []
    tables.append_waiting_times(spark.createDataFrame([], SCHEMA))
    assert listed(pipelines.arrivals(tables, "a")) == []
