"""Answers and plans that were wrong or grew too fast once."""

import gzip
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulseline.operators import shapes, temporal, trips
from pulseline.plans import pipelines, queries
from pulseline.sinks.tables import Tables
from pulseline.sources import catalogue

POINTS = "lineid string, direction string, seq int, lon double, lat double"
SAMPLES = "trip_id string, lineid string, direction int, ts timestamp, lon double, lat double"
ETA = "poll_ts timestamp, pointid string, lineid string, expected timestamp, destination string, message string"


def at(seconds):
    return datetime(2026, 5, 4, 9, 0, tzinfo=timezone.utc) + timedelta(seconds=seconds)


def samples_of(spark, *fixes):
    return spark.createDataFrame([(t, "1", 13, at(s), lon, 50.0) for t, s, lon in fixes], SAMPLES)


def test_a_shape_with_gaps_in_its_numbers_is_one_whole_line(spark):
    points = spark.createDataFrame([("1", "A", s, 4.0 + s, 50.0) for s in (4080, 4090, 4100, 4110, 9000)], POINTS)
    found = shapes.shape_geojson(points).collect()
    assert len(found) == 1 and found[0]["geometry"].count("50.0]") == 5
    parts = [r["geometry"] for r in shapes.shape_geojson(points, part_points=2).orderBy("part").collect()]
    assert len(parts) == 3 and [p.split("[[")[1].split("]")[0] for p in parts][1:] == [p.rsplit("[", 1)[1].split("]")[0] for p in parts][:-1]
    keys = spark.createDataFrame([("1", "A"), ("2", "B")], "lineid string, direction string")
    attributes = keys.where("lineid = '1'").selectExpr("*", "'bus' as mode", "'#1' as route_color", "'#2' as route_text_color")
    assert shapes.lookup_shapes(keys, attributes, points).count() == 2


def test_a_gap_wider_than_promised_changes_no_answer(spark):
    samples = samples_of(spark, ("a", 0, 4.0), ("a", 1000, 5.0), ("b", 400, 1.0), ("b", 600, 2.0))
    for headers in (None, trips.trip_headers(samples)):
        found = {r["trip_id"]: r["lon"] for r in temporal.value_at_instant(samples, at(500), headers, max_gap_s=300).collect()}
        assert found == {"a": pytest.approx(4.5), "b": pytest.approx(1.5)}


def test_parts_of_a_trip_carry_the_whole_trips_extent(spark):
    samples = samples_of(spark, ("a", 0, 4.0), ("a", 3500, 4.1), ("a", 3700, 4.2), ("a", 7300, 4.3))
    parts = trips.assemble_trips(samples).collect()
    assert len(parts) == 3 and {(r["point_count"], r["start_ts"], r["end_ts"]) for r in parts} == {
        (4, at(0).replace(tzinfo=None), at(7300).replace(tzinfo=None))}
    whole = trips.assemble_trips(samples, part_seconds=None).collect()
    assert len(whole) == 1 and [s["lon"] for s in whole[0]["samples"]] == [4.0, 4.1, 4.2, 4.3]


def test_centroid_of_a_shape_without_length(spark):
    points = spark.createDataFrame([("1", "A", 1, 4.0, 50.0), ("1", "A", 2, 4.0, 50.0), ("2", "A", 1, 4.0, 50.0), ("2", "A", 2, 5.0, 50.0)], POINTS)
    found = {r["lineid"]: (r["lon"], r["lat"]) for r in shapes.line_centroids(shapes.shape_segments(points)).collect()}
    assert found == {"1": (4.0, 50.0), "2": (4.5, 50.0)}


def test_a_trip_that_starts_at_the_end_of_the_window_is_outside(spark, rows):
    samples = samples_of(spark, ("in", 0, 4.0), ("in", 200, 4.2), ("out", 100, 1.0), ("out", 300, 2.0))
    for headers in (None, trips.trip_headers(samples)):
        found = temporal.samples_in_window(samples, at(50), at(100), clip_bounds=True, trips=headers)
        assert rows(found.select("trip_id", F.round("lon", 6))) == [("in", 4.05), ("in", 4.1)]


def test_cells_of_a_crowded_shape_grow_with_its_segments(spark):
    def cells(n):
        near = [("1", "A", i, 4.0 + i * 1e-9, 50.0) for i in range(n)]
        points = spark.createDataFrame([*near, ("1", "A", n, 5.0, 50.0)], POINTS)
        index = shapes.measured_segments(shapes.shape_segments(points))
        return shapes.fraction_cells(index)[0].count()
    small, large = cells(400), cells(1600)
    assert large < 6 * small


def test_documents_replace_line_stops_by_key_last_wins(spark, tmp_path, rows):
    def doc(*points):
        return {"lineid": "1", "direction": "City", "destination": "End", "points": json.dumps([{"id": p, "order": o} for p, o in points])}
    (tmp_path / "a.json").write_text(json.dumps([doc(("10", 1), ("11", 1), ("12", 2))]))
    (tmp_path / "b.json").write_text(json.dumps([doc(("20", 2))]))
    (tmp_path / "s.json").write_text(json.dumps([{"id": "5", "gpscoordinates": {"lat": 1, "lon": 9}, "name": "Z"},
                                                 {"id": "5", "gpscoordinates": {"lat": 1, "lon": 2}, "name": "A"}]))
    tables = Tables(spark, str(tmp_path / "tables"))
    pipelines.load_documents(spark, tables, [str(tmp_path / "s.json")], [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert rows(tables.read("line_stops").select("sequence_idx", "pointid")) == [(1, "11"), (2, "20")]
    assert rows(tables.read("line_terminus").select("terminus_pointid")) == [("20",)]
    assert rows(tables.read("stops").select("stop_name_fr", "lon")) == [("A", 2.0)]


def write_feed(folder):
    folder.mkdir()
    (folder / "routes.txt").write_text("route_id,route_short_name,route_type,route_color,route_text_color\nR1,1,0,,\n")
    (folder / "trips.txt").write_text("route_id,direction_id,shape_id\nR1,0,S\n")
    (folder / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\nS,1,50.0,4.0\nS,2,50.0,4.1\n")


def test_a_feed_without_termini_leaves_the_shapes(spark, tmp_path):
    write_feed(tmp_path / "feed")
    tables = Tables(spark, str(tmp_path / "tables"))
    pipelines.load_gtfs(spark, tables, str(tmp_path / "feed"))
    assert tables.read("line_shapes").count() == 0
    tables.replace("stops", spark.createDataFrame([("9", "x", "x", 4.1, 50.0)], "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double"))
    tables.replace("line_terminus", spark.createDataFrame([("1", "9", "City", "End")], "lineid string, terminus_pointid string, direction string, destination string"))
    pipelines.load_gtfs(spark, tables, str(tmp_path / "feed"))
    assert tables.read("shape_points").count() == 2
    tables.replace("line_terminus", tables.read("line_terminus").limit(0))
    pipelines.load_gtfs(spark, tables, str(tmp_path / "feed"))
    assert tables.read("line_shapes").count() == 1 and tables.read("shape_points").count() == 2


def test_a_malformed_geometry_is_no_shape(spark, tmp_path):
    path = tmp_path / "line_shapes.jsonl.gz"
    with gzip.open(path, "wt") as out:
        for geometry in ("LINESTRING(4 50, 5 50)", "LINESTRING(4 fifty", "POINT(1 2)"):
            out.write(json.dumps({"lineid": "1", "direction": geometry[:6], "variant": 0, "geom_wkt": geometry}) + "\n")
    found = catalogue.scan_line_shapes(spark, str(path))
    assert found.count() == 1 == found.where("path is not null").count()


def test_old_snapshots_go_and_half_written_trips_stay_unseen(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    stop = "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double"
    for n in range(6):
        tables.replace("stops", spark.createDataFrame([(str(n), "a", "a", 1.0, 1.0)], stop))
    assert len(list((tmp_path / "stops").iterdir())) == 2 and tables.read("stops").first()["pointid"] == "5"
    samples = samples_of(spark, ("a", 0, 4.0), ("a", 100, 4.1))
    header = "trip_id string, vehicle_uuid string, lineid string, direction int, start_ts timestamp, end_ts timestamp, point_count int, line_trip_id string, daily_trip_seq int"
    heads = spark.createDataFrame([("a", "v", "1", 13, at(0), at(100), 2, None, None)], header)
    tables.replace_trips(heads, samples)
    tables.replace("trips", heads.limit(0), ["lineid"], ["start_ts"])  # its samples never come
    assert tables.read("trips").count() == 1 and tables.read("trip_samples").count() == 2
    tables.replace_trips(heads.limit(0), samples.limit(0))
    assert tables.read("trips").count() == 0 == tables.read("trip_samples").count()


def test_ranking_in_buckets_changes_nothing(spark, rows):
    etas = spark.createDataFrame([(at(k % 40), "s", str(k % 7), at(k), "City" if k % 2 else None, f"m{k}") for k in range(500)], ETA)
    found = queries.waiting_times_per_stop(etas, limit=20)
    direct = queries.waiting_times_for_stop(etas, "s", limit=20)
    assert rows(found.select("poll_ts", "message")) == rows(direct.select("poll_ts", "message"))
    assert sorted(r["rn"] for r in found.collect()) == list(range(1, 21))


def test_labels_of_a_request_are_those_of_all_trips(spark, rows):
    heads = spark.createDataFrame([(f"t{k}", "1" if k % 3 else "N1", k % 2, at(k * 3600), at(k * 3600 + 60), 2) for k in range(120)],
                                  "trip_id string, lineid string, direction int, start_ts timestamp, end_ts timestamp, point_count int")
    chosen = heads.where("trip_id in ('t30', 't31', 't77', 't119')")
    every = trips.number_by_service_day(heads).select("trip_id", "line_trip_id")
    assert rows(queries._numbered(heads, chosen, "service_day").select("trip_id", "line_trip_id")) == rows(
        every.join(chosen.select("trip_id"), "trip_id"))


def test_positions_without_given_ids_are_looked_for_on_their_days_only(spark, tmp_path, monkeypatch):
    tables = Tables(spark, str(tmp_path))
    ping = "position_id string, vehicle_uuid string, lineid string, direction int, pointid string, distance_from_point double, fetched_at timestamp, lon double, lat double, id_given boolean"
    def one(name, day, given=False):
        return spark.createDataFrame([(name, None, "1", 13, "9", 0.0, at(day * 86400), 4.0, 50.0, given)], ping)
    tables.insert_positions(one("a", 0))
    seen = []
    from pulseline.sinks import tables as sinks
    whole = sinks.new_rows
    monkeypatch.setattr(sinks, "new_rows", lambda stored, *rest: seen.append(rest[1]) or whole(stored, *rest))
    tables.insert_positions(one("a", 0).unionByName(one("b", 3)))
    assert seen == [["service_date", "position_id"]]
    tables.insert_positions(one("a", 5, given=True))
    assert seen[1:] == [["service_date", "position_id"], ["position_id"]]
    assert tables.read("positions").count() == 2


def test_poll_time_comes_from_the_file_name(spark, tmp_path):
    from pulseline.streaming import polls
    (tmp_path / "in").mkdir()
    for name in ("polls_2026-05-04T09-00-20Z.json", "copy.json"):
        (tmp_path / "in" / name).write_text("{}")
    query = (polls.landed_payloads(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("polled_names")
             .trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    assert {r["polled"] for r in spark.table("polled_names").collect()} == {"2026-05-04T09:00:20+00:00", None}
