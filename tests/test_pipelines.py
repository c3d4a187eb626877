import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_sources import dump, write_gtfs

from pulseline.operators import linking, positions
from pulseline.plans import pipelines
from pulseline.sinks.tables import Tables, write_mirror
from pulseline.sources import pings
from pulseline.streaming import polls

START = datetime(2026, 5, 4, 6, tzinfo=timezone.utc)


def text(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_catalogue(folder):
    dump(folder / "static/stops.jsonl.gz", [
        {"pointid": str(10 + i), "stop_name_fr": f"S{i}", "lon": 4.3 + 0.002 * i, "lat": 50.8} for i in range(5)])
    dump(folder / "static/line_stops.jsonl.gz", [
        {"lineid": "71", "direction": "City", "sequence_idx": i + 1, "pointid": str(10 + i), "destination": "End"} for i in range(5)])
    dump(folder / "static/line_terminus.jsonl.gz", [
        {"lineid": "71", "terminus_pointid": "14", "direction": "City", "destination": "End"}])
    path = ", ".join(f"{4.3 + 0.002 * i} 50.8" for i in range(5))
    dump(folder / "static/line_shapes.jsonl.gz", [
        {"lineid": "71", "direction": "City", "variant": 0, "mode": "tram", "geom_wkt": f"LINESTRING({path})"}])


def write_pings(folder, name="2026-05-04"):
    dump(folder / f"positions/{name}.jsonl.gz", [
        {"poll_ts": text(20 * k), "lineid": "71", "directionId": "14", "pointId": str(10 + k // 4), "distanceFromPoint": 30.0 * (k % 4)}
        for k in range(20)] + ["{broken"] + [
        {"poll_ts": text(0), "lineid": "71", "directionId": "terminus", "pointId": "10", "distanceFromPoint": 1}])


def counted(df):
    return {r["table_name"]: r["n"] for r in df.collect()}


def test_replaying_twice_adds_nothing(spark, tmp_path):
    dumps = tmp_path / "dumps"
    write_catalogue(dumps)
    write_pings(dumps)
    dump(dumps / "wt.jsonl.gz", [{"poll_ts": text(0), "pointid": "10", "lineid": "71"}])
    dump(dumps / "assignments.csv.gz", ["position_id,fetched_at_utc,lineId,direction,pointId,distance,latitude,longitude",
                                        f"given,{text(5000)},71,14,12,3,50.81,4.31"])
    tables = Tables(spark, str(tmp_path / "tables"))
    first = counted(pipelines.replay(spark, tables, [str(dumps)]))
    assert first == {"positions": 21, "trips": 0, "stops": 5, "line_shapes": 1, "waiting_times": 1}
    second = counted(pipelines.replay(spark, tables, [str(dumps)], stops_from_assignments=True))
    assert second == {**first, "waiting_times": 2}
    moved = tables.read("stops").where("pointid = '12'").first()
    assert (moved["lon"], moved["lat"], moved["stop_name_fr"]) == (4.31, 50.81, "S2")

    third = counted(pipelines.rebuild_trips(tables))
    assert third["trips"] == 1
    trip = tables.read("trips").first()
    samples = tables.read("trip_samples")
    assert trip["point_count"] == 20 == samples.count() and trip["lineid"] == "71"
    assert pipelines.rebuild_trips(tables, lines=["71"], chunk_rows=3).where("table_name = 'trips'").first()["n"] == 1
    assert tables.read("trips").first()["trip_id"] == trip["trip_id"]
    pipelines.rebuild_trips(tables, lines=["nope"])
    assert tables.read("trips").count() == 1
    tables.replace_trips(tables.read("trips").limit(0), tables.read("trip_samples").limit(0), lines=["71"])
    assert tables.read("trips").count() == 0 == tables.read("trip_samples").count()


def test_upsert_lets_the_last_row_win(spark, tmp_path, rows):
    tables = Tables(spark, str(tmp_path))
    schema = "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double, file string, row_no long"
    tables.upsert("stops", spark.createDataFrame([("1", "a", "a", 1.0, 1.0, "f", 1), ("2", "b", None, 2.0, 2.0, "f", 2),
                                                  ("1", "c", None, 3.0, 3.0, "f", 3)], schema))
    tables.upsert("stops", spark.createDataFrame([("2", None, "n", 9.0, 9.0, "g", 1), ("3", "d", None, 4.0, 4.0, "g", 2)], schema))
    assert rows(tables.read("stops")) == [("1", "c", None, 3.0, 3.0), ("2", None, "n", 9.0, 9.0), ("3", "d", None, 4.0, 4.0)]


def test_insert_ignore_keeps_the_first(spark, tmp_path, rows):
    tables = Tables(spark, str(tmp_path))
    schema = ("position_id string, vehicle_uuid string, lineid string, direction int, pointid string, "
              "distance_from_point double, fetched_at timestamp, lon double, lat double")
    later = START + timedelta(days=1)
    tables.insert_positions(spark.createDataFrame([("a", None, "1", 1, "x", None, START, 1.0, 1.0),
                                                   ("a", None, "2", 1, "x", None, later, 1.0, 1.0)], schema))
    tables.insert_positions(spark.createDataFrame([("a", None, "3", 1, "x", None, later, 1.0, 1.0),
                                                   ("b", None, "4", 1, "x", None, later, 1.0, 1.0)], schema))
    assert rows(tables.read("positions"), "position_id", "lineid") == [("a", "1"), ("b", "4")]


def test_waiting_times_append_and_append_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    df = spark.createDataFrame([(START, "1", None, None, None, None)], "poll_ts timestamp, pointid string, lineid string, "
                               "expected timestamp, destination string, message string")
    for once, want in ((False, 1), (False, 2), (True, 2)):
        tables.append_waiting_times(df, once)
        assert tables.read("waiting_times").count() == want


def test_mirror_replays_to_the_same_ids_and_is_never_overwritten(spark, tmp_path, rows):
    write_pings(tmp_path / "dumps")
    raw = positions.unique_pings(pings.scan_pings(spark, [str(tmp_path / "dumps")], kind="positions"))
    write_mirror(pings.mirror_records(raw), str(tmp_path / "mirror"), START)
    again = pings.scan_pings(spark, [str(tmp_path / "mirror")], kind="positions")
    assert rows(again, "position_id") == rows(raw, "position_id") and again.count() == 21
    with pytest.raises(Exception, match="(?i)exist"):
        write_mirror(pings.mirror_records(raw), str(tmp_path / "mirror"), START)


def test_documents_and_gtfs_fill_the_catalogue(spark, tmp_path, rows):
    tables = Tables(spark, str(tmp_path / "tables"))
    stops = [{"id": "t1", "gpscoordinates": {"latitude": 50.8201, "longitude": 4.3}, "name": "North"},
             {"id": "t2", "gpscoordinates": {"latitude": 50.8001, "longitude": 4.3}, "name": "South"}]
    lines = [{"lineid": "71", "direction": "Suburb", "destination": "North", "points": [{"id": "t2"}, {"id": "t1"}]},
             {"lineid": "71", "direction": "City", "destination": "South", "points": [{"id": "t1"}, {"id": "t2"}]}]
    (tmp_path / "stops.json").write_text(json.dumps(stops))
    (tmp_path / "lines.json").write_text(json.dumps({"results": lines}))
    for _ in range(2):
        pipelines.load_documents(spark, tables, [str(tmp_path / "stops.json")], [str(tmp_path / "lines.json")])
    assert rows(tables.read("line_terminus"), "terminus_pointid", "direction") == [("t1", "Suburb"), ("t2", "City")]
    write_gtfs(tmp_path)
    outcome = {r["skipped"]: r["n"] for r in pipelines.load_gtfs(spark, tables, str(tmp_path)).collect()}
    assert outcome == {None: 2, "no_terminus": 1, "short": 1, "unknown_route": 1}
    assert rows(tables.read("line_shapes"), "lineid", "direction", "mode") == [("71", "City", "tram"), ("71", "Suburb", "tram")]
    assert tables.read("shape_points").count() == 5


def test_polls_stream_into_positions_once(spark, tmp_path):
    write_catalogue(tmp_path / "dumps")
    tables = Tables(spark, str(tmp_path / "tables"))
    pipelines.replay(spark, tables, [str(tmp_path / "dumps" / "static"), str(tmp_path / "dumps")])
    landed = tmp_path / "landed"
    landed.mkdir()

    def land(name, k):
        body = {"polled": text(20 * k), "results": [{"lineid": "71", "vehiclepositions": json.dumps([
            {"directionId": "14", "pointId": str(10 + k % 5), "distanceFromPoint": 10 * k}] * 2)}]}
        (landed / name).write_text(json.dumps(body))

    for k in range(4):
        land(f"a{k}.json", k)
    land("copy.json", 3)

    def run():
        payloads = polls.landed_payloads(spark, str(landed), files_per_batch=2)
        stream = polls.payload_pings(payloads, F.get_json_object("value", "$.polled"))
        query = polls.start_position_stream(stream, tables, str(tmp_path / "checkpoint"), str(tmp_path / "mirror"))
        assert query.awaitTermination(240) and query.exception() is None

    run()
    assert tables.read("positions").count() == 4
    land("late.json", 2)
    land("new.json", 9)
    run()
    stored = tables.read("positions")
    assert stored.count() == 5 and stored.where("lon is null").count() == 0
    batch = polls.payload_pings(spark.read.text(str(landed), wholetext=True), F.get_json_object("value", "$.polled"))
    assert {r[0] for r in batch.select("position_id").collect()} == {r[0] for r in stored.select("position_id").collect()}
    assert linking.link_pings(stored).count() == 5


def test_a_replay_tells_what_became_of_its_records(spark, tmp_path):
    dumps = tmp_path / "dumps"
    write_catalogue(dumps)
    write_pings(dumps)
    dump(dumps / "positions/odd.jsonl.gz", [
        {"poll_ts": "soon", "lineid": "71", "directionId": "14", "pointId": "10"}, {"poll_ts": text(0), "lineid": "71", "directionId": "14"},
        {"poll_ts": text(0), "lineid": "9", "directionId": "14", "pointId": "nowhere"}])
    tables = Tables(spark, str(tmp_path / "tables"))
    for _ in range(2):
        pipelines.replay(spark, tables, [str(dumps)])
    runs = sorted({r.load for r in tables.read("load_report").collect()})
    found = [{(r.step, r.outcome): r.n for r in tables.read("load_report").where(F.col("load") == run).collect() if r.n} for run in runs]
    rejected = {("positions", f"rejected: {r}"): 1 for r in ("direction", "fetched_at", "no pointid")}
    assert found[0] == {**rejected, ("positions", "unlocated"): 1, ("positions", "inserted"): 20}
    assert found[1] == {**rejected, ("positions", "unlocated"): 1, ("positions", "known"): 20}
    dead = tables.read("rejected_pings").where(F.col("load") == runs[0]).collect()
    assert sorted(r.reason for r in dead) == ["direction", "fetched_at", "no pointid"]
    assert all("71" in r.record and "positions/" in r.file for r in dead)


def test_a_replay_of_nothing(spark, tmp_path):
    (tmp_path / "dumps").mkdir()
    tables = Tables(spark, str(tmp_path / "tables"))
    assert set(counted(pipelines.replay(spark, tables, [str(tmp_path / "dumps")])).values()) == {0}
    assert {r.n for r in tables.read("load_report").collect()} == {0} and tables.read("rejected_pings").count() == 0


def test_usable_records_equal_coerced_and_typed_ones(spark):
    values = [{"lineId": "71", "direction": "8", "pointId": "1", "distanceFromPoint": "2", "poll_ts": text(0)},
              {"position_id": "own", "lineid": "71", "directionId": "8", "pointid": "1", "fetched_at": text(9)},
              {"lineid": "71", "direction": "x", "pointid": "1", "poll_ts": text(0)}, {"lineid": "71"}, {}]
    records = spark.createDataFrame([(v,) for v in values], "record map<string,string>")
    typed = positions.typed_pings(positions.coerce_pings(records))
    rated = positions.rated_pings(records)
    assert sorted(map(repr, rated.where("not rejected").select(*typed.columns).collect())) == sorted(map(repr, typed.collect()))
    assert sorted(r.reason for r in rated.where("rejected").collect()) == ["direction", "no direction", "no lineid"]
