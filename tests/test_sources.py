import gzip
import json

import pytest
from pyspark.sql import functions as F

from pulseline.operators import network, positions
from pulseline.sources import catalogue, files, gtfs, pings


def dump(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as out:
        out.write("".join((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines))
    return str(path)


def test_kinds_and_load_order(spark, tmp_path):
    names = ["static/stops.jsonl.gz", "static/line_shapes.jsonl.gz", "static/other.jsonl.gz", "wt.jsonl.gz",
             "waiting_times/2026.jsonl.gz", "positions/2026-05-04.jsonl.gz", "assignments_may.csv.gz",
             "positions/notes.csv.gz", "positions/deep/er/x.jsonl.gz", "loose.jsonl.gz", "README.txt"]
    for n in names:
        dump(tmp_path / n, ["{}"])
    found = files.in_load_order(files.discover(spark, [str(tmp_path)])).select(
        F.regexp_replace("path", f"^.*{tmp_path.name}/", ""), "kind").collect()
    kinds = {r[0]: r[1] for r in found}
    assert kinds == {
        "static/stops.jsonl.gz": "static_stops", "static/line_shapes.jsonl.gz": "static_line_shapes",
        "static/other.jsonl.gz": "unknown", "wt.jsonl.gz": "waiting_times",
        "waiting_times/2026.jsonl.gz": "waiting_times", "positions/2026-05-04.jsonl.gz": "positions",
        "assignments_may.csv.gz": "assignments", "positions/notes.csv.gz": "unknown",
        "positions/deep/er/x.jsonl.gz": "positions", "loose.jsonl.gz": "unknown"}
    order = [r[1] for r in found]
    assert order[0] == "static_stops" and order[-1] == "unknown" and order.index("positions") < order.index("waiting_times")


def test_only_dumps_of_the_kind_are_read(spark, tmp_path):
    dump(tmp_path / "static/stops.jsonl.gz", [{"pointid": "1", "lon": 4.3, "lat": 50.8}])
    dump(tmp_path / "positions/a.jsonl.gz", [{"pointid": "2"}])
    got = files.json_records(spark, [str(tmp_path)], kind="static_stops")
    assert [r["record"]["pointid"] for r in got.collect()] == ["1"]


def test_blank_and_malformed_lines_are_skipped(spark, tmp_path, rows):
    path = dump(tmp_path / "stops.jsonl.gz", [
        "", "  ", "{not json", {"pointid": "1", "lon": 4.3, "lat": 50.8, "stop_name_fr": "Gare"},
        {"pointid": "2", "lon": None, "lat": 50.8}, {"lon": 4.3, "lat": 50.8}])
    assert rows(catalogue.scan_stops(spark, path), "pointid", "stop_name_fr", "lon") == [("1", "Gare", 4.3)]


def test_catalogue_scans_need_their_key_fields(spark, tmp_path, rows):
    seq = dump(tmp_path / "ls.jsonl.gz", [
        {"lineid": "1", "direction": "City", "sequence_idx": 3, "pointid": "9"},
        {"lineid": "1", "direction": "City", "pointid": "9"}])
    end = dump(tmp_path / "lt.jsonl.gz", [
        {"lineid": "1", "terminus_pointid": "9", "direction": "City", "destination": "Gare"}, {"lineid": "1"}])
    shape = dump(tmp_path / "sh.jsonl.gz", [
        {"lineid": "1", "direction": "City", "variant": 1, "mode": "tram", "geom_wkt": "LINESTRING(4.3 50.8, 4.4 50.9)"},
        {"lineid": "1", "direction": "City", "geom_wkt": ""}])
    assert rows(catalogue.scan_line_stops(spark, seq), "sequence_idx", "pointid") == [(3, "9")]
    assert rows(catalogue.scan_line_terminus(spark, end), "terminus_pointid", "destination") == [("9", "Gare")]
    shapes = catalogue.scan_line_shapes(spark, shape)
    assert rows(catalogue.shape_vertices(shapes)) == [("1", "City", 1, 4.3, 50.8), ("1", "City", 2, 4.4, 50.9)]


def test_ping_coercion(spark, tmp_path, rows):
    base = {"lineId": "71", "directionId": 0, "pointId": "0", "poll_ts": "2026-05-04T10:00:00Z"}
    path = dump(tmp_path / "p.jsonl.gz", [
        {**base, "distanceFromPoint": 34}, {**base, "distanceFromPoint": 34.0}, {**base, "distanceFromPoint": "34"},
        {**base, "distanceFromPoint": "far"}, {**base, "distanceFromPoint": 5, "distance_from_point": None},
        {**base, "distanceFromPoint": 5, "position_id": "given"},
        {**base, "lineId": "", "lineid": "72", "fetched_at": "2026-05-04T11:00:00Z"},
        {**base, "pointId": None}, {k: v for k, v in base.items() if k != "poll_ts"}])
    got = pings.scan_pings(spark, path)
    assert rows(got, "lineid", "direction", "pointid", "distance_from_point", "fetched_at_text") == sorted([
        *[("71", "0", "0", 34.0, "2026-05-04T10:00:00Z")] * 3, *[("71", "0", "0", None, "2026-05-04T10:00:00Z")] * 2,
        ("71", "0", "0", 5.0, "2026-05-04T10:00:00Z"), ("72", "0", "0", None, "2026-05-04T11:00:00Z")], key=repr)
    assert got.where("distance_from_point = 34").select("position_id").distinct().count() == 1
    assert got.where("position_id = 'given'").count() == 1
    outcomes = positions.ping_outcomes(files.json_records(spark, path))
    assert rows(outcomes) == [("kept", 7), ("no fetched_at_text", 1), ("no pointid", 1)]
    assert positions.unique_pings(got).count() == 4


def test_pings_that_do_not_parse_are_told_apart(spark, rows):
    df = spark.createDataFrame(
        [("a", "71", "x1", "9", None, "2026-05-04T10:00:00Z"), ("b", "71", "007", "9", None, "2026-05-04T10:00:00Z"),
         ("c", "71", "7", "9", None, "soon")],
        "position_id string, lineid string, direction string, pointid string, distance_from_point double, fetched_at_text string")
    assert rows(positions.typed_pings(df), "position_id", "direction") == [("b", 7)]
    assert rows(positions.rejected_pings(df), "position_id", "reason") == [("a", "direction"), ("c", "fetched_at")]


def test_assignments(spark, tmp_path, rows):
    head = "position_id,fetched_at_utc,lineId,direction,pointId,distance,latitude,longitude"
    path = dump(tmp_path / "assignments.csv.gz", [
        head, "a,2026-05-04T10:00:00Z,71,8472,12,34,50.8,4.3", "b,2026-05-04T10:01:00Z,71,x,,,50.9,4.4",
        "c,2026-05-04T10:02:00Z,71,1,12,far,50.7,4.2", "d,soon,71,1,12,1,50.7,4.2", "e,2026-05-04T10:00:00Z,71,1,12,1,,4.2"])
    got = pings.scan_assignments(spark, path)
    assert rows(got, "position_id", "direction", "pointid", "distance_from_point", "lon", "lat") == [
        ("a", 8472, "12", 34.0, 4.3, 50.8), ("b", None, None, None, 4.4, 50.9), ("c", 1, "12", None, 4.2, 50.7)]
    assert rows(pings.observed_stops(got)) == [("12", 4.2, 50.7)]


def test_waiting_times(spark, tmp_path, rows):
    path = dump(tmp_path / "wt.jsonl.gz", [
        {"poll_ts": "2026-05-04T10:00:00Z", "pointid": "1", "lineid": "71", "expected": "2026-05-04T10:05:00+00:00"},
        {"poll_ts": "2026-05-04T10:00:00Z", "pointid": "1", "expected": "soon"}, {"poll_ts": "x"}, {"pointid": "1"}])
    got = pings.scan_waiting_times(spark, path)
    assert rows(got.select("lineid", F.unix_seconds("expected") - F.unix_seconds("poll_ts"))) == [("71", 300), (None, None)]


def test_stop_documents(spark, tmp_path, rows):
    docs = [
        {"id": 1, "gpscoordinates": '{"latitude": 50.8, "longitude": 4.3}', "name": '{"fr": "Gare", "nl": "Station"}'},
        {"pointId": "2", "gpsCoordinates": {"lat": "50.9", "lng": "4.4"}, "name": {"fr": "Parc"}},
        {"pointid": "3", "gpscoordinates": {"lat": 50.7, "lon": 4.2}, "name": "Bourse"},
        {"id": "4", "gpscoordinates": {"lat": 50.7, "lon": 4.2}, "name": "12"},
        {"id": "5", "gpscoordinates": "nowhere"}, {"id": "6"}, {"gpscoordinates": {"lat": 1, "lon": 2}},
        {"id": "7", "gpscoordinates": {"lat": 0, "latitude": None, "lon": 4.0}}]
    want = [("1", "Gare", "Station", 4.3, 50.8), ("2", "Parc", None, 4.4, 50.9), ("3", "Bourse", "Bourse", 4.2, 50.7),
            ("4", None, None, 4.2, 50.7), ("7", None, None, 4.0, 0.0)]
    for name, text in (("array.json", json.dumps(docs, indent=1)), ("page.json", json.dumps({"total": 7, "results": docs})),
                       ("lines.json", "\n".join(map(json.dumps, docs)))):
        (tmp_path / name).write_text(text)
        got = catalogue.decode_stop_documents(catalogue.documents(spark, str(tmp_path / name)))
        assert rows(got) == want


def test_line_documents(spark, tmp_path, rows):
    docs = [
        {"lineid": "71", "direction": "City", "destination": '{"fr": "Gare", "nl": "Station"}',
         "points": json.dumps([{"id": "c", "order": 3}, {"id": "a", "order": 1}, {"id": "b", "order": "2"}])},
        {"lineId": 72, "direction": "City", "destination": {"fr": "", "nl": "Kust"}, "points": [{"id": "x"}, "junk", {"pointId": 5}]},
        {"lineid": "73", "direction": "City", "destination": "Plain", "points": [{"id": "x", "order": "bad"}, {"order": 2}]},
        {"lineid": "74", "direction": "City", "points": "no list"}, {"lineid": "75", "points": [{"id": "x"}]}]
    (tmp_path / "l.json").write_text(json.dumps(docs))
    lines = catalogue.decode_line_documents(catalogue.documents(spark, str(tmp_path / "l.json")))
    assert rows(lines, "lineid", "sequence_idx", "pointid", "destination") == [
        ("71", 1, "a", "Gare"), ("71", 2, "b", "Gare"), ("71", 3, "c", "Gare"),
        ("72", 1, "x", "Kust"), ("72", 3, "5", "Kust"), ("73", 1, "x", "Plain")]
    assert rows(catalogue.terminus_of(lines), "lineid", "terminus_pointid") == [("71", "c"), ("72", "5"), ("73", "x")]


def test_live_payload(spark, rows):
    payload = [
        {"lineid": "71", "vehiclepositions": json.dumps([
            {"directionId": 8472, "pointId": "12", "distanceFromPoint": 34},
            {"directionId": 0, "direction": "99", "pointId": "", "pointid": "13", "distance_from_point": "7"},
            {"directionId": "0", "pointId": 0, "point_id": "14", "distanceFromPoint": None, "distance_from_point": 8},
            {"directionId": "x", "pointId": "1"}, {"pointId": "1"}, "junk"])},
        {"lineId": 72, "vehicle_positions": [{"direction": "5", "pointid": "6"}, {"direction": 0, "point_id": "7"},
                                              {"directionId": 0, "pointid": "8"}]},
        {"lineid": "73", "vehiclepositions": "broken"}, {"lineid": "74"}, "junk"]
    files_df = spark.createDataFrame([(json.dumps({"results": payload}),)], "value string")
    got = positions.coerce_pings(pings.flatten_payload(
        catalogue.document_items(files_df), F.lit("2026-05-04T10:00:00+00:00")))
    assert rows(got, "lineid", "direction", "pointid", "distance_from_point") == sorted([
        ("71", "8472", "12", 34.0), ("71", "99", "13", 7.0), ("71", "0", "14", None), ("72", "5", "6", None),
        ("72", "0", "7", None)], key=repr)


def write_gtfs(folder, bom="﻿"):
    (folder / "routes.txt").write_text(
        f"{bom}route_id,route_short_name,route_type,route_color,route_text_color\n"
        "R1, 71 ,0,ab12cd,xyz\nR2,72,3,,#ffffff\n,73,1,,\nR3,,1,,\nR4,74,99,,\n", encoding="utf-8")
    (folder / "trips.txt").write_text(
        "route_id,direction_id,shape_id\n" + "R1,0,late\nR1,0,tie\nR1,0,tie\nR1,0,late\nR1,1,back\nR2,x,bad\nR2,0,far\n"
        "R4,0,alone\nR9,0,late\n")
    (folder / "shapes.txt").write_text(
        "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\n"
        "late,10,50.80,4.30\nlate,30,50.82,4.30\nlate,20,50.81,4.30\n"
        "back,1,50.80,4.3001\nback,2,50.85,4.40\nfar,1,10,10\nfar,2,11,11\nalone,1,50.8,4.3\nunused,1,1,1\nunused,2,2,2\n"
        "late,40,oops,4.3\n")


def test_gtfs_to_line_shapes(spark, tmp_path, rows):
    write_gtfs(tmp_path)
    folder = str(tmp_path)
    routes = gtfs.route_attributes(gtfs.scan_routes(spark, folder))
    assert rows(routes) == [("R1", "71", "tram", "#AB12CD", None), ("R2", "72", "bus", None, "#FFFFFF"),
                            ("R4", "74", "other", None, None)]
    canonical = network.canonical_shapes(gtfs.scan_trips(spark, folder))
    assert rows(canonical, "route_id", "direction_id", "shape_id", "trips") == [
        ("R1", 0, "late", 2), ("R1", 1, "back", 1), ("R2", 0, "far", 1), ("R4", 0, "alone", 1), ("R9", 0, "late", 1)]
    lines = network.assemble_polylines(gtfs.scan_shapes(spark, folder), canonical)
    assert rows(lines, "shape_id", "idx", "lat") == [
        ("back", 1, 50.8), ("back", 2, 50.85), ("far", 1, 10.0), ("far", 2, 11.0), ("late", 1, 50.8), ("late", 2, 50.81),
        ("late", 3, 50.82)]
    termini = spark.createDataFrame(
        [("71", "Suburb", "t1", 4.30, 50.8201), ("71", "City", "t2", 4.30, 50.8001), ("72", "City", "t3", 4.3, 50.8)],
        "lineid string, direction string, terminus_pointid string, lon double, lat double")
    found = network.shape_directions(canonical, lines, routes, termini)
    assert rows(found, "route_id", "direction_id", "dir_label", "reverse", "skipped") == [
        ("R1", 0, "Suburb", False, None), ("R1", 1, "City", True, None), ("R2", 0, None, None, "far"),
        ("R4", 0, None, None, "short"), ("R9", 0, None, None, "unknown_route")]
    shapes, vertices = network.gtfs_line_shapes(found, lines, routes)
    assert rows(shapes) == [("71", "City", 1, "tram", "#AB12CD", None), ("71", "Suburb", 0, "tram", "#AB12CD", None)]
    assert rows(vertices.where("direction = 'City'"), "seq", "lat") == [(1, 50.85), (2, 50.8)]


@pytest.mark.parametrize("name,kind", [("static/stops.jsonl.gz", "static_stops"), ("positions/feed.jsonl.gz", "positions"),
                                       ("waiting_times/polls.jsonl.gz", "waiting_times"), ("assignments_2024.csv.gz", "assignments")])
def test_dumps_are_as_many_files_as_tasks(spark, tmp_path, name, kind):
    from checks.queries import _dump
    _dump(spark.range(0, 40, 1, 4), f"{tmp_path}/all", name)
    found = files.discover(spark, [f"{tmp_path}/all"]).collect()
    assert [f.kind for f in found] == [kind] * 4
    read = spark.read.option("recursiveFileLookup", True)
    rows = read.option("header", True).csv(f"{tmp_path}/all") if ".csv" in name else read.json(f"{tmp_path}/all")
    assert sorted(int(r.id) for r in rows.collect()) == list(range(40))


def test_assignment_files_by_their_own_headers(spark, tmp_path, rows):
    dump(tmp_path / "assignments_a.csv.gz", ["position_id,fetched_at_utc,lineId,direction,pointId,distance,latitude,longitude",
                                             "a,2026-05-04T10:00:00Z,71,8472,12,34,50.8,4.3"])
    dump(tmp_path / "assignments_b.csv.gz", ["﻿longitude,latitude,note,fetched_at_utc,position_id,lineId",
                                             '4.4,50.9,"odd, quoted",2026-05-04T10:01:00Z,b,92', "4.5,51.0"])
    dump(tmp_path / "assignments_c.csv.gz", ["position_id,lineId", "c,71"])
    dump(tmp_path / "other.csv.gz", ["position_id,fetched_at_utc,latitude,longitude", "d,2026-05-04T10:00:00Z,50.8,4.3"])
    got = pings.scan_assignments(spark, [str(tmp_path)], search=True)
    assert rows(got, "position_id", "lineid", "direction", "pointid", "lon", "lat") == [
        ("a", "71", 8472, "12", 4.3, 50.8), ("b", "92", None, None, 4.4, 50.9)]
