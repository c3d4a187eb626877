"""Stitched tile features and the stored tile table."""

import pytest

from pulseline.operators import tiles
from pulseline.plans import pipelines
from pulseline.sinks.tables import Tables

SEGMENT = "z int, x long, y long, lineid string, direction string, mode string, route_color string, route_text_color string, variant int, seq long, x0 int, y0 int, x1 int, y1 int"


def stitched(spark, segments):
    rows = [(11, 1, 2, "1", "City", "bus", None, None, 0, *s) for s in segments]
    found = tiles.line_features(spark.createDataFrame(rows, SEGMENT)).collect()
    assert len(found) <= 1
    return [[(p.x, p.y) for p in part] for part in found[0].parts] if found else []


def test_segments_that_meet_are_one_part(spark):
    assert stitched(spark, [(7, 3, 3, 4, 4), (1, 0, 0, 1, 1), (3, 1, 1, 3, 3)]) == [[(0, 0), (1, 1), (3, 3), (4, 4)]]


def test_a_line_that_comes_back_has_two_parts(spark):
    got = stitched(spark, [(1, 0, 0, 4160, 0), (5, 4160, 9, 0, 9), (6, 0, 9, 0, 20)])
    assert got == [[(0, 0), (4160, 0)], [(4160, 9), (0, 9), (0, 20)]]


def test_the_same_shape_in_two_tiles_is_two_features(spark):
    rows = [(11, x, 2, "1", d, "bus", None, None, None, 1, 0, 0, 5, 5) for x in (1, 2) for d in ("City", "Suburb")]
    found = tiles.line_features(spark.createDataFrame(rows, SEGMENT))
    assert sorted((r.x, r.direction) for r in found.collect()) == [(1, "City"), (1, "Suburb"), (2, "City"), (2, "Suburb")]
    assert tiles.line_features(spark.createDataFrame([], SEGMENT)).collect() == []


@pytest.mark.parametrize("z,x,y,key", [(0, 0, 0, ""), (1, 1, 0, "1"), (3, 3, 5, "213"), (13, 4194, 2747, None)])
def test_quadkeys(spark, z, x, y, key):
    own = tiles.quadkey_of(z, x, y)
    assert key is None or own == key
    row = spark.createDataFrame([(z, x, y)], "z int, x long, y long")
    assert row.select(tiles.quadkey(row.z, row.x, row.y)).first()[0] == own


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two lines along the same streets and one far off, over many tiles."""
    found = Tables(spark, str(tmp_path_factory.mktemp("tables")))
    points = [(line, "City", k, 4.0 + far + k * 0.02, 50.0 + far + (k % 3) * 0.01) for line, far in (("1", 0.0), ("2", 0.0), ("N3", 30.0)) for k in range(60)]
    found.replace("shape_points", spark.createDataFrame(points, "lineid string, direction string, seq int, lon double, lat double"))
    found.replace("line_shapes", spark.createDataFrame([(line, "City", 0, "tram", "#000000", None) for line in ("1", "2", "N3")],
                                                       "lineid string, direction string, variant int, mode string, route_color string, route_text_color string"))
    found.replace("stops", spark.createDataFrame([(str(k), f"stop {k}", None, 4.0 + k * 0.02, 50.0) for k in range(60)] + [("x", "nowhere", None, None, None)],
                                                 "pointid string, stop_name_fr string, stop_name_nl string, lon double, lat double"))
    found.replace("line_stops", spark.createDataFrame([("1", "City", k, str(k), None) for k in range(0, 60, 2)],
                                                      "lineid string, direction string, sequence_idx int, pointid string, destination string"))
    pipelines.rebuild_tiles(found, [9, 12])
    return found


def test_every_feature_is_found_in_its_tile(spark, tables):
    every = tables.read("tile_features").collect()
    assert {r.layer for r in every} == {"lines", "stops"} and {r.z for r in every} == {9, 12}
    some = sorted({(r.layer, r.z, r.x, r.y) for r in every})[::29]
    for layer, z, x, y in some:
        got = sorted(r.feature_id for r in pipelines.fetch_tile(tables, layer, z, x, y).collect())
        assert got == sorted(r.feature_id for r in every if (r.layer, r.z, r.x, r.y) == (layer, z, x, y))
    assert pipelines.fetch_tile(tables, "lines", 12, 0, 0).collect() == []


def test_line_filter(tables):
    r = next(r for r in tables.read("tile_features").where("layer = 'lines' and z = 9 and lineid = '2'").collect())
    fetch = lambda layer, lines: {f.feature_id for f in pipelines.fetch_tile(tables, layer, r.z, r.x, r.y, lines).collect()}
    assert fetch("lines", ["2"]) == {"2_City"} and fetch("lines", None) == {"1_City", "2_City"} and fetch("lines", ["9"]) == set()
    assert fetch("stops", ["1"]) and all(int(i) % 2 == 0 for i in fetch("stops", ["1"])) and len(fetch("stops", None)) > len(fetch("stops", ["1"]))


def test_one_tile_opens_few_files(spark, tables):
    """Layer, zoom and quadkey prefix prune partitions before any file is opened; the quadkey reaches the scan."""
    r = tables.read("tile_features").where("layer = 'lines' and z = 12").first()
    found = pipelines.fetch_tile(tables, "lines", 12, r.x, r.y)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "EqualTo(quadkey," in plan
    found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.head().metrics().get("numFiles").get().value() <= 2 < len(tables.read("tile_features").inputFiles())


def test_stored_table_replaces_itself(spark, tables):
    before = tables.read("tile_features").count()
    pipelines.rebuild_tiles(tables, [9, 12])
    assert tables.read("tile_features").count() == before
