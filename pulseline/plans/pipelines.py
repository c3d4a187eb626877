"""The jobs: replay dumps into tables, load documents and GTFS, rebuild trips."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulseline.durable import materialise, observed, scratch_scope
from pulseline.operators import linking, network, positions, tiles
from pulseline.operators.catalogue import terminus_locations
from pulseline.operators.ordered import earliest_per_key
from pulseline.plans.queries import table_counts, waiting_times_for_stop
from pulseline.sinks.tables import KEYS, SCHEMAS, Tables
from pulseline.sources import catalogue, gtfs, pings

COUNTED = ["positions", "trips", "stops", "line_shapes", "waiting_times"]


def counts(tables: Tables) -> DataFrame:
    return table_counts({name: tables.read(name) for name in COUNTED})


def resolve_against(tables: Tables, typed: DataFrame, index: positions.ShapeIndex | None = None) -> DataFrame:
    index = index or positions.ShapeIndex.build(tables.read("shape_points"))
    return positions.resolve_positions(typed, tables.read("stops"), tables.read("line_terminus"), index)


def load_pings(tables: Tables, records: DataFrame, load: str = "") -> dict[str, int]:
    """Raw ping records to located, stored positions. The insert collapses copies, so
    pings are shuffled by id once. Records that cannot be used go to ``rejected_pings`` with the reason.
    Returns records per outcome, counted while they are written: each reason, pings whose stop and
    shape are unknown, ids that were there already, new positions."""
    seen = Observation()
    told = [F.count_if(F.col("reason") == r).alias(r) for r in positions.REASONS]
    with scratch_scope(tables.spark):
        rated = positions.rated_pings(records).observe(seen, F.count_if(F.col("reason").isNull()).alias("usable"), *told)
        rows = materialise(rated, "pings", "rejected")
        tables.append("rejected_pings", rows.where("rejected").select(F.lit(load).alias("load"), "file", "reason", F.col("raw").alias("record")))
        stored = tables.insert_positions(resolve_against(tables, rows.where("not rejected").drop("reason", "file", "raw", "rejected")))
    counted = observed(seen)
    return {**{f"rejected: {r}": counted.get(r, 0) for r in positions.REASONS}, "unlocated": counted.get("usable", 0) - stored["incoming"],
            "known": stored["incoming"] - stored["inserted"], "inserted": stored["inserted"]}


def store_shapes(tables: Tables, shapes: DataFrame, vertices: DataFrame, replace: bool) -> None:
    key = ["lineid", "direction"]
    if replace:
        tables.replace("line_shapes", shapes)
    else:
        others = tables.read("shape_points").join(shapes.select(*key).distinct(), key, "left_anti")
        vertices = others.unionByName(vertices)
        tables.upsert("line_shapes", shapes)
    tables.replace("shape_points", vertices, (), [*key, "seq"])


def replay(spark: SparkSession, tables: Tables, folders: list[str], stops_from_assignments: bool = False,
           spread: int | None = None) -> DataFrame:
    """Loads every dump below ``folders``, catalogue first. Running it again adds
    nothing but waiting times, which have no key. Returns rows per table; what became of the
    records of this run is added to the table ``load_report``."""
    load = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S.%f}"
    report: list[tuple[str, str, str, int]] = []
    for name, scan in (("stops", catalogue.scan_stops), ("line_stops", catalogue.scan_line_stops),
                       ("line_terminus", catalogue.scan_line_terminus)):
        rows = scan(spark, folders, kind=f"static_{name}")
        if not rows.isEmpty():
            tables.upsert(name, rows)
    shapes = catalogue.scan_line_shapes(spark, folders, kind="static_line_shapes")
    if not shapes.isEmpty():
        last = earliest_per_key(shapes, ["lineid", "direction"], ["file", "row_no"], latest=True)
        store_shapes(tables, last.drop("path"), catalogue.shape_vertices(last), replace=False)
    assigned = pings.scan_assignments(spark, folders, search=True)
    if not assigned.isEmpty():
        stored = tables.insert_positions(assigned.where("position_id is not null"))
        report += [(load, "assignments", "known", stored["incoming"] - stored["inserted"]), (load, "assignments", "inserted", stored["inserted"])]
        if stops_from_assignments:
            tables.upsert("stops", pings.observed_stops(assigned), ["pointid"], ["lon", "lat"])
    outcomes = load_pings(tables, pings.scan_ping_records(spark, folders, spread), load)
    report += [(load, "positions", outcome, n) for outcome, n in outcomes.items()]
    appended = Observation()
    tables.append_waiting_times(pings.scan_waiting_times(spark, folders, spread, kind="waiting_times").observe(appended, F.count(F.lit(1)).alias("n")))
    report.append((load, "waiting_times", "appended", observed(appended).get("n", 0)))
    tables.append("load_report", spark.createDataFrame(report, SCHEMAS["load_report"]).coalesce(1))
    return counts(tables)


def load_documents(spark: SparkSession, tables: Tables, stop_paths: list[str] | None = None,
                   line_paths: list[str] | None = None) -> None:
    """Stop documents upsert stops; stops-by-line documents replace the line
    sequences and their termini."""
    if stop_paths:
        stops = catalogue.decode_stop_documents(catalogue.documents(spark, stop_paths, placed=True))
        tables.upsert("stops", stops, catalogue.PLACE, ["stop_name_fr", "stop_name_nl", "lon", "lat"])
    if line_paths:
        lines = catalogue.decode_line_documents(catalogue.documents(spark, line_paths, placed=True))
        place = [*catalogue.PLACE, "point_no"]
        last = materialise(earliest_per_key(lines, KEYS["line_stops"], place, latest=True).drop(*place), "line-stops")
        tables.replace("line_stops", last)
        tables.replace("line_terminus", catalogue.terminus_of(last))


def load_gtfs(spark: SparkSession, tables: Tables, folder: str) -> DataFrame:
    """Line shapes from an unpacked GTFS feed. Returns shapes per outcome: NULL
    for those used, else why they were skipped. Without a located terminus no shape
    could be used, so the stored ones stay."""
    termini = terminus_locations(tables.read("line_terminus"), tables.read("stops"))
    canonical = network.canonical_shapes(gtfs.scan_trips(spark, folder))
    polylines = network.assemble_polylines(gtfs.scan_shapes(spark, folder), canonical)
    routes = gtfs.route_attributes(gtfs.scan_routes(spark, folder))
    directions = network.shape_directions(canonical, polylines, routes, termini)
    directions = materialise(directions, "shape-directions")
    if not termini.isEmpty():
        shapes, vertices = network.gtfs_line_shapes(directions, polylines, routes)
        store_shapes(tables, shapes, vertices, replace=True)
    return directions.groupBy("skipped").agg(F.count(F.lit(1)).alias("n"))


def rebuild_trips(tables: Tables, lines: list[str] | None = None,
                  chunk_rows: int = linking.CHUNK_ROWS) -> DataFrame:
    """Links all stored positions, or those of some lines, into trips."""
    located = tables.read("positions")
    if lines is not None:
        located = located.where(F.col("lineid").isin(lines))
    with scratch_scope(tables.spark):
        linked = materialise(linking.link_pings(located, chunk_rows), "linked-pings")  # read three times below
        headers, kept = linking.build_trips(linking.trip_samples(linked))
        tables.replace_trips(headers, kept, lines)
    return counts(tables)


def arrivals(tables: Tables, pointid: str, limit: int = 200) -> DataFrame:
    """Latest stored arrival estimates at a stop, from the newest days that hold enough of them."""
    return waiting_times_for_stop(tables.read("waiting_times"), pointid, limit, tables.read("waiting_counts"))


def rebuild_tiles(tables: Tables, zooms: list[int], min_area: float = tiles.SIMPLIFY_AREA_M2) -> None:
    """Pre-builds the features of all lines and stops for these zooms into the tile table."""
    with scratch_scope(tables.spark):
        segments = tiles.tile_lines(tables.read("shape_points"), tables.read("line_shapes"), zooms, min_area=min_area)
        tables.replace_tiles(tiles.feature_rows(tiles.line_features(segments), tiles.tile_stops(tables.read("stops"), zooms)))


def fetch_tile(tables: Tables, layer: str, z: int, x: int, y: int, lines: list[str] | None = None) -> DataFrame:
    """One tile's features of layer "lines" or "stops"; with ``lines`` only these lines, or the stops they serve."""
    found = tiles.in_tile(tables.read("tile_features"), layer, z, x, y)
    if lines is None:
        return found
    if layer == "lines":
        return found.where(F.col("lineid").isin(lines))
    served = tables.read("line_stops").where(F.col("lineid").isin(lines)).select(F.col("pointid").alias("feature_id"))
    return found.join(served, "feature_id", "left_semi")
