"""Line geometry as segment rows: length, centroid, locating stops, interpolation.

A polyline is a set of rows (lineid, direction, seq, lon, lat). Fractions along
it are planar (degrees); lengths in metres are geodesic. The mix is deliberate:
it is what the rebuilt positions are defined by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.geo import geodesic_segment_m, geojson_linestring, lerp, planar_length
from pulseline.operators.ordered import next_row, running_number, running_total

SHAPE = ["lineid", "direction"]
SEQ_BUCKET = 4096
NODE_FANOUT = 16
CELL_BLOCK = 1024
# Segments in one grid cell from which on the cell is divided.
CROWDED = 64


def shape_segments(points: DataFrame) -> DataFrame:
    """Consecutive vertex pairs with planar and geodesic length."""
    bucketed = points.withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    ahead = next_row(bucketed, SHAPE, "_bucket", ["seq"], ["lon", "lat"], "end")
    ends = [F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")]
    return (
        ahead.where("end is not null")
        .select(*SHAPE, "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"),
                F.col("end.lon").alias("lon2"), F.col("end.lat").alias("lat2"))
        .withColumns({"planar": planar_length(*ends), "metres": geodesic_segment_m(*ends)})
    )


def shape_lengths(segments: DataFrame) -> DataFrame:
    """Per shape: geodesic metres, planar total, number of non-empty segments."""
    return segments.groupBy(*SHAPE).agg(
        F.sum("metres").alias("length_m"), F.sum("planar").alias("planar_total"),
        F.count_if(F.col("planar") > 0).alias("n_segments"))


def line_centroids(segments: DataFrame) -> DataFrame:
    """Length-weighted mean of segment midpoints (planar); the first vertex of a shape
    without length."""
    def weighted(a: str, b: str):
        mean = F.try_divide(F.sum(F.col("planar") * (F.col(a) + F.col(b)) / 2), F.sum("planar"))
        return F.coalesce(mean, F.min_by(a, "seq"))
    return (
        segments.groupBy(*SHAPE)
        .agg(weighted("lon1", "lon2").alias("lon"), weighted("lat1", "lat2").alias("lat"))
    )


def measured_segments(segments: DataFrame) -> DataFrame:
    """Non-empty segments with their fraction range [f0, f1) along the shape;
    ``f1`` is NULL on the last one, which is closed at its end."""
    totals = shape_lengths(segments).where("planar_total > 0")
    solid = segments.where("planar > 0").withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    summed = running_total(solid, SHAPE, "_bucket", ["seq"], "planar", "before")
    return (
        next_row(summed, SHAPE, "_bucket", ["seq"], ["before"], "_after")
        .join(totals, SHAPE)
        .withColumns({"f0": F.col("before") / F.col("planar_total"),
                      "f1": F.col("_after.before") / F.col("planar_total")})
        .drop("_bucket", "_after")
    )


def _bounding_nodes(segments: DataFrame, level: int) -> DataFrame:
    """Boxes over runs of NODE_FANOUT**level consecutive segments, with the first vertex (``hx``, ``hy``) of each run."""
    return (
        segments.groupBy(*SHAPE, F.floor(F.col("seq") / NODE_FANOUT ** level).alias("node"))
        .agg(F.min(F.least("lon1", "lon2")).alias("west"), F.max(F.greatest("lon1", "lon2")).alias("east"),
             F.min(F.least("lat1", "lat2")).alias("south"), F.max(F.greatest("lat1", "lat2")).alias("north"),
             F.min_by("lon1", "seq").alias("hx"), F.min_by("lat1", "seq").alias("hy"))
    )


def _packed_boxes(segments: DataFrame, level: int, levels: int) -> DataFrame:
    """The boxes of a level as one array for each box above (``node``); for each shape at the top."""
    above = [] if level == levels else [F.floor(F.col("node") / NODE_FANOUT).alias("node")]
    box = F.struct("node", "west", "east", "south", "north", "hx", "hy")
    return _bounding_nodes(segments, level).groupBy(*SHAPE, *above).agg(F.collect_list(box).alias("boxes"))


def _with(value: Column, use) -> Column:
    """The array that ``use`` makes of a value, which is computed once for all of its elements."""
    return F.flatten(F.transform(F.array(value), use))


def node_levels(measured: DataFrame) -> int:
    """Levels of boxes that leave at most NODE_FANOUT of them at the top."""
    span = measured.agg(F.max("seq") - F.min("seq")).first()[0] or 0
    return max(1, math.ceil(math.log(max(span, 2), NODE_FANOUT)) - 1)


def locate_on_shapes(places: DataFrame, measured: DataFrame, levels: int | None = None) -> DataFrame:
    """Fraction of the nearest point of a place's shape; the first nearest
    segment wins. ``places``: lineid, direction, pointid, lon, lat.

    A descent through bounding boxes: at each level only boxes that can still
    hold the nearest segment (lower bound within the best upper bound) go on, so
    a place meets a few segments of its shape, not all of them. The boxes below a box,
    and the segments of the lowest ones, are arrays of at most NODE_FANOUT that are
    searched inside a row: what is shuffled or sorted is a few rows for each place.
    """
    key = [*SHAPE, "pointid"]
    levels = node_levels(measured) if levels is None else levels
    lon, lat = F.col("lon"), F.col("lat")

    def least(box: Column) -> Column:
        dx = F.greatest(box["west"] - lon, F.lit(0.0), lon - box["east"])
        dy = F.greatest(box["south"] - lat, F.lit(0.0), lat - box["north"])
        return dx * dx + dy * dy

    def head(box: Column) -> Column:
        hx, hy = box["hx"] - lon, box["hy"] - lat
        return hx * hx + hy * hy

    def near(reach: Column) -> Column:
        # The slack only covers rounding of the two bounds.
        kept = F.filter("boxes", lambda box: least(box) <= reach * (1 + 1e-9) + 1e-18)
        return F.transform(kept, lambda box: F.struct(box["node"].alias("node"), reach.alias("_reach")))

    seeds = places.select(*key, "lon", "lat")
    for level in range(levels, 0, -1):
        reach = F.array_min(F.transform("boxes", head))
        if level < levels:
            reach = F.least(reach, "_reach")
        on = SHAPE if level == levels else [*SHAPE, "node"]
        seeds = seeds.join(_packed_boxes(measured, level, levels), on).select(*key, "lon", "lat", F.inline(_with(reach, near)))
    vx, vy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    segment = F.struct("seq", "lon1", "lat1", vx.alias("vx"), vy.alias("vy"), (vx * vx + vy * vy).alias("vv"), "planar", "before")
    leaves = measured.groupBy(*SHAPE, F.floor(F.col("seq") / NODE_FANOUT).alias("node")).agg(
        F.collect_list(segment).alias("segments"), F.first("planar_total").alias("planar_total"))

    def foot(s: Column) -> Column:
        along = ((lon - s["lon1"]) * s["vx"] + (lat - s["lat1"]) * s["vy"]) / s["vv"]

        def at(t: Column) -> Column:
            ex, ey = lon - (s["lon1"] + s["vx"] * t), lat - (s["lat1"] + s["vy"] * t)
            return F.struct((ex * ex + ey * ey).alias("d2"), s["seq"].alias("seq"),
                            ((s["before"] + t * s["planar"]) / F.col("planar_total")).alias("fraction"))
        return F.get(F.transform(F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))), at), F.lit(0))

    nearest = seeds.join(leaves, [*SHAPE, "node"]).select(*key, F.array_min(F.transform("segments", foot)).alias("_foot"))
    return nearest.groupBy(*key).agg(F.min_by("_foot.fraction", F.struct("_foot.d2", "_foot.seq")).alias("fraction"))


def _explode_range(df: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    """One row per whole number in [low, high]; in two steps, so that no row holds
    a long array."""
    blocked = df.withColumn("_block", F.explode(F.sequence(F.floor(low / CELL_BLOCK), F.floor(high / CELL_BLOCK))))
    start = F.col("_block") * CELL_BLOCK
    return blocked.withColumn(name, F.explode(F.sequence(
        F.greatest(low, start), F.least(high, start + CELL_BLOCK - 1)))).drop("_block")


def _grid(value: Column, n: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(value), n - 1))


def fraction_cells(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments indexed by an even grid over the fraction, one cell per segment on
    average, so that interpolation is an equi-join with a short range test. A cell
    crowded by many short segments is divided by their number, so cells stay
    proportional to segments. Returns (the cells, with ``sub`` 0 where not divided;
    the keys of divided cells, with ``parts``)."""
    n, end = F.col("n_segments"), F.coalesce("f1", F.lit(1.0))
    coarse = _explode_range(measured, "cell", _grid(F.col("f0") * n, n), _grid(end * n, n)).select(
        *SHAPE, "cell", "f0", "f1", "lon1", "lat1", "lon2", "lat2", "planar", "planar_total", "n_segments")
    crowded = coarse.groupBy(*SHAPE, "cell").count().where(F.col("count") > CROWDED).select(
        *SHAPE, "cell", F.col("count").alias("parts"))
    key = [*SHAPE, "cell"]
    plain = coarse.join(crowded, key, "left_anti").withColumn("sub", F.lit(0).cast("long"))
    low, high = (_grid((edge * n - F.col("cell")) * F.col("parts"), F.col("parts")) for edge in (F.col("f0"), end))
    divided = _explode_range(coarse.join(crowded, key), "sub", low, high).select(*plain.columns)
    return plain.unionByName(divided).drop("n_segments"), crowded


def interpolate_on_shapes(rows: DataFrame, measured: DataFrame) -> DataFrame:
    """Adds ``on_lon``, ``on_lat`` for rows with lineid, dir_label, fraction and
    n_segments; rows without a fraction keep NULL."""
    cells, crowded = fraction_cells(measured)
    c = cells.select([F.col(name).alias(f"_c_{name}") for name in cells.columns])
    d = crowded.select(F.col("lineid").alias("_d_lineid"), F.col("direction").alias("_d_direction"),
                       F.col("cell").alias("_d_cell"), F.col("parts").alias("_d_parts"))
    n = F.col("n_segments")
    fine = _grid((F.col("fraction") * n - F.col("_cell")) * F.col("_d_parts"), F.col("_d_parts"))
    wanted = (
        rows.withColumn("_cell", F.when(F.col("fraction").isNotNull(), _grid(F.col("fraction") * n, n)))
        .join(d, (F.col("lineid") == F.col("_d_lineid")) & (F.col("dir_label") == F.col("_d_direction"))
              & (F.col("_cell") == F.col("_d_cell")), "left")
        .withColumn("_sub", F.when(F.col("_d_cell").isNotNull(), fine).otherwise(F.lit(0).cast("long")))
    )
    hit = ((F.col("lineid") == F.col("_c_lineid")) & (F.col("dir_label") == F.col("_c_direction"))
           & (F.col("_cell") == F.col("_c_cell")) & (F.col("_sub") == F.col("_c_sub"))
           & (F.col("fraction") >= F.col("_c_f0"))
           & (F.col("_c_f1").isNull() | (F.col("fraction") < F.col("_c_f1"))))
    t = F.least(F.lit(1.0), (F.col("fraction") - F.col("_c_f0")) * F.col("_c_planar_total") / F.col("_c_planar"))
    return (
        wanted.join(c, hit, "left")
        .withColumns({"on_lon": lerp(F.col("_c_lon1"), F.col("_c_lon2"), t),
                      "on_lat": lerp(F.col("_c_lat1"), F.col("_c_lat2"), t)})
        .drop("_cell", "_sub", *d.columns, *c.columns)
    )


def shape_geojson(points: DataFrame, part_points: int | None = None, digits: int = 9) -> DataFrame:
    """One GeoJSON LineString per shape. With ``part_points`` a shape comes in parts of
    so many segments, numbered by ``part``; each ends on the vertex the next begins with."""
    if part_points is None:
        placed = points.withColumn("part", F.lit(0).cast("long"))
    else:
        bucketed = points.withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
        part = F.floor(F.col("_place") / part_points)
        on_border = (F.col("_place") % part_points == 0) & (part > 0)
        placed = running_number(bucketed, SHAPE, "_bucket", ["seq"], "_place").withColumn(
            "part", F.explode(F.when(on_border, F.array(part - 1, part)).otherwise(F.array(part))))
    vertex = F.struct("seq", F.round("lon", digits).alias("lon"), F.round("lat", digits).alias("lat"))
    return (
        placed.groupBy(*SHAPE, "part").agg(F.array_sort(F.collect_list(vertex)).alias("path"))
        .where(F.size("path") >= 2)
        .select(*SHAPE, "part", geojson_linestring(F.col("path")).alias("geometry"))
    )


def lookup_shapes(keys: DataFrame, shapes: DataFrame, points: DataFrame) -> DataFrame:
    """Attributes and geometry of the asked shapes; unknown ones come back with
    NULLs. ``keys``: lineid, direction."""
    wanted = points.join(keys.distinct(), SHAPE, "left_semi")
    found = shapes.select(*SHAPE, "mode", "route_color", "route_text_color",
                          F.concat_ws("_", *SHAPE).alias("shape_id"))
    return keys.join(found, SHAPE, "left").join(shape_geojson(wanted), SHAPE, "left")
