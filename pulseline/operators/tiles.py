"""Map-tile features for a range of zooms, pre-built as rows per tile.

A tile's features are rows with grid coordinates (4096 cells per edge, 64 cells
of clip margin), never one value per tile: at low zooms a single tile holds
everything. ``tile_lines`` gives a line's clipped segments, ``line_features`` stitches
them into one multi-part feature per shape and tile. Byte encoding is left to whatever
serves them.

``feature_rows`` lays features out for storage: a tile's quadkey has one digit per zoom
level, so tiles that lie together share a prefix. Rows go to partitions by layer, zoom and
prefix (``cell``) and are ordered by quadkey inside; a fetch of one tile prunes to one
partition, and there by the statistics of the files' row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.functions.geo import TILE_BUFFER, TILE_EXTENT, mercator_unit_x, mercator_unit_y
from pulseline.operators.catalogue import stops_serving_lines
from pulseline.operators.ordered import next_row
from pulseline.operators.shapes import SEQ_BUCKET
from pulseline.operators.simplify import simplify

# Half the Web-Mercator world width in metres (fixed value).
HALF_WORLD_M = 20_037_508.342789244
SIMPLIFY_AREA_M2 = 4.0
# Quadkey digits that name a storage partition.
CELL_DIGITS = 8
TILE = ["z", "x", "y"]
LINE_ATTRIBUTES = ["mode", "route_color", "route_text_color", "variant"]
FEATURES = ("layer string, z int, cell string, quadkey string, x long, y long, feature_id string, lineid string, direction string, "
            "mode string, route_color string, route_text_color string, variant int, stop_name_fr string, stop_name_nl string, "
            "parts array<array<struct<x:int,y:int>>>")


def _side(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def tile_stops(stops: DataFrame, zooms: list[int], line_stops: DataFrame | None = None,
               lines: list[str] | None = None) -> DataFrame:
    """One row per zoom and stop: the tile it lies in and its grid cell there. A
    stop exactly on a border lies in the tiles on both sides. With ``lines`` only
    stops these lines serve."""
    if lines is not None:
        stops = stops_serving_lines(stops, line_stops, lines)
    ux, uy = mercator_unit_x(F.col("lon")) * _side(F.col("z")), mercator_unit_y(F.col("lat")) * _side(F.col("z"))

    def tiles_at(unit: str) -> Column:
        low, high = F.greatest(F.ceil(unit) - 1, F.lit(0)), F.least(F.floor(unit), _side(F.col("z")).cast("long") - 1)
        return F.sequence(low, F.greatest(low, high))

    return (
        stops.where("lon is not null and lat is not null")
        .withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
        .withColumns({"_ux": ux, "_uy": uy})
        .withColumn("x", F.explode(tiles_at("_ux"))).withColumn("y", F.explode(tiles_at("_uy")))
        .select("z", "x", "y", "pointid", "stop_name_fr", "stop_name_nl",
                F.rint((F.col("_ux") - F.col("x")) * TILE_EXTENT).cast("int").alias("px"),
                F.rint((F.col("_uy") - F.col("y")) * TILE_EXTENT).cast("int").alias("py"))
    )


def simplify_shapes(points: DataFrame, min_area: float = SIMPLIFY_AREA_M2) -> DataFrame:
    """Vertices that survive simplification, in Web-Mercator unit coordinates."""
    metres = 2 * HALF_WORLD_M
    projected = points.select(
        "lineid", "direction", "seq", (mercator_unit_x(F.col("lon")) * metres).alias("x"),
        (mercator_unit_y(F.col("lat")) * metres).alias("y"))
    return simplify(projected, min_area).select(
        "lineid", "direction", F.col("idx").alias("seq"), (F.col("x") / metres).alias("ux"),
        (F.col("y") / metres).alias("uy"))


def tile_lines(points: DataFrame, shapes: DataFrame, zooms: list[int], lines: list[str] | None = None,
               min_area: float = SIMPLIFY_AREA_M2) -> DataFrame:
    """Line features as clipped segments per tile: simplify once per shape, snap
    to the zoom's cell grid, lay over the tiles met (with margin), clip.

    A shape belongs to a tile only if its box meets the tile without margin.
    """
    if lines is not None:
        points = points.where(F.col("lineid").isin(lines))
    shape = ["lineid", "direction"]
    boxes = points.groupBy(*shape).agg(
        F.min(mercator_unit_x(F.col("lon"))).alias("_west"), F.max(mercator_unit_x(F.col("lon"))).alias("_east"),
        F.min(mercator_unit_y(F.col("lat"))).alias("_north"), F.max(mercator_unit_y(F.col("lat"))).alias("_south"))
    # Written, as the next vertex is looked up in the same rows.
    vertices = materialise(simplify_shapes(points, min_area), "simplified").withColumn("_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    segments = next_row(vertices, shape, "_bucket", ["seq"], ["ux", "uy"], "end").where("end is not null")
    cells = _side(F.col("z")) * TILE_EXTENT

    def snapped(unit: str) -> Column:
        return F.rint(F.col(unit) * cells)

    snapped_segments = (
        segments.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
        .withColumns({"ax": snapped("ux"), "ay": snapped("uy"), "bx": snapped("end.ux"), "by": snapped("end.uy")})
        .where("ax <> bx or ay <> by")
    )

    def tiles_between(low: Column, high: Column) -> Column:
        return F.sequence(F.floor((low - TILE_BUFFER) / TILE_EXTENT), F.floor((high + TILE_BUFFER) / TILE_EXTENT))

    # Only the part of a segment inside a tile column can meet that column's tiles;
    # one cell of slack covers rounding.
    run = F.col("bx") - F.col("ax")
    edges = [((F.col("x") + side) * TILE_EXTENT + (2 * side - 1) * TILE_BUFFER - F.col("ax")) / run for side in (0, 1)]
    enter, leave = F.least(*edges), F.greatest(*edges)
    rise = F.col("by") - F.col("ay")
    y0 = F.when(run == 0, F.col("ay")).otherwise(F.col("ay") + rise * F.greatest(F.lit(0.0), F.least(F.lit(1.0), enter)))
    y1 = F.when(run == 0, F.col("by")).otherwise(F.col("ay") + rise * F.greatest(F.lit(0.0), F.least(F.lit(1.0), leave)))
    laid = (
        snapped_segments.withColumn("x", F.explode(tiles_between(F.least("ax", "bx"), F.greatest("ax", "bx"))))
        .withColumn("y", F.explode(tiles_between(F.least(y0, y1) - 1, F.greatest(y0, y1) + 1)))
        .join(boxes, shape)
        .where((F.col("_west") * _side(F.col("z")) <= F.col("x") + 1) & (F.col("_east") * _side(F.col("z")) >= F.col("x"))
               & (F.col("_north") * _side(F.col("z")) <= F.col("y") + 1)
               & (F.col("_south") * _side(F.col("z")) >= F.col("y")))
    )
    clipped = clip_segments(laid.withColumns({
        "ax": F.col("ax") - F.col("x") * TILE_EXTENT, "bx": F.col("bx") - F.col("x") * TILE_EXTENT,
        "ay": F.col("ay") - F.col("y") * TILE_EXTENT, "by": F.col("by") - F.col("y") * TILE_EXTENT,
    }), -TILE_BUFFER, TILE_EXTENT + TILE_BUFFER)
    attributes = shapes.select(*shape, F.coalesce("mode", F.lit("other")).alias("mode"), "route_color",
                               "route_text_color", "variant")
    return clipped.join(attributes, shape, "left").select(
        "z", "x", "y", *shape, "mode", "route_color", "route_text_color", "variant", "seq",
        *[F.col(c).cast("int").alias(name) for c, name in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1"))])


def clip_segments(segments: DataFrame, low: int, high: int) -> DataFrame:
    """Clips (ax, ay)-(bx, by) to the square [low, high]^2 and snaps the cut ends
    to whole cells; segments with nothing left are dropped."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def enter(a: str, d: Column) -> Column:
        edge = F.when(d > 0, F.lit(float(low))).otherwise(F.lit(float(high)))
        return F.when(d != 0, (edge - F.col(a)) / d).otherwise(F.lit(0.0))

    def leave(a: str, d: Column) -> Column:
        edge = F.when(d > 0, F.lit(float(high))).otherwise(F.lit(float(low)))
        return F.when(d != 0, (edge - F.col(a)) / d).otherwise(F.lit(1.0))

    def inside(a: str, d: Column) -> Column:
        return (d != 0) | F.col(a).between(low, high)

    t0 = F.greatest(F.lit(0.0), enter("ax", dx), enter("ay", dy))
    t1 = F.least(F.lit(1.0), leave("ax", dx), leave("ay", dy))
    cut = segments.where(inside("ax", dx) & inside("ay", dy)).withColumns({"_t0": t0, "_t1": t1}).where("_t0 < _t1")
    ends = {
        "_ax": F.rint(F.col("ax") + dx * F.col("_t0")), "_ay": F.rint(F.col("ay") + dy * F.col("_t0")),
        "_bx": F.rint(F.col("ax") + dx * F.col("_t1")), "_by": F.rint(F.col("ay") + dy * F.col("_t1")),
    }
    moved = cut.withColumns(ends).drop("ax", "ay", "bx", "by", "_t0", "_t1").withColumnsRenamed(
        {"_ax": "ax", "_ay": "ay", "_bx": "bx", "_by": "by"})
    return moved.where("ax <> bx or ay <> by")


def line_features(segments: DataFrame) -> DataFrame:
    """One row per shape and tile from the rows of ``tile_lines``: ``parts``, each an array of
    grid points. Segments that meet end to end are one part; where the line left the tile, or what was
    left of a segment vanished in one cell and the next one starts elsewhere, a new part starts.
    Parts are in the line's order. A feature holds what one shape has in one tile."""
    key = [*TILE, "lineid", "direction"]
    along = Window.partitionBy(*key).orderBy("seq")
    meets = (F.lag("x1").over(along) == F.col("x0")) & (F.lag("y1").over(along) == F.col("y0"))
    numbered = (segments.withColumn("_fresh", F.when(meets, 0).otherwise(1))
                .withColumn("_part", F.sum("_fresh").over(along)))
    parts = numbered.groupBy(*key, *LINE_ATTRIBUTES, "_part").agg(
        F.min_by(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), "seq").alias("_head"),
        F.array_sort(F.collect_list(F.struct("seq", "x1", "y1"))).alias("_ends"))
    points = F.concat(F.array("_head"), F.transform("_ends", lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y"))))
    listed = parts.select(*key, *LINE_ATTRIBUTES, F.struct("_part", points.alias("points")).alias("_p")).groupBy(*key, *LINE_ATTRIBUTES).agg(
        F.array_sort(F.collect_list("_p")).alias("_parts"))
    return listed.select(*key, *LINE_ATTRIBUTES, F.transform("_parts", lambda p: p["points"]).alias("parts"))


def quadkey(z: Column, x: Column, y: Column) -> Column:
    """One digit from 0 to 3 per zoom level, the coarsest first; empty at zoom 0."""
    def digit(level: Column) -> Column:
        def bit(c: Column) -> Column:
            return F.floor(c / F.pow(F.lit(2.0), z - level)).cast("long") % 2
        return (bit(x) + 2 * bit(y)).cast("string")
    return F.when(z == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(z, F.lit(1))), digit), ""))


def quadkey_of(z: int, x: int, y: int) -> str:
    return "".join(str((x >> k & 1) + 2 * (y >> k & 1)) for k in range(z - 1, -1, -1))


def cell_of(key: str) -> str:
    return f"q{key[:CELL_DIGITS]}"


def feature_rows(lines: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows of ``line_features`` and ``tile_stops`` as one table in the columns of ``FEATURES``."""
    point = F.array(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))))
    both = lines.select(
        F.lit("lines").alias("layer"), "*", F.concat_ws("_", "lineid", "direction").alias("feature_id")).unionByName(
        stops.select(F.lit("stops").alias("layer"), *TILE, F.col("pointid").alias("feature_id"), "stop_name_fr", "stop_name_nl",
                     point.alias("parts")), allowMissingColumns=True)
    key = quadkey(F.col("z"), F.col("x"), F.col("y"))
    placed = both.withColumn("quadkey", key).withColumn("cell", F.concat(F.lit("q"), F.substring("quadkey", 1, CELL_DIGITS)))
    kinds = [part.rsplit(" ", 1) for part in FEATURES.split(", ")]
    return placed.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds])


def in_tile(features: DataFrame, layer: str, z: int, x: int, y: int) -> DataFrame:
    """The features of one tile, by partition (layer, zoom, cell) and quadkey."""
    key = quadkey_of(z, x, y)
    return features.where((F.col("layer") == layer) & (F.col("z") == z) & (F.col("cell") == cell_of(key)) & (F.col("quadkey") == key))
