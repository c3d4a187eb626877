"""From coordinate-free pings to positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.durable import materialise
from pulseline.functions import ids, text
from pulseline.functions.geo import clamp
from pulseline.operators import shapes as sh
from pulseline.operators.ordered import earliest_per_key

KEY = ["lineid", "direction", "pointid"]
REQUIRED = [*KEY, "fetched_at_text"]


def _fields_of(record: Column) -> Column:
    snake = "distance_from_point"
    raw_distance = F.when(F.map_contains_key(record, snake), record[snake]).otherwise(record["distanceFromPoint"])
    return F.struct(
        text.first_filled(record["position_id"]).alias("_given"),
        text.first_filled(record["lineid"], record["lineId"]).alias("lineid"),
        text.first_filled(record["direction"], record["directionId"]).alias("direction"),
        text.first_filled(record["pointid"], record["pointId"]).alias("pointid"),
        text.to_double(raw_distance).alias("distance_from_point"),
        text.first_filled(record["fetched_at"], record["poll_ts"], record["fetched_at_utc"]).alias("fetched_at_text"),
    )


def _coerced(records: DataFrame, record: str, *more: Column) -> DataFrame:
    # The many look-ups sit in one array function: as plain columns they would be
    # repeated in every later filter, in methods too long for the JVM to compile.
    return records.select(*more, F.inline(F.transform(F.array(record), _fields_of)))


def coerce_pings(records: DataFrame, record: str = "record") -> DataFrame:
    """Raw ping records (map<string,string> column) to typed, identified pings.

    A record without line, direction, stop or time is dropped. The distance is
    taken from the snake_case key whenever that key exists, even when it is null.
    ``id_given`` tells ids that came with the record from those derived here.
    """
    typed = _coerced(records, record).dropna(subset=REQUIRED)
    return typed.select(_ping_id().alias("position_id"), *KEY, "distance_from_point",
                        "fetched_at_text", F.col("_given").isNotNull().alias("id_given"))


def ping_outcomes(records: DataFrame, record: str = "record") -> DataFrame:
    """How many records are kept, and how many go for which reason."""
    reason = F.coalesce(_reason(), F.lit("kept"))
    return _coerced(records, record).groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("pings"))


# What ``_reason`` may say.
REASONS = [*[f"no {c}" for c in REQUIRED], "direction", "fetched_at"]


def rated_pings(records: DataFrame, record: str = "record") -> DataFrame:
    """Every record as a typed ping, with the ``reason`` why it cannot be used (NULL for those that can) and, of such
    records, ``file`` and text. The usable ones equal ``typed_pings`` of ``coerce_pings``."""
    file = F.col("file") if "file" in records.columns else F.lit(None).cast("string")
    rated = _coerced(records, record, file.alias("file"), F.to_json(record).alias("raw")).withColumn("reason", _reason())
    return rated.select(
        _ping_id().alias("position_id"), "lineid", text.to_int(F.col("direction")).alias("direction"), "pointid", "distance_from_point",
        text.to_instant(F.col("fetched_at_text")).alias("fetched_at"), F.col("_given").isNotNull().alias("id_given"), "reason",
        *[F.when(F.col("reason").isNotNull(), F.col(c)).alias(c) for c in ("file", "raw")], F.col("reason").isNotNull().alias("rejected"))


def _ping_id() -> Column:
    return F.coalesce("_given", ids.ping_id(*[F.col(c) for c in (*KEY, "fetched_at_text", "distance_from_point")]))


def _reason() -> Column:
    return F.coalesce(*[F.when(F.col(c).isNull(), f"no {c}") for c in REQUIRED], _unparsed())


def _unparsed() -> Column:
    return (F.when(text.to_int(F.col("direction")).isNull(), "direction")
            .when(text.to_instant(F.col("fetched_at_text")).isNull(), "fetched_at"))


def typed_pings(pings: DataFrame) -> DataFrame:
    """Numeric direction and a real instant; see ``rejected_pings`` for the rest."""
    return (
        pings.withColumns({"direction": text.to_int(F.col("direction")),
                           "fetched_at": text.to_instant(F.col("fetched_at_text"))})
        .where("direction is not null and fetched_at is not null")
        .drop("fetched_at_text")
    )


def rejected_pings(pings: DataFrame) -> DataFrame:
    """Pings whose direction or time does not parse, with the reason."""
    return pings.withColumn("reason", _unparsed()).where("reason is not null")


def unique_pings(pings: DataFrame) -> DataFrame:
    """First wins by id; copies of one sighting collapse before any shuffle."""
    rest = [c for c in pings.columns if c != "position_id"]
    return earliest_per_key(pings, ["position_id"], rest)


@dataclass(frozen=True)
class ShapeIndex:
    """Tables of catalogue size that pings are located with; written once per
    catalogue and good for any number of batches."""

    measured: DataFrame
    lengths: DataFrame
    levels: int

    @classmethod
    def build(cls, points: DataFrame) -> "ShapeIndex":
        segments = materialise(sh.shape_segments(points), "segments")
        measured = materialise(sh.measured_segments(segments), "measured-segments")
        return cls(measured, sh.shape_lengths(segments), sh.node_levels(measured))


def stop_fractions(places: DataFrame, points: DataFrame, stops: DataFrame) -> DataFrame:
    """Fraction of each (lineid, direction label, pointid) along its shape."""
    located = places.join(stops.select("pointid", "lon", "lat"), "pointid")
    index = ShapeIndex.build(points)
    return sh.locate_on_shapes(located, index.measured, index.levels)


def resolve_positions(pings: DataFrame, stops: DataFrame, terminus: DataFrame, index: ShapeIndex) -> DataFrame:
    """Coordinates for typed pings: walk the line shape from the ping's stop.

    Shape, stop fraction and length are found once per distinct (line,
    direction, stop), so the ping table itself takes two equi-joins. A ping
    falls back to its stop when there is no usable shape; it stays with NULL
    coordinates when only the shape is known, and goes when neither is. ``pings``
    is read twice, so it should be a table rather than a long computation.
    """
    labels = terminus.select("lineid", F.col("terminus_pointid").alias("_terminus"),
                             F.col("direction").alias("dir_label"))
    lengths = index.lengths.withColumnRenamed("direction", "dir_label")
    places = stops.select("pointid", F.col("lon").alias("stop_lon"), F.col("lat").alias("stop_lat"))
    known = (
        pings.select(*KEY).distinct()
        .withColumn("_terminus", F.col("direction").cast("string"))
        .join(labels, ["lineid", "_terminus"], "left")
        .join(lengths, ["lineid", "dir_label"], "left")
        .join(places, "pointid", "left")
        .where("stop_lon is not null or length_m is not null")
        .drop("_terminus")
    )
    usable = known.where("stop_lon is not null and planar_total > 0 and length_m > 0")
    located = sh.locate_on_shapes(
        usable.select("lineid", F.col("dir_label").alias("direction"), "pointid",
                      F.col("stop_lon").alias("lon"), F.col("stop_lat").alias("lat")).distinct(),
        index.measured, index.levels,
    ).withColumnsRenamed({"direction": "dir_label", "fraction": "stop_fraction"})
    anchors = known.join(located, ["lineid", "dir_label", "pointid"], "left")
    ahead = F.coalesce("distance_from_point", F.lit(0.0)) / F.col("length_m")
    moved = pings.join(anchors, KEY).withColumn(
        "fraction", F.when(F.col("stop_fraction").isNotNull(), clamp(F.col("stop_fraction") + ahead, 0.0, 1.0)))
    placed = sh.interpolate_on_shapes(moved, index.measured)
    on_shape = F.col("fraction").isNotNull()
    return placed.select(
        *pings.columns, F.lit(None).cast("string").alias("vehicle_uuid"),
        F.when(on_shape, F.col("on_lon")).otherwise(F.col("stop_lon")).alias("lon"),
        F.when(on_shape, F.col("on_lat")).otherwise(F.col("stop_lat")).alias("lat"),
    )


def line_direction_counts(positions: DataFrame, lines: list[str] | None = None) -> DataFrame:
    """Work list: distinct (line, direction) with ping counts."""
    chosen = positions.where("lineid is not null and direction is not null")
    if lines:
        chosen = chosen.where(F.col("lineid").isin(lines))
    return chosen.groupBy("lineid", "direction").agg(F.count(F.lit(1)).alias("pings"))
