"""Catalogue look-ups: lines, destinations, stops and how they relate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Display order of transport modes; anything else ranks as other.
MODE_ORDER = ["metro", "tram", "bus", "rail", "funicular", "other"]


def line_metadata(shapes: DataFrame) -> DataFrame:
    """Mode and colours per line, the largest value of each over its shapes."""
    return shapes.groupBy("lineid").agg(
        F.max("mode").alias("mode"), F.max("route_color").alias("route_color"),
        F.max("route_text_color").alias("route_text_color"))


def line_destinations(line_stops: DataFrame) -> DataFrame:
    return (line_stops.where("destination is not null").groupBy("lineid")
            .agg(F.array_sort(F.collect_set("destination")).alias("destinations")))


def direction_labels(line_stops: DataFrame) -> DataFrame:
    """Direction label a stop has on a line: the one where it comes last."""
    latest = F.max_by("direction", F.struct("sequence_idx", "direction"))
    return line_stops.groupBy("lineid", "pointid").agg(latest.alias("dir_label"))


def terminus_locations(terminus: DataFrame, stops: DataFrame) -> DataFrame:
    return terminus.join(stops, F.col("terminus_pointid") == F.col("pointid")).select(
        "lineid", "direction", "terminus_pointid", "lon", "lat")


def stops_serving_lines(stops: DataFrame, line_stops: DataFrame, lines: list[str]) -> DataFrame:
    return stops.join(line_stops.where(F.col("lineid").isin(lines)), "pointid", "left_semi")


def numeric_first(lineid: Column) -> list[Column]:
    """Sort columns: numeric ids by number, then the others as text."""
    number = F.trim(lineid).try_cast("long")
    return [number.isNull(), number.asc_nulls_last(), lineid]


def line_order(mode: Column, lineid: Column) -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(m) for m in MODE_ORDER]), F.coalesce(mode, F.lit("other")))
    return [F.when(rank == 0, len(MODE_ORDER)).otherwise(rank), *numeric_first(lineid)]


def recent_cutoff(trips: DataFrame, days: int = 7) -> DataFrame:
    """One row ``cutoff``: the later of (last end - days) and the first start."""
    return trips.agg(F.greatest(F.max("end_ts") - F.make_dt_interval(days=F.lit(days)),
                                F.min("start_ts")).alias("cutoff"))


def trips_per_terminus(trips: DataFrame, terminus: DataFrame, stops: DataFrame, days: int = 7) -> DataFrame:
    """Recent trips per line, direction and destination. Counted per direction
    first, so that only one small row per direction meets the catalogue."""
    counts = (
        trips.where(F.col("direction").isNotNull() & (F.col("start_ts") > recent_cutoff(trips, days).scalar()))
        .groupBy("lineid", "direction").agg(F.count(F.lit(1)).alias("trips"))
        .withColumn("_stop", F.col("direction").cast("string"))
    )
    named = terminus.select("lineid", F.col("terminus_pointid").alias("_stop"), "destination")
    places = stops.select(F.col("pointid").alias("_stop"), "stop_name_fr")
    return (
        counts.join(named, ["lineid", "_stop"], "left").join(places, "_stop", "left")
        .select("lineid", "direction", F.coalesce("destination", "stop_name_fr").alias("destination"), "trips")
    )


def direction_ranking(per_terminus: DataFrame) -> DataFrame:
    """One row per line and destination with its busiest direction, ranked by
    trips. Directions without a destination stay apart from each other."""
    key = F.coalesce("destination", F.concat(F.lit("dir_"), F.col("direction").cast("string")))
    busiest = F.max_by("direction", F.struct(F.col("trips"), -F.col("direction")))
    merged = (
        per_terminus.groupBy("lineid", key.alias("_key"), "destination")
        .agg(F.sum("trips").alias("trips"), busiest.alias("direction")).drop("_key")
    )
    rank = Window.partitionBy("lineid").orderBy(
        F.desc("trips"), F.asc_nulls_last("destination"), F.asc("direction"))
    return merged.withColumn("rn", F.row_number().over(rank).cast("long"))


def line_catalogue(shapes: DataFrame, line_stops: DataFrame, terminus: DataFrame, stops: DataFrame,
                   trips: DataFrame, days: int = 7, top: int = 4) -> DataFrame:
    """Every line with attributes, destinations and its busiest directions."""
    ranked = direction_ranking(trips_per_terminus(trips, terminus, stops, days)).where(F.col("rn") <= top)
    detail = F.array_sort(F.collect_list(F.struct("rn", "direction", "destination", "trips")))
    busiest = ranked.groupBy("lineid").agg(
        F.transform(detail, lambda d: d.dropFields("rn")).alias("directions_detail"))
    lines = line_metadata(shapes).withColumn("mode", F.coalesce("mode", F.lit("other")))
    return (
        lines.join(line_destinations(line_stops), "lineid", "left").join(busiest, "lineid", "left")
        .withColumns({
            "destinations": F.coalesce("destinations", F.array().cast("array<string>")),
            "directions_detail": F.coalesce(
                "directions_detail",
                F.array().cast("array<struct<direction:int,destination:string,trips:bigint>>")),
        })
        .orderBy(*line_order(F.col("mode"), F.col("lineid")))
    )


def stop_lines(line_stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row per stop and line through it, with the line's attributes."""
    def distinct_values(name: str) -> Column:
        values = F.array_sort(F.collect_set(name))
        return F.when(F.size(values) > 0, values).alias(name + "s")
    through = line_stops.groupBy("pointid", "lineid").agg(
        distinct_values("destination"), distinct_values("direction"))
    return through.join(line_metadata(shapes), "lineid", "left")


def stop_details(stops: DataFrame, line_stops: DataFrame, shapes: DataFrame,
                 pointids: list[str] | None = None) -> DataFrame:
    """Stops with the lines through them; an empty array where there are none.
    ``pointids`` narrows it to some stops; an unknown stop gives no row."""
    if pointids is not None:
        stops = stops.where(F.col("pointid").isin(pointids))
        line_stops = line_stops.where(F.col("pointid").isin(pointids))
    number = F.trim("lineid").try_cast("long")
    entry = F.struct(
        number.isNull().alias("_text"), F.coalesce(number, F.lit(0)).alias("_number"), "lineid", "mode",
        F.col("route_color").alias("color"), F.col("route_text_color").alias("text_color"),
        "destinations", "directions")
    lines = stop_lines(line_stops, shapes).groupBy("pointid").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    plain = F.transform("lines", lambda e: e.dropFields("_text", "_number"))
    empty = F.array().cast("array<struct<lineid:string,mode:string,color:string,text_color:string,"
                           "destinations:array<string>,directions:array<string>>>")
    return stops.join(lines, "pointid", "left").withColumn("lines", F.coalesce(plain, empty))
