"""Registered queries: each runs one operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseline.adapters import EPOCH_2024_US, ORDER_SPACING_US, Adapter, feed_of, instant
from pulseline.durable import materialise, scratch
from pulseline.functions import geo, ids
from pulseline.operators import catalogue as cat
from pulseline.operators import linking, merge, network, positions, shapes, spacetime, temporal, tiles, trips
from pulseline.plans import pipelines
from pulseline.plans import queries as plans
from pulseline.plans.filters import TimeFilter, filter_trips, latest_end
from pulseline.session import pin_utc
from pulseline.sinks.tables import Tables, write_mirror
from pulseline.sources import catalogue as documents
from pulseline.sources import pings as feeds
from pulseline.sources.gtfs import route_attributes
from pulseline.streaming import polls
from pulseline.streaming.linker import PING, TripLinker

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}
_ON_VIEWS: dict[str, Callable[[Adapter], DataFrame]] = {}


# Most rows in a dump file of the replay.
DUMP_ROWS = 200_000


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def on_views() -> dict[str, Callable[[Adapter], DataFrame]]:
    """The same queries on views someone else prepared."""
    return dict(_ON_VIEWS)


def _query(*stored: str):
    """Registers a query; ``stored`` names the views it wants as written tables."""
    def register(build: Callable[[Adapter], DataFrame]) -> Callable[[Adapter], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Adapter(pin_utc(spark), folder, stored))
        name = build.__name__.rstrip("_")
        _REGISTERED[name], _ON_VIEWS[name] = run, build
        return build
    return register


def _round(*names: str) -> list[Column]:
    """Six decimals, by the same arithmetic as the twins' round()."""
    return [(F.round(F.col(n) * 1e6) / 1e6).alias(n) for n in names]


def _us(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def _hours_before_end(df: DataFrame, hours: float) -> Column:
    return latest_end(df) - F.lit(timedelta(hours=hours))


# -- pings ------------------------------------------------------------------

def _feed_pings(a: Adapter, feed: DataFrame | None = None) -> DataFrame:
    names = ["lineid", "directionId", "pointId", "distanceFromPoint", "poll_ts"]
    record = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("record")
    return positions.coerce_pings((feed or a.feed).select(record))


def _positions(a: Adapter) -> DataFrame:
    pings = materialise(positions.typed_pings(positions.unique_pings(_feed_pings(a))), "pings")
    return positions.resolve_positions(pings, a.patchy_stops, a.line_terminus, positions.ShapeIndex.build(a.patchy_shape_points))


@_query()
def ping_coercion(a: Adapter) -> DataFrame:
    """The feed through JSON text, with all key spellings: stops at distance 0
    carry an explicit null under the snake_case key, which hides the other."""
    at_stop, older = F.col("distanceFromPoint") == "0.0", F.col("distanceFromPoint") > "5"
    text = F.to_json(F.struct(
        F.when(older, F.col("lineid")).alias("lineid"), F.when(~older, F.col("lineid")).alias("lineId"),
        F.when(older, F.col("directionId")).alias("direction"),
        F.when(~older, F.col("directionId")).alias("directionId"),
        F.when(older, F.col("pointId")).alias("pointid"), F.when(~older, F.col("pointId")).alias("pointId"),
        F.col("distanceFromPoint").cast("double").alias("distanceFromPoint"), F.lit("").alias("fetched_at"), "poll_ts"))
    marked = F.when(at_stop, F.regexp_replace(text, r"^\{", '{"distance_from_point":null,')).otherwise(text)
    records = a.feed.select(F.from_json(marked, "map<string,string>").alias("record"))
    return positions.coerce_pings(records).drop("id_given")


@_query("line_stops")
def ping_outcomes(a: Adapter) -> DataFrame:
    """Why records are dropped: the feed, where the last stop's number stands for
    the direction on one line's pings and is missing on another's."""
    direction = F.when(F.col("lineid") == "1", F.concat(F.lit("to "), "directionId")).when(
        F.col("lineid") != "2", F.col("directionId"))
    names = ["lineid", "direction", "pointid", "poll_ts"]
    values = F.array("lineid", direction, "pointId", F.when(F.col("lineid") != "3", F.col("poll_ts")).otherwise("soon"))
    return positions.ping_outcomes(a.feed.select(
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values).alias("record")))


@_query()
def ping_id(a: Adapter) -> DataFrame:
    distance = F.col("distanceFromPoint").cast("double")
    return a.feed.select("lineid", "directionId", "pointId", "poll_ts", ids.ping_id(
        F.col("lineid"), F.col("directionId"), F.col("pointId"), F.col("poll_ts"), distance).alias("position_id"))


@_query()
def ping_dedup(a: Adapter) -> DataFrame:
    return positions.unique_pings(_feed_pings(a)).select("position_id", "lineid", "pointid")


@_query()
def line_direction_counts(a: Adapter) -> DataFrame:
    return positions.line_direction_counts(a.feed.select("lineid", F.col("directionId").cast("int").alias("direction")))


@_query("line_stops")
def ping_geometry(a: Adapter) -> DataFrame:
    return _positions(a).select("position_id", "lineid", "direction", "pointid", _us("fetched_at"), *_round("lon", "lat"))


def _linked_trips(a: Adapter, chunk_rows: int) -> DataFrame:
    located = materialise(_positions(a), "positions")
    return _headers(linking.trip_samples(linking.link_pings(located, chunk_rows)))


def _headers(samples: DataFrame) -> DataFrame:
    return linking.build_trips(samples)[0].select("trip_id", "vehicle_uuid", "lineid", "direction", _us("start_ts"), _us("end_ts"), "point_count")


@_query("line_stops")
def trip_linking(a: Adapter) -> DataFrame:
    return _linked_trips(a, linking.CHUNK_ROWS)


@_query("line_stops")
def trip_linking_in_chunks(a: Adapter) -> DataFrame:
    """The same trips with chunks so small that busy stretches are cut."""
    return _linked_trips(a, 40)


def _online(a: Adapter) -> tuple[TripLinker, DataFrame, str, datetime]:
    """A linker after a stream of located pings in three micro-batches: each third of the time lands as a few
    files, which one trigger takes. Also the stream, its folder and the newest ping's time."""
    files = 4
    located = materialise(_positions(a), "positions").select(*[c.split()[0] for c in PING.split(", ")])
    landed = scratch(a.spark, "landed")
    span = located.agg(F.unix_micros(F.min("fetched_at")).alias("a"), F.unix_micros(F.max("fetched_at")).alias("b")).first()
    share = F.floor((F.unix_micros("fetched_at") - F.lit(span["a"])) * 3 / (F.lit(span["b"]) - F.lit(span["a"]) + 1))
    for number in range(3):
        located.where(share == number).repartition(files).write.mode("append").parquet(landed)
    stream = a.spark.readStream.schema(located.schema).option("maxFilesPerTrigger", files).parquet(landed)
    linker = TripLinker(a.spark, scratch(a.spark, "linker"), lateness_s=120)
    linker.start(stream).awaitTermination()
    return linker, stream, landed, datetime.fromtimestamp(span["b"] / 1e6, timezone.utc)


@_query("line_stops")
def trip_linking_online(a: Adapter) -> DataFrame:
    """The same trips from a stream that carries open trips across micro-batches. It is stopped, and goes on
    from its checkpoint when a row without coordinates moves the time on."""
    linker, stream, landed, newest = _online(a)
    linker.heartbeat(newest + timedelta(hours=1)).write.mode("append").parquet(landed)
    linker.start(stream).awaitTermination()
    return _headers(linker.samples())


@_query("line_stops")
def positions_at_live(a: Adapter) -> DataFrame:
    """Where vehicles are a minute before the watermark: closed trips, and those under way from the state store."""
    linker, _, _, newest = _online(a)
    watermark = newest - timedelta(seconds=120)
    running, closed = (materialise(t, "live") for t in linker.trips(watermark))
    both = trips.union_trips(running, closed)
    found = plans.positions_at(both, linker.samples(), a.line_shapes, watermark - timedelta(seconds=60))
    return found.join(running.select("trip_id", F.lit(True).alias("running")), "trip_id", "left").select(
        "trip_id", "lineid", "direction", *_round("lon", "lat"), F.coalesce("running", F.lit(False)).alias("running"))


@_query("line_stops", "stops", "line_terminus", "shape_points")
def position_stream(a: Adapter) -> DataFrame:
    """Events as a stream: feed, coercion, dedup, positions, insert-ignore. Each
    event passes twice, and each position is stored once."""
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    for name in ("stops", "line_terminus", "shape_points"):
        tables.replace(name, getattr(a, name))
    events = (a.spark.readStream.schema(a.table("events").schema).option("pathGlobFilter", "events.parquet")
              .parquet(a.folder))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    pings = _feed_pings(a, feed_of(a, twice))
    query = polls.start_position_stream(pings, tables, scratch(a.spark, "checkpoint"))
    query.awaitTermination()
    return tables.read("positions").select(
        "position_id", "lineid", "direction", "pointid", _us("fetched_at"), *_round("lon", "lat"))


@_query("line_stops", "feed")
def replay_counts(a: Adapter) -> DataFrame:
    """Catalogue, pings and estimates written as dumps, replayed twice, linked."""
    root = scratch(a.spark, "dumps")

    def dump(rows: DataFrame, name: str) -> None:
        rows.write.option("compression", "gzip").json(f"{root}/{name}.jsonl")

    for name in ("stops", "line_stops", "line_terminus"):
        getattr(a, name).write.format("json").option("compression", "gzip").save(f"{root}/raw/{name}")
    # A gzip file is read by one task.
    files = max(a.spark.sparkContext.defaultParallelism, -(-a.feed.count() // DUMP_ROWS))
    dump(a.feed.repartition(files), "positions/feed")
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    place = [F.lit("f").alias("file"), F.lit(0).alias("row_no")]
    for _ in range(2):
        for name, scan in (("stops", documents.scan_stops), ("line_stops", documents.scan_line_stops),
                           ("line_terminus", documents.scan_line_terminus)):
            tables.upsert(name, scan(a.spark, f"{root}/raw/{name}"))
        pipelines.store_shapes(tables, a.line_shapes.select("*", *place), a.shape_points, replace=False)
        pipelines.load_pings(tables, feeds.scan_ping_records(a.spark, [root]))
        tables.append_waiting_times(a.waiting_times, once=True)
    return pipelines.rebuild_trips(tables)


def _dump(rows: DataFrame, root: str, name: str) -> None:
    """Gzip files of one kind, one per task, each of that name in a numbered folder of its own."""
    kind, parts = ("csv" if name.endswith(".csv.gz") else "json"), f"{root}-parts/{name}"
    rows.write.option("compression", "gzip").option("header", kind == "csv").format(kind).save(parts)
    hadoop = rows.sparkSession._jvm.org.apache.hadoop.fs
    files = hadoop.Path(parts).getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    folder, _, file = f"{root}/{name}".rpartition("/")
    for n, part in enumerate(files.globStatus(hadoop.Path(f"{parts}/part-*"))):
        target = hadoop.Path(f"{folder}/{n}/{file}")
        files.mkdirs(target.getParent())
        if not files.rename(part.getPath(), target):
            raise OSError(f"{part.getPath()} was not renamed to {target}")


@_query("line_stops", "feed")
def replay_contents(a: Adapter) -> DataFrame:
    """Dump files of every kind, named as the feeds name them, loaded by the replay
    job; what the tables hold afterwards."""
    root = scratch(a.spark, "all-dumps")

    def dump(rows: DataFrame, name: str) -> None:
        _dump(rows, root, name)

    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))),
                                    lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    drawn = a.shape_points.groupBy("lineid", "direction").agg(F.concat(F.lit("LINESTRING("), path, F.lit(")")).alias("geom_wkt"))
    dump(a.stops, "static/stops.jsonl.gz")
    dump(a.line_stops.select("lineid", "direction", "sequence_idx", "pointid", "destination"), "static/line_stops.jsonl.gz")
    dump(a.line_terminus, "static/line_terminus.jsonl.gz")
    dump(a.line_shapes.join(drawn, ["lineid", "direction"]), "static/line_shapes.jsonl.gz")
    dump(a.feed, "positions/feed.jsonl.gz")
    dump(a.waiting_times.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in ("poll_ts", "expected")}),
         "waiting_times/polls.jsonl.gz")
    assigned = a.stops.select(
        F.concat(F.lit("given-"), "pointid").alias("position_id"), F.lit("2024-01-01T00:00:00+00:00").alias("fetched_at_utc"),
        F.lit("1").alias("lineId"), F.lit("1").alias("direction"), F.col("pointid").alias("pointId"), F.lit("5").alias("distance"),
        F.lit("50.5").alias("latitude"), F.lit("4.5").alias("longitude"))
    dump(assigned, "assignments_2024.csv.gz")
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    pipelines.replay(a.spark, tables, [root])

    def micro(name: str) -> Column:
        return F.round(F.col(name) * 1e6).cast("long").cast("string")

    def shown(name: str, *columns: str | Column) -> DataFrame:
        texts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("-")) for c in columns]
        return tables.read(name).select(F.lit(name).alias("table_name"), F.concat_ws("|", *texts).alias("content"))

    parts = [
        shown("stops", "pointid", "stop_name_fr", "stop_name_nl", micro("lon"), micro("lat")),
        shown("line_stops", "lineid", "direction", F.col("sequence_idx").cast("string"), "pointid", "destination"),
        shown("line_terminus", "lineid", "terminus_pointid", "direction", "destination"),
        shown("line_shapes", "lineid", "direction", F.col("variant").cast("string"), "mode", "route_color"),
        shown("shape_points", "lineid", "direction", F.col("seq").cast("string"), micro("lon"), micro("lat")),
        shown("positions", "position_id", "lineid", "pointid", F.unix_micros("fetched_at").cast("string"), micro("lon"), micro("lat")),
        shown("waiting_times", F.unix_micros("poll_ts").cast("string"), "pointid", "lineid", F.unix_micros("expected").cast("string"), "destination", "message"),
    ]
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other)
    return every


@_query("line_stops", "feed")
def load_report(a: Adapter) -> DataFrame:
    """What a replay says became of its records: the feed, where one line's pings have no usable
    direction, another's none, a third's no time, and some stops no coordinates; then the whole again."""
    root = scratch(a.spark, "reported")
    _dump(a.patchy_stops, root, "static/stops.jsonl.gz")
    _dump(a.line_terminus, root, "static/line_terminus.jsonl.gz")
    direction = F.when(F.col("lineid") == "1", F.concat(F.lit("to "), "directionId")).when(F.col("lineid") != "2", F.col("directionId"))
    _dump(a.feed.select("lineid", direction.alias("direction"), F.col("pointId").alias("pointid"), F.col("distanceFromPoint").alias("distance_from_point"),
                        F.when(F.col("lineid") != "3", F.col("poll_ts")).otherwise("soon").alias("poll_ts")), root, "positions/feed.jsonl.gz")
    _dump(a.waiting_times.select(F.date_format("poll_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("poll_ts"), "pointid", "lineid"), root, "waiting_times/polls.jsonl.gz")
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    pipelines.replay(a.spark, tables, [root])
    pipelines.replay(a.spark, tables, [root])
    run = F.dense_rank().over(Window.orderBy("load")).alias("run")  # a few rows per run
    dead = tables.read("rejected_pings").groupBy(F.col("load"), F.lit("dead_letters").alias("step"), F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return tables.read("load_report").where("n > 0").unionByName(dead).select(run, "step", "outcome", "n")


@_query("line_stops", "feed")
def mirror_round_trip(a: Adapter) -> DataFrame:
    """Pings mirrored as dumps and read again: the same ids."""
    folder = write_mirror(feeds.mirror_records(positions.coerce_pings(a.feed.select(
        F.create_map(*[x for c in a.feed.columns for x in (F.lit(c), F.col(c))]).alias("record")))),
        scratch(a.spark, "mirror"), datetime(2024, 1, 1))
    return feeds.scan_pings(a.spark, folder).drop("id_given")


@_query()
def waiting_times_appended(a: Adapter) -> DataFrame:
    """A plain append has no key: loaded twice, every estimate is there twice."""
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    for _ in range(2):
        tables.append_waiting_times(a.waiting_times)
    found = tables.read("waiting_times")
    return found.groupBy("pointid", "lineid").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("poll_ts")).alias("latest"))


@_query("line_stops", "feed")
def live_payload(a: Adapter) -> DataFrame:
    """Poll payloads with the vehicles of a line as JSON text, taken apart again."""
    vehicle = F.struct("directionId", "pointId", F.col("distanceFromPoint").cast("double").alias("distanceFromPoint"))
    nested = a.feed.groupBy("poll_ts", "lineid").agg(F.to_json(F.collect_list(vehicle)).alias("vehiclepositions"))
    payload = nested.select("poll_ts", F.to_json(F.struct("lineid", "vehiclepositions")).alias("item"))
    return positions.coerce_pings(feeds.flatten_payload(payload, F.col("poll_ts"))).drop("id_given")


@_query("line_stops", "feed")
def observed_stops(a: Adapter) -> DataFrame:
    """Last coordinate per stop, from pings that come with one."""
    seen = a.feed.select(
        F.col("pointId").alias("pointid"), F.col("poll_ts").cast("timestamp").alias("fetched_at"),
        F.concat_ws("|", "lineid", "directionId", "distanceFromPoint").alias("position_id"),
        F.col("distanceFromPoint").cast("double").alias("lon"), F.length("lineid").cast("double").alias("lat"))
    return feeds.observed_stops(seen)


# -- merging ----------------------------------------------------------------

def _changed_stops(a: Adapter) -> DataFrame:
    """Suppliers as news about stops, known and new ones, in two versions."""
    key = F.col("s_suppkey") * 29
    rows = a.table("supplier").withColumn("row_no", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select(
        key.cast("string").alias("pointid"), F.concat_ws(" v", "s_name", F.col("row_no").cast("string")).alias("stop_name_fr"),
        F.lit(None).cast("string").alias("stop_name_nl"), F.col("s_nationkey").cast("double").alias("lon"),
        F.col("row_no").cast("double").alias("lat"), "row_no")


@_query("line_stops")
def insert_ignore(a: Adapter) -> DataFrame:
    return merge.new_rows(a.stops, _changed_stops(a), ["pointid"], ["row_no"]).drop("row_no")


@_query("line_stops")
def upsert_last_wins(a: Adapter) -> DataFrame:
    merged = merge.upserted(a.stops, _changed_stops(a), ["pointid"], ["row_no"])
    return merged.select("pointid", "stop_name_fr", "stop_name_nl", *_round("lon", "lat"))


@_query("line_stops")
def upsert_coordinates(a: Adapter) -> DataFrame:
    merged = merge.upserted(a.stops, _changed_stops(a), ["pointid"], ["row_no"], ["lon", "lat"])
    return merged.select("pointid", "stop_name_fr", "stop_name_nl", *_round("lon", "lat"))


# -- documents --------------------------------------------------------------

@_query()
def stop_documents(a: Adapter) -> DataFrame:
    """Customers as stop documents in all spellings, decoded."""
    key = F.col("c_custkey")
    gps = F.to_json(F.struct((key % 90).alias("latitude"), (key % 180).cast("string").alias("longitude")))
    name = F.to_json(F.struct(F.col("c_name").alias("fr"), F.col("c_mktsegment").alias("nl")))
    quoted = F.to_json(F.struct(key.alias("id"), gps.alias("gpscoordinates"), name.alias("name")))
    nested = F.to_json(F.struct(
        key.cast("string").alias("pointId"), F.col("c_name").alias("name"),
        F.struct((key % 90).alias("lat"), F.when(key % 9 != 0, key % 180).alias("lng")).alias("gpsCoordinates")))
    items = a.table("customer").select(F.when(key % 2 == 0, quoted).otherwise(nested).alias("item"))
    return documents.decode_stop_documents(items)


@_query("line_stops")
def line_documents(a: Adapter) -> DataFrame:
    """Stops-by-line documents of a hundred stops each, points without order in
    every second one, decoded."""
    block = F.floor((F.col("sequence_idx") - 1) / 100)
    point = F.struct("sequence_idx", F.col("pointid").alias("id"))
    lists = a.line_stops.groupBy("lineid", "direction", "destination", block.alias("block")).agg(
        F.array_sort(F.collect_list(point)).alias("points"))
    ordered = F.to_json(F.transform("points", lambda p: F.struct(
        p["id"].alias("id"), p["sequence_idx"].cast("string").alias("order"))))
    plain = F.to_json(F.transform("points", lambda p: F.struct(p["id"].cast("int").alias("pointId"))))
    text = F.when(F.col("block") % 2 == 0, ordered).otherwise(plain)
    items = lists.select(F.to_json(F.struct(
        "lineid", F.concat_ws("-", "direction", F.col("block").cast("string")).alias("direction"),
        F.to_json(F.struct(F.lit("").alias("fr"), F.col("destination").alias("nl"))).alias("destination"),
        text.alias("points"))).alias("item"))
    return documents.decode_line_documents(items)


@_query("line_stops")
def document_termini(a: Adapter) -> DataFrame:
    return documents.terminus_of(a.line_stops.select("lineid", "direction", "sequence_idx", "pointid", "destination"))


# -- shapes -----------------------------------------------------------------

@_query()
def shape_length(a: Adapter) -> DataFrame:
    lengths = shapes.shape_lengths(shapes.shape_segments(a.shape_points))
    return lengths.select("lineid", "direction", F.round("length_m", 3).alias("length_m"),
                          F.round("planar_total", 6).alias("planar_total"), "n_segments")


@_query("line_stops")
def stop_fraction(a: Adapter) -> DataFrame:
    places = a.line_stops.select("lineid", "direction", "pointid")
    return positions.stop_fractions(places, a.shape_points, a.stops).select(
        "lineid", "direction", "pointid", *_round("fraction"))


@_query()
def line_centroid(a: Adapter) -> DataFrame:
    return shapes.line_centroids(shapes.shape_segments(a.shape_points)).select("lineid", "direction", *_round("lon", "lat"))


@_query("line_stops")
def segment_lengths(a: Adapter) -> DataFrame:
    """Great-circle and ellipsoidal metres of every shape segment."""
    segments = shapes.shape_segments(a.shape_points)
    ends = [F.col(c) for c in ("lon1", "lat1", "lon2", "lat2")]
    return segments.select("lineid", "direction", "seq", F.round(geo.haversine_m(*ends), 4).alias("haversine"),
                           F.round("metres", 4).alias("metres"))


@_query("line_stops")
def point_at_fraction(a: Adapter) -> DataFrame:
    """The point a stop's share of its line's stops leads to along the shape."""
    measured = materialise(shapes.measured_segments(shapes.shape_segments(a.shape_points)), "measured")
    sizes = measured.groupBy("lineid", "direction").agg(F.max("n_segments").alias("n_segments"))
    asked = a.line_stops.join(sizes, ["lineid", "direction"]).select(
        "lineid", F.col("direction").alias("dir_label"), "pointid", "n_segments",
        ((F.col("c_custkey") % 101) / 100).alias("fraction"))
    found = shapes.interpolate_on_shapes(asked, measured)
    return found.select("lineid", "dir_label", "pointid", "fraction", *_round("on_lon", "on_lat"))


@_query()
def shape_geojson(a: Adapter) -> DataFrame:
    return shapes.shape_geojson(a.shape_points)


@_query("line_stops")
def shape_lookup(a: Adapter) -> DataFrame:
    """Every line direction asked for; a direction that no shape has comes back empty."""
    keys = a.line_terminus.select("lineid", F.explode(F.array("direction", F.lit("Depot"))).alias("direction")).distinct()
    found = shapes.lookup_shapes(keys, a.line_shapes, a.shape_points)
    return found.select("lineid", "direction", "mode", "route_color", "route_text_color", "shape_id", "geometry")


# -- trips in time ----------------------------------------------------------

@_query()
def trip_assembly(a: Adapter) -> DataFrame:
    number = lambda c: F.round(c, 6).cast("string")
    fixes = F.transform("samples", lambda s: F.concat_ws(
        " ", F.unix_micros(s["ts"]).cast("string"), number(s["lon"]), number(s["lat"])))
    return trips.assemble_trips(a.trip_samples).select(
        "trip_id", "lineid", "direction", "part", _us("start_ts"), _us("end_ts"), "point_count",
        F.array_join(fixes, ";").alias("samples"))


@_query("trip_samples", "trips")
def value_at_instant(a: Adapter) -> DataFrame:
    here = temporal.value_at_instant(a.trip_samples, _hours_before_end(a.trips, 2), a.trips)
    return here.select("trip_id", "lineid", "direction", *_round("lon", "lat"))


@_query("trip_samples")
def value_at_many_instants(a: Adapter) -> DataFrame:
    """Every event asks where one trip was at one time."""
    e = F.col("event_id")
    asks = a.table("events").select(
        e.alias("ask_id"), e.cast("string").alias("trip_id"),
        instant(e * ORDER_SPACING_US + EPOCH_2024_US + (e * 37 % 2000) * 1_000_000).alias("at_ts"))
    found = temporal.value_at_many_instants(a.trip_samples, asks)
    return found.select("ask_id", "trip_id", _us("at_ts"), *_round("lon", "lat"))


@_query("trip_samples", "trips")
def trip_samples_in_window(a: Adapter) -> DataFrame:
    inside = temporal.samples_in_window(a.trip_samples, _hours_before_end(a.trips, 30), _hours_before_end(a.trips, 6))
    return inside.select("trip_id", "lineid", "direction", _us("ts"), *_round("lon", "lat"))


@_query("trip_samples", "trips")
def trip_samples_clipped(a: Adapter) -> DataFrame:
    """The same with interpolated values at the window's borders."""
    inside = temporal.samples_in_window(a.trip_samples, _hours_before_end(a.trips, 30), _hours_before_end(a.trips, 6),
                                        clip_bounds=True, trips=a.trips)
    return inside.select("trip_id", "lineid", "direction", _us("ts"), *_round("lon", "lat"))


@_query()
def trips_line_filter(a: Adapter) -> DataFrame:
    chosen = filter_trips(a.trips, ["1", "10", "N7"], None)
    return chosen.select("trip_id", "lineid", "direction", _us("start_ts"), _us("end_ts"), "point_count")


@_query()
def trip_extent(a: Adapter) -> DataFrame:
    return a.trips.select("trip_id", _us("start_ts"), _us("end_ts"), "point_count")


@_query()
def trips_direction_filter(a: Adapter) -> DataFrame:
    """Trips towards the terminus with the highest number."""
    target = a.trips.agg(F.max("direction")).first()[0]
    return filter_trips(a.trips, direction=target).select("trip_id", "lineid", "direction")


@_query("trips")
def trips_between(a: Adapter) -> DataFrame:
    chosen = temporal.active_between(a.trips, _hours_before_end(a.trips, 9), _hours_before_end(a.trips, 3))
    return chosen.select("trip_id", "lineid", _us("start_ts"), _us("end_ts"))


@_query("trips")
def recent_cutoff(a: Adapter) -> DataFrame:
    return cat.recent_cutoff(a.trips, 3).select(_us("cutoff"))


@_query("trips")
def trips_active_window(a: Adapter) -> DataFrame:
    chosen = temporal.active_around(a.trips, _hours_before_end(a.trips, 2))
    return chosen.select("trip_id", "lineid", "direction", _us("start_ts"), _us("end_ts"))


@_query()
def resolve_window(a: Adapter) -> DataFrame:
    return TimeFilter.parse(hours="1.5").window(a.trips).select(_us("w_start"), _us("w_end"))


@_query("trips")
def trips_all(a: Adapter) -> DataFrame:
    """Open trips (ended in the last hour) and numbered closed ones."""
    border = _hours_before_end(a.trips, 1)
    numbered = trips.number_by_service_day(a.trips.where(F.col("end_ts") <= border)).drop("service_day")
    both = trips.union_trips(a.trips.where(F.col("end_ts") > border), numbered)
    return both.select("trip_id", "lineid", "direction", _us("start_ts"), _us("end_ts"), "point_count",
                       "line_trip_id", "daily_trip_seq")


@_query("trips")
def service_day_trip_number(a: Adapter) -> DataFrame:
    return trips.number_by_service_day(a.trips).select(
        "trip_id", "lineid", F.date_format("service_day", "yyyy-MM-dd").alias("service_day"),
        "daily_trip_seq", "line_trip_id")


# -- catalogue --------------------------------------------------------------

@_query()
def line_metadata(a: Adapter) -> DataFrame:
    return cat.line_metadata(a.line_shapes)


@_query()
def line_destinations(a: Adapter) -> DataFrame:
    return cat.line_destinations(a.line_stops).select("lineid", F.array_join("destinations", "|").alias("destinations"))


@_query("trips")
def trips_per_terminus(a: Adapter) -> DataFrame:
    return cat.trips_per_terminus(a.trips, a.line_terminus, a.stops)


@_query("trips")
def direction_ranking(a: Adapter) -> DataFrame:
    return cat.direction_ranking(cat.trips_per_terminus(a.trips, a.line_terminus, a.stops))


@_query("line_stops", "trips")
def line_catalogue(a: Adapter) -> DataFrame:
    lines = cat.line_catalogue(a.line_shapes, a.line_stops, a.line_terminus, a.stops, a.trips)
    detail = F.transform("directions_detail", lambda d: F.concat_ws(
        ":", d["direction"].cast("string"), F.coalesce(d["destination"], F.lit("-")), d["trips"].cast("string")))
    return lines.select("lineid", "mode", "route_color", "route_text_color",
                        F.array_join("destinations", "|").alias("destinations"),
                        F.array_join(detail, "|").alias("directions_detail"))


@_query()
def direction_label(a: Adapter) -> DataFrame:
    return cat.direction_labels(a.line_stops)


@_query()
def terminus_locations(a: Adapter) -> DataFrame:
    return cat.terminus_locations(a.line_terminus, a.stops).select(
        "lineid", "direction", "terminus_pointid", *_round("lon", "lat"))


@_query()
def stops_serving_lines(a: Adapter) -> DataFrame:
    return cat.stops_serving_lines(a.stops, a.line_stops, ["1", "2", "N7"]).select(
        "pointid", "stop_name_fr", "stop_name_nl", *_round("lon", "lat"))


@_query()
def stop_details(a: Adapter) -> DataFrame:
    def text(e: Column) -> Column:
        return F.concat_ws(":", e["lineid"], F.coalesce(e["mode"], F.lit("-")), F.coalesce(e["color"], F.lit("-")),
                           F.coalesce(F.array_join(e["destinations"], ","), F.lit("-")),
                           F.array_join(e["directions"], ","))
    found = cat.stop_details(a.stops, a.line_stops, a.line_shapes)
    return found.select("pointid", "stop_name_fr", "stop_name_nl", *_round("lon", "lat"),
                        F.array_join(F.transform("lines", text), "|").alias("lines"))


@_query()
def line_order(a: Adapter) -> DataFrame:
    """Lines with their sort key for display."""
    rank, is_text, number, _ = cat.line_order(F.col("mode"), F.col("lineid"))
    return cat.line_metadata(a.line_shapes).select(
        "lineid", "mode", rank.cast("int").alias("mode_rank"), is_text.alias("is_text"),
        F.col("lineid").try_cast("long").alias("number")).orderBy(rank, is_text, number, "lineid")


# -- user-level questions ---------------------------------------------------

@_query("line_stops", "trip_samples", "trips")
def positions_at(a: Adapter) -> DataFrame:
    found = plans.positions_at(a.trips, a.trip_samples, a.line_shapes, _hours_before_end(a.trips, 2))
    return found.select("trip_id", "lineid", "direction", "line_trip_id", *_round("lon", "lat"),
                        "mode", "route_color", "route_text_color")


@_query("line_stops", "trip_samples", "trips")
def positions_at_limited(a: Adapter) -> DataFrame:
    """The first rows of the live map, as a request may ask for."""
    found = plans.positions_at(a.trips, a.trip_samples, a.line_shapes, _hours_before_end(a.trips, 2), limit=7)
    return found.select("trip_id", "lineid", "direction", "line_trip_id", *_round("lon", "lat"),
                        "mode", "route_color", "route_text_color")


@_query("line_stops", "trip_samples", "trips")
def positions_at_service_day(a: Adapter) -> DataFrame:
    """Labels that count all trips of the service day."""
    found = plans.positions_at(a.trips, a.trip_samples, a.line_shapes, _hours_before_end(a.trips, 2),
                               numbering="service_day")
    return found.select("trip_id", "line_trip_id", *_round("lon", "lat"))


@_query("line_stops", "trip_samples", "trips")
def trajectories(a: Adapter) -> DataFrame:
    rows = plans.trajectories(a.trips, a.trip_samples, a.line_stops, a.line_shapes,
                              _hours_before_end(a.trips, 26), _hours_before_end(a.trips, 2))
    return rows.select("trip_id", "lineid", "dir_label", "line_trip_id", "shape_id", "mode", "route_color",
                       "t_ms", *_round("lon", "lat"))


@_query("line_stops", "trip_samples", "trips")
def trajectories_packed(a: Adapter) -> DataFrame:
    """One row per trip in a window, its samples in time order."""
    packed = plans.pack_trajectories(plans.trajectories(
        a.trips, a.trip_samples, a.line_stops, a.line_shapes, _hours_before_end(a.trips, 5), _hours_before_end(a.trips, 4)))
    number = lambda c: (F.round(c * 1e6) / 1e6).cast("string")
    fixes = F.transform("samples", lambda s: F.concat_ws(" ", s["t_ms"].cast("string"), number(s["lon"]), number(s["lat"])))
    return packed.select("trip_id", "lineid", "dir_label", "line_trip_id", "shape_id", "mode",
                         F.array_join(fixes, ";").alias("samples"))


def _stored_trips(a: Adapter) -> Tables:
    """Trips in the stored layout by day; one line is rebuilt once more."""
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    tables.replace_trips(plain_headers(a.trips), a.trip_samples)
    again = filter_trips(a.trips, ["1"])
    tables.replace_trips(plain_headers(again), a.trip_samples.where("lineid = '1'"), lines=["1"])
    return tables


def plain_headers(trips: DataFrame) -> DataFrame:
    """Headers in the stored columns; what the views do not have is NULL."""
    none = F.lit(None).cast("string")
    return trips.withColumns({"vehicle_uuid": none, "line_trip_id": none, "daily_trip_seq": F.lit(None).cast("int")})


@_query("line_stops", "trip_samples", "trips")
def positions_at_stored(a: Adapter) -> DataFrame:
    """The live map over stored tables, of which it reads the days around the instant."""
    tables = _stored_trips(a)
    at = tables.latest_end() - timedelta(hours=2)
    found = plans.positions_at(tables.read_by_day("trips"), tables.read_by_day("trip_samples"), a.line_shapes, at)
    return found.select("trip_id", "lineid", "direction", "line_trip_id", *_round("lon", "lat"),
                        "mode", "route_color", "route_text_color")


@_query("line_stops", "trip_samples", "trips")
def trajectories_stored(a: Adapter) -> DataFrame:
    """A day's trajectories over stored tables."""
    tables = _stored_trips(a)
    end = tables.latest_end()
    rows = plans.trajectories(tables.read_by_day("trips"), tables.read_by_day("trip_samples"), a.line_stops, a.line_shapes,
                              end - timedelta(hours=26), end - timedelta(hours=2))
    return rows.select("trip_id", "lineid", "dir_label", "line_trip_id", "shape_id", "mode", "route_color",
                       "t_ms", *_round("lon", "lat"))


@_query("line_stops", "trip_samples", "trips")
def trips_in_box_and_window(a: Adapter) -> DataFrame:
    """Trips that pass a part of the map within a day, over stored tables."""
    tables = _stored_trips(a)
    end = tables.latest_end()
    found = spacetime.trips_in_box(tables.read_by_day("trip_boxes"), tables.read_by_day("trip_samples"),
                                   spacetime.Box(4.3205, 50.8085, 4.3445, 50.8195), end - timedelta(hours=30), end - timedelta(hours=6))
    return found.select("trip_id", "lineid", "direction", F.unix_millis("entered").alias("entered_ms"), F.unix_millis("left").alias("left_ms"))


def _eta(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, _us("poll_ts"), "lineid", _us("expected"), "destination", "message")


@_query()
def waiting_times_for_stop(a: Adapter) -> DataFrame:
    return _eta(plans.waiting_times_for_stop(a.waiting_times, "42"))


@_query()
def waiting_times_stored(a: Adapter) -> DataFrame:
    """The same over stored estimates, from the newest days that hold enough."""
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    tables.append_waiting_times(a.waiting_times)
    return _eta(pipelines.arrivals(tables, "42"))


@_query()
def waiting_times_per_stop(a: Adapter) -> DataFrame:
    return _eta(plans.waiting_times_per_stop(a.waiting_times), "pointid", "rn")


@_query("line_stops")
def search(a: Adapter) -> DataFrame:
    found = plans.search(a.stops, a.line_shapes, a.shape_points, "15")
    return found.select("type", "category", "id", "label", "sub", *_round("lat", "lon"))


@_query()
def table_counts(a: Adapter) -> DataFrame:
    names = ["stops", "line_stops", "line_terminus", "line_shapes", "trips", "trip_samples", "waiting_times", "feed"]
    return plans.table_counts({n: getattr(a, n) for n in names})


# -- GTFS -------------------------------------------------------------------

def _gtfs_trips(a: Adapter) -> DataFrame:
    stops = a.line_stops.select("lineid", F.col("c_custkey").alias("o_custkey"))
    mostly = F.when((F.floor(F.col("o_orderkey") / 2) + F.col("o_custkey")) % 3 == 0, 1).otherwise(0)
    side = (F.col("o_orderkey") + mostly) % 2
    return a.table("orders").join(stops, "o_custkey").select(
        F.concat(F.lit("R"), "lineid").alias("route_id"), (F.col("o_orderkey") % 2).cast("int").alias("direction_id"),
        F.concat("lineid", F.when(side == 0, "_City").otherwise("_Suburb")).alias("shape_id"),
        F.col("o_orderkey").alias("row_no"))


def _gtfs_vertices(a: Adapter) -> DataFrame:
    """Line shapes with sparse numbers; some run backwards, some lie far off."""
    from pulseline.adapters import _lat, _lon
    off = F.when(F.col("nk") % 7 == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    return a.line_stops.select(
        F.concat_ws("_", "lineid", "direction").alias("shape_id"),
        F.when(F.col("nk") % 3 == 1, -F.col("sequence_idx")).otherwise(F.col("sequence_idx") * 10).alias("seq"),
        _lon().alias("lon"), (_lat(50.8001) + off).alias("lat"))


def _gtfs_routes(a: Adapter) -> DataFrame:
    lines = a.line_stops.select("lineid", "nk").distinct()
    raw = F.when(F.col("nk") % 4 == 0, F.concat(F.lit("#ab12"), F.lpad(F.col("nk").cast("string"), 2, "0")))
    return lines.select(
        F.concat(F.lit("R"), "lineid").alias("route_id"), F.col("lineid").alias("route_short_name"),
        (F.col("nk") % 9).cast("string").alias("route_type"), raw.alias("route_color"),
        F.when(F.col("nk") % 2 == 0, "xyz").otherwise("ffffff").alias("route_text_color"),
        F.col("nk").cast("long").alias("row_no"))


@_query()
def canonical_shape(a: Adapter) -> DataFrame:
    return network.canonical_shapes(_gtfs_trips(a)).drop("first_row")


@_query("line_stops")
def polyline_assembly(a: Adapter) -> DataFrame:
    wanted = network.canonical_shapes(_gtfs_trips(a))
    return network.assemble_polylines(_gtfs_vertices(a), wanted).select("shape_id", "idx", *_round("lon", "lat"), "n_points")


@_query()
def route_attributes_(a: Adapter) -> DataFrame:
    return route_attributes(_gtfs_routes(a))


@_query("line_stops")
def shape_direction(a: Adapter) -> DataFrame:
    canonical = network.canonical_shapes(_gtfs_trips(a))
    polylines = network.assemble_polylines(_gtfs_vertices(a), canonical)
    termini = cat.terminus_locations(a.line_terminus, a.stops)
    found = network.shape_directions(canonical, polylines, route_attributes(_gtfs_routes(a)), termini)
    return found.select("route_id", "direction_id", "shape_id", "lineid", "dir_label",
                        F.round("metres", 3).alias("metres"), "reverse", "skipped")


@_query("line_stops")
def gtfs_load(a: Adapter) -> DataFrame:
    """An unpacked feed's files loaded into line shapes."""
    folder = scratch(a.spark, "gtfs")

    def file(rows: DataFrame, name: str) -> None:
        # As many files as tasks. The first trip seen decides ties; rows carry their number.
        rows.write.option("header", True).csv(f"{folder}/{name}")

    file(_gtfs_trips(a), "trips.txt")
    file(_gtfs_routes(a), "routes.txt")
    file(_gtfs_vertices(a).withColumnsRenamed({"seq": "shape_pt_sequence", "lat": "shape_pt_lat", "lon": "shape_pt_lon"}), "shapes.txt")
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    tables.replace("stops", a.stops)
    tables.replace("line_terminus", a.line_terminus)
    pipelines.load_gtfs(a.spark, tables, folder)
    first = tables.read("shape_points").groupBy("lineid", "direction").agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(F.struct("lon", "lat"), "seq").alias("head"))
    return tables.read("line_shapes").join(first, ["lineid", "direction"]).select(
        "lineid", "direction", "variant", "mode", "n_points", F.col("head.lon").alias("lon"), F.col("head.lat").alias("lat")).select(
        "lineid", "direction", "variant", "mode", "n_points", *_round("lon", "lat"))


# -- tiles ------------------------------------------------------------------

@_query()
def tile_stops(a: Adapter) -> DataFrame:
    return tiles.tile_stops(a.stops, [10, 12, 14])


@_query("line_stops")
def tile_lines(a: Adapter) -> DataFrame:
    return tiles.tile_lines(a.shape_points, a.line_shapes, [11, 13])


@_query("line_stops")
def tile_lines_unsimplified(a: Adapter) -> DataFrame:
    """Snapping, tile assignment and clipping alone: every vertex is kept."""
    return tiles.tile_lines(a.shape_points, a.line_shapes, [11, 13], min_area=0.0)


def _parts_text(column: str) -> Column:
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.array_join(F.transform(column, lambda part: F.array_join(F.transform(part, point), ",")), ";")


@_query("line_stops")
def tile_features(a: Adapter) -> DataFrame:
    """One multi-part feature per shape and tile."""
    found = tiles.line_features(tiles.tile_lines(a.shape_points, a.line_shapes, [11, 13]))
    return found.select("z", "x", "y", "lineid", "direction", "mode", "route_color", "route_text_color", "variant",
                        F.size("parts").cast("long").alias("n_parts"), _parts_text("parts").alias("geometry"))


@_query("line_stops")
def tile_table(a: Adapter) -> DataFrame:
    """Both layers through the stored tile table, all of its rows."""
    tables = Tables(a.spark, scratch(a.spark, "tables"))
    tables.replace("stops", a.stops)
    tables.replace("shape_points", a.shape_points)
    tables.replace("line_shapes", a.line_shapes)
    pipelines.rebuild_tiles(tables, [11, 13], min_area=0.0)
    return tables.read("tile_features").select("layer", "z", "x", "y", "quadkey", "feature_id", "stop_name_nl", "mode", _parts_text("parts").alias("geometry"))
