"""Writing: insert-ignore, upsert, replace, append, replayable mirror.

Every rewritten table lives in numbered snapshot folders, and a reader takes the
highest finished one. A lost executor or driver therefore never leaves a table
half replaced, and a job may read the table it rewrites.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulseline import schemas
from pulseline.durable import materialise, observed, scratch_scope
from pulseline.operators.merge import new_rows, upserted
from pulseline.operators.spacetime import BOXES, part_boxes
from pulseline.operators.tiles import FEATURES
from pulseline.operators.trips import by_day
from pulseline.session import pin_utc

# Primary key per catalogue table.
KEYS = {
    "stops": ["pointid"], "line_stops": ["lineid", "direction", "sequence_idx"],
    "line_terminus": ["lineid", "terminus_pointid"], "line_shapes": ["lineid", "direction"],
}
SCHEMAS = {
    "stops": schemas.STOPS, "line_stops": schemas.LINE_STOPS, "line_terminus": schemas.LINE_TERMINUS,
    "line_shapes": schemas.LINE_SHAPES, "shape_points": schemas.SHAPE_POINTS,
    "positions": schemas.POSITIONS + ", service_date date", "waiting_times": schemas.WAITING_TIMES + ", poll_date date",
    "waiting_counts": "pointid string, poll_date date, n long",
    "trips": schemas.TRIPS + ", first_day date, day date", "trip_samples": schemas.TRIP_SAMPLES + ", day date",
    "rejected_pings": "load string, file string, reason string, record string", "load_report": "load string, step string, outcome string, n long",
    "trip_boxes": BOXES + ", first_day date, day date", "tile_features": FEATURES,
}


# Replaced together, under the same snapshot number.
JOINT = ("trips", "trip_samples", "trip_boxes")
# Written by appending alone, without snapshots.
APPENDED = ("positions", "waiting_times", "waiting_counts", "rejected_pings", "load_report")
# Columns of the layout by day, which plain readers do not see.
DAYS = ("day", "first_day")


class Tables:
    """The library's tables below one root folder. Pins the session to UTC, which
    texts without an offset, service dates and partitions are read in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = pin_utc(spark)
        self.root = root.rstrip("/")

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        files, hadoop = self._files(path)
        return files.exists(hadoop)

    def _snapshots(self, name: str) -> list[int]:
        files, folder = self._files(f"{self.root}/{name}")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[9:]) for n in names if n.startswith("snapshot="))

    def _finished(self, name: str) -> list[int]:
        """Snapshots that a reader may take; of tables replaced together, those that all have."""
        joint = JOINT if name in JOINT else (name,)
        return [n for n in self._snapshots(name)
                if all(self._exists(f"{self.root}/{other}/snapshot={n}/_SUCCESS") for other in joint)]

    def read(self, name: str) -> DataFrame:
        """The table's rows; an empty one if nothing was written yet."""
        rows = self.read_by_day(name)
        if name not in JOINT:
            return rows
        return (rows if name == "trip_samples" else rows.where("day = first_day")).drop(*DAYS)

    def trip_days(self) -> list[date]:
        """The days (UTC) that stored trips touch, from the names of the partitions."""
        finished = self._finished("trips")
        if not finished:
            return []
        files, folder = self._files(f"{self.root}/trips/snapshot={finished[-1]}")
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and n[4:5].isdigit())

    def latest_end(self) -> datetime | None:
        """The newest trip end; the trip that has it touches the last day, so only that day's headers are read."""
        days = self.trip_days()
        if not days:
            return None
        # Its folder alone is listed.
        table = f"{self.root}/trips/snapshot={self._finished('trips')[-1]}"
        newest = self.spark.read.schema(SCHEMAS["trips"]).option("basePath", table).parquet(f"{table}/day={days[-1]}")
        last = newest.agg(F.unix_micros(F.max("end_ts"))).first()[0]
        return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last)

    def read_by_day(self, name: str) -> DataFrame:
        """The rows as they are laid out. Trips and their boxes have one for each ``day`` that they touch, samples the day they
        fall on; functions that ask for an instant or a window read only the days they need of such rows."""
        reader = self.spark.read.schema(SCHEMAS[name])
        if name in APPENDED:
            path = f"{self.root}/{name}"
            return reader.parquet(path) if self._exists(path) else self.spark.createDataFrame([], SCHEMAS[name])
        finished = self._finished(name)
        if not finished:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return reader.parquet(f"{self.root}/{name}/snapshot={finished[-1]}")

    def _next_snapshot(self, *names: str) -> int:
        return max((n for name in names for n in self._snapshots(name)), default=0) + 1

    def replace(self, name: str, rows: DataFrame, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
                number: int | None = None) -> None:
        """Truncate-and-load: a new snapshot takes the old one's place, which stays until
        the one after that, for readers that hold it."""
        number = number or self._next_snapshot(name)
        for old in self._finished(name)[:-1]:
            files, folder = self._files(f"{self.root}/{name}/snapshot={old}")
            files.delete(folder, True)
        if sort_by:
            rows = rows.sortWithinPartitions(*partition_by, *sort_by)
        writer = rows.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/snapshot={number}")

    def upsert(self, name: str, incoming: DataFrame, load_order: Sequence[str] = ("file", "row_no"),
               columns: Sequence[str] | None = None) -> None:
        """Insert or update by key; within ``incoming`` the last row wins.
        With ``columns`` an update touches only those and keeps the others."""
        self.replace(name, upserted(self.read(name), incoming, KEYS[name], load_order, columns))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]).write.mode("append").parquet(f"{self.root}/{name}")

    def insert_positions(self, incoming: DataFrame) -> dict[str, int]:
        """Insert-ignore by position id. A derived id contains the time, so its
        copies share a service date and are looked for on the incoming dates
        only; ids that came with the data (``id_given``) are looked for everywhere.
        Returns how many rows came in and how many were new, counted as they are written."""
        columns = [c.split()[0] for c in SCHEMAS["positions"].split(", ")]
        if "id_given" not in incoming.columns:
            incoming = incoming.withColumn("id_given", F.lit(True))
        came, added = Observation(), Observation()
        rows = materialise(
            incoming.withColumn("service_date", F.to_date("fetched_at")).select(*columns, "id_given")
            .observe(came, F.count(F.lit(1)).alias("n")), "incoming-positions")
        # One value per calendar day of the input.
        dates = [r["service_date"] for r in rows.select("service_date").distinct().collect()]
        stored = self.read("positions").select("service_date", "position_id")
        order = ["fetched_at", "lineid", "direction", "pointid", "distance_from_point", "lon", "lat"]
        derived = new_rows(stored.where(F.col("service_date").isin(dates)), rows.where(~F.col("id_given")),
                           ["service_date", "position_id"], order)
        fresh = derived
        if not rows.where("id_given").isEmpty():
            taken = stored.unionByName(derived.select(*stored.columns))
            fresh = derived.unionByName(new_rows(taken, rows.where("id_given"), ["position_id"], order))
        (fresh.select(*columns).hint("rebalance", "service_date")
         .sortWithinPartitions("service_date", "lineid", "direction", "fetched_at").observe(added, F.count(F.lit(1)).alias("n"))
         .write.mode("append").partitionBy("service_date").parquet(f"{self.root}/positions"))
        return {"incoming": observed(came).get("n", 0), "inserted": observed(added).get("n", 0)}

    def append_waiting_times(self, rows: DataFrame, once: bool = False) -> None:
        """Plain append; ``once`` skips rows that are there already. Partitioned by the day
        of the poll and sorted by stop, so a stop or a time range reads few row groups. Rows per stop and day
        are added to ``waiting_counts`` when the rows are there: what is lost between the two writes makes
        counts too small, never too large, and a reader of the newest days goes further back."""
        rows = rows.drop("poll_date")
        if once:
            stored = self.read("waiting_times")
            same = [rows[c].eqNullSafe(stored[c]) for c in rows.columns]
            rows = rows.distinct().join(stored, same, "left_anti")
        with scratch_scope(self.spark):
            rows = materialise(rows.withColumn("poll_date", F.to_date("poll_ts")), "waiting-times")
            (rows.hint("rebalance", "poll_date").sortWithinPartitions("poll_date", "pointid", "poll_ts")
             .write.mode("append").partitionBy("poll_date").parquet(f"{self.root}/waiting_times"))
            self.append("waiting_counts", rows.groupBy("pointid", "poll_date").agg(F.count(F.lit(1)).alias("n"))
                        .sortWithinPartitions("pointid", "poll_date"))

    def replace_trips(self, trips: DataFrame, samples: DataFrame, lines: list[str] | None = None) -> None:
        """Replaces all trips, or only those of ``lines``. Headers and samples are partitioned by day (UTC),
        a header once for each day that its trip touches, and sorted by line and time, so that an
        instant or a window reads few days and a line filter few row groups; boxes of trip parts are written
        with them, sorted by place. Headers, samples and boxes become visible at once, as a new joint
        snapshot, when all are written; one for some lines takes the others' rows from the snapshot before."""
        number, finished = self._next_snapshot(*JOINT), self._finished(JOINT[0])
        order = {"trips": ["lineid", "start_ts", "trip_id"], "trip_samples": ["lineid", "ts", "trip_id"], "trip_boxes": ["place", "start_ts", "trip_id"]}
        for name, rows in (("trips", trips), ("trip_samples", samples), ("trip_boxes", part_boxes(samples))):
            rows = rows.select(*[c.split()[0] for c in SCHEMAS[name].split(", ") if c.split()[0] not in DAYS])
            if lines is not None and finished:
                rows = rows.unionByName(self.read(name).where(~F.col("lineid").isin(lines)))
            self.replace(name, by_day(rows).hint("rebalance", "day"), ["day"], order[name], number)

    def replace_tiles(self, features: DataFrame) -> None:
        """Replaces the tile table. Files hold disjoint ranges of quadkeys; the feature's id takes part in
        the range, so a tile that holds everything is spread over tasks too."""
        ranged = features.repartitionByRange("layer", "z", "quadkey", "feature_id")
        self.replace("tile_features", ranged, ["layer", "z", "cell"], ["quadkey", "feature_id"])


def write_mirror(records: DataFrame, folder: str, started_at: datetime) -> str:
    """Writes ping records as gzip JSON lines to a folder of its own, named after
    the start time; an existing one is never touched."""
    target = f"{folder.rstrip('/')}/positions/vehicle_positions_{started_at:%Y-%m-%dT%H-%M-%SZ}"
    (records.write.mode("errorifexists").option("compression", "gzip")
     .option("ignoreNullFields", "false").json(target))
    return target
