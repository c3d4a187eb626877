"""Online trip linking on the engine's state: the batch linker's rule, carried from micro-batch to micro-batch.

The stream of located pings has a watermark. Per line and direction the state store holds the
pings that the watermark has not passed and the open trips, with the last ping of each. A timer at the
oldest waiting ping wakes a key once the watermark is past it; what is due is then linked in
time order, so the result is the one the batch job gives. Trips that nothing can extend
any more leave the state by the same timers, and a key without trips and pings has none. Linked pings go
to a file sink. Watermark, state versions, restarts, and counting and dropping late rows are the engine's.

A line-direction is one key: what it holds is bounded by the lateness, one trigger's rows and the
trips open within the match window, not by its history. Re-linking history is the batch job's
work, which cuts a line into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulseline.operators import linking
from pulseline.session import pin_utc

# Waiting pings are kept as Arrow streams of ``BLOCK`` pings, as the state hands rows over one by one.
WAITING = "pings binary"
BLOCK = 8192
OPEN = "us long, lon double, lat double, position_id string, head string"
LINKED = "lineid string, direction int, us long, lon double, lat double, position_id string, head string"
PING = "position_id string, lineid string, direction int, fetched_at timestamp, lon double, lat double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HELD = pa.schema({"us": pa.int64(), "lon": pa.float64(), "lat": pa.float64(), "position_id": pa.string()})
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(pings: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pings), HELD.types)], schema=HELD))
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> Iterator[tuple]:
    return zip(*[column.to_pylist() for column in pa.ipc.open_stream(block).read_all().columns])


class LinkProcessor(StatefulProcessor):
    """State: ``waiting`` pings, in blocks, and ``open`` trips in the order they were opened."""

    def __init__(self, radius_m: float, window_us: int):
        self.radius_m = radius_m
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.open = handle.getListState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = []
        for batch in rows:
            placed = batch[batch["lon"].notna() & batch["lat"].notna()]
            arrived += zip(placed["us"].tolist(), placed["lon"].tolist(), placed["lat"].tolist(), placed["position_id"].tolist())
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [])

    def close(self) -> None:
        pass

    def _advance(self, key, watermark_us: int, arrived: list[tuple]) -> Iterator[pd.DataFrame]:
        once: dict[str, tuple] = {}
        kept = [ping for (block,) in self._held(self.waiting) for ping in _unpacked(block)]
        for ping in sorted([*kept, *arrived]):
            once.setdefault(ping[3], ping)
        due = [p for p in once.values() if p[0] < watermark_us]
        waiting = [p for p in once.values() if p[0] >= watermark_us]
        held = self._held(self.open)
        heads, alive = [], held
        if due:
            trips = linking.OpenTrips(self.radius_m, self.window_us)
            for us, lon, lat, ping, head in held:
                trips.open(us, lon, lat, ping, False)[5] = head
            heads = [trips.place(*ping)[5] for ping in due]
            alive = [tuple(t[1:6]) for t in trips.still_open(due[-1][0])]
        alive = [t for t in alive if t[0] >= watermark_us - self.window_us]
        self._keep(self.waiting, [(_packed(waiting[at:at + BLOCK]),) for at in range(0, len(waiting), BLOCK)])
        if due or len(alive) < len(held):
            self._keep(self.open, alive)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        elif alive:
            self.handle.registerTimer((max(t[0] for t in alive) + self.window_us) // 1000 + 1)
        if due:
            found = pd.DataFrame(due, columns=["us", "lon", "lat", "position_id"])
            found.insert(0, "lineid", key[0])
            found.insert(1, "direction", key[1])
            yield found.assign(head=heads)

    @staticmethod
    def _held(state) -> list[tuple]:
        return [tuple(row) for row in state.get()] if state.exists() else []

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()


class TripLinker:
    """Links a stream of located pings below one folder, which holds checkpoint and linked pings."""

    def __init__(self, spark: SparkSession, folder: str, lateness_s: float = 600.0,
                 radius_m: float = linking.MATCH_RADIUS_M, window_s: float = linking.MATCH_WINDOW_S):
        self.spark = pin_utc(spark)
        self.folder = folder.rstrip("/")
        self.lateness_s = lateness_s
        self.radius_m, self.window_us = radius_m, int(window_s * 1_000_000)

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def linked_stream(self, positions: DataFrame) -> DataFrame:
        """Each located ping with the first ping of its trip. Rows without coordinates only move the time on."""
        timed = positions.withWatermark("fetched_at", f"{int(self.lateness_s * 1000)} milliseconds").select(
            "lineid", "direction", "fetched_at", F.unix_micros("fetched_at").alias("us"), "lon", "lat", "position_id")
        return timed.groupBy("lineid", "direction").transformWithStateInPandas(
            LinkProcessor(self.radius_m, self.window_us), LINKED, "Append", "EventTime")

    def start(self, positions: DataFrame, **trigger):
        """Starts the stream, or goes on from its checkpoint."""
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)  # state with timers needs this one; the query keeps it
        try:
            return (self.linked_stream(positions).writeStream.format("parquet").option("path", f"{self.folder}/linked")
                    .option("checkpointLocation", self.checkpoint).trigger(**(trigger or {"availableNow": True})).start())
        finally:
            self.spark.conf.set(PROVIDER, before) if before else self.spark.conf.unset(PROVIDER)

    def heartbeat(self, at: datetime) -> DataFrame:
        """A row without coordinates for the feed: at the end of a finite input it moves the time past
        what still waits."""
        return self.spark.createDataFrame([("heartbeat", None, None, at, None, None)], PING)

    def samples(self) -> DataFrame:
        """All linked pings so far as trip samples; the file sink's log tells which files count."""
        return linking.trip_samples(self.spark.read.schema(LINKED).parquet(f"{self.folder}/linked"))

    def open_trips(self, as_of: datetime, batch: int | None = None) -> DataFrame:
        """Trips that a ping may still extend, read from the state store: last ping and head of each. ``as_of`` is the
        watermark; a key that had neither ping nor timer since may still hold older ones. ``batch`` reads an
        earlier version."""
        reader = self.spark.read.format("statestore").option("stateVarName", "open")
        if batch is not None:
            reader = reader.option("batchId", batch)
        held = reader.load(self.checkpoint).select("key.lineid", "key.direction", "list_element.*")
        return held.where(F.col("us") >= F.unix_micros(F.lit(as_of).cast("timestamp")) - self.window_us)

    def trips(self, as_of: datetime) -> tuple[DataFrame, DataFrame]:
        """(open trips, closed trips), headers of both. Open ones carry their last point and may have one
        ping; closed ones have two or more."""
        samples = self.samples()
        last = self.open_trips(as_of).select(F.col("head").alias("first_position_id"), F.struct("lon", "lat").alias("last_point"))
        heads = last.select("first_position_id")
        running = linking.build_trips(samples.join(heads, "first_position_id", "left_semi"), min_points=1)[0]
        points = samples.join(last, "first_position_id").select("trip_id", "last_point").distinct()
        closed = linking.build_trips(samples.join(heads, "first_position_id", "left_anti"))[0]
        return running.drop("daily_trip_seq").join(points, "trip_id"), closed


def late_rows(query) -> int:
    """Pings that came behind the watermark in this run, as the engine counted them."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)
