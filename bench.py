"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries`` are whole registered queries: they build the transit tables they need
from the given Parquet files and then answer. ``loaded`` are the answers alone,
over tables written beforehand (``load``: seconds per table), which is the state a
deployment serves from. Each runs $BENCH_RUNS times (default 3) into the no-op
sink; the best run counts, ``cold`` holds the first.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from checks.queries import on_views, registered
from pulseline.adapters import Adapter
from pulseline.session import local_session

HEADLINE = [
    "positions_at", "trajectories", "line_catalogue", "stop_details", "search", "waiting_times_per_stop",
    "ping_coercion", "ping_geometry", "trip_linking", "value_at_many_instants", "service_day_trip_number",
    "trip_assembly", "stop_fraction", "shape_direction", "tile_stops", "tile_lines", "table_counts",
]
LOADED = ["positions_at", "trajectories", "line_catalogue", "stop_details", "search", "waiting_times_for_stop"]
TABLES = ["line_stops", "stops", "shape_points", "line_shapes", "line_terminus", "trip_samples", "trips", "waiting_times"]


def timed(run: Callable[[], object], runs: int) -> list[float]:
    spent = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        spent.append(round(time.perf_counter() - start, 3))
    return spent


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "12g"), shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    every, views = registered(), on_views()
    spent = {name: timed(lambda: consume(every[name](spark, folder)), runs) for name in wanted}
    stored = Adapter(spark, folder, TABLES)
    load = {name: timed(lambda: getattr(stored, name), 1)[0] for name in TABLES}
    loaded = {name: timed(lambda: consume(views[name](stored)), runs) for name in LOADED}
    best = {name: min(times) for name, times in spent.items()}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best,
        "cold": {name: times[0] for name, times in spent.items()},
        "loaded": {name: min(times) for name, times in loaded.items()}, "load": load,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
