"""Insert-ignore and upsert as relations; ``sinks.tables`` writes the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.operators.ordered import earliest_per_key


def new_rows(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not there yet; the first one per key."""
    first = earliest_per_key(incoming, key, order)
    return first.join(existing.select(*key), list(key), "left_anti").select(*incoming.columns)


def upserted(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str],
             columns: Sequence[str] | None = None) -> DataFrame:
    """The whole table after insert-or-update by key; the last incoming row per
    key wins. With ``columns`` an update changes only those."""
    last = earliest_per_key(incoming, key, order, latest=True)
    if columns is None:
        kept = existing.join(last.select(*key), list(key), "left_anti")
        return kept.unionByName(last.select(*existing.columns))
    changes = last.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    return existing.join(changes, list(key), "full").select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in existing.columns])
