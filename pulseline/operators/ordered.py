"""Order-dependent operators that never put a whole group into one task.

Each takes a ``bucket`` column that does not decrease along the wanted order (a
time slice, a key range). Rows are ordered only inside (group, bucket); what
crosses bucket borders - counts, sums, the next row - comes from a small
pre-aggregated table with one row per (group, bucket). Group columns must not
be NULL. The callers choose bucket widths that bound the rows per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along_buckets(group: Sequence[str], bucket: str):
    return Window.partitionBy(*group).orderBy(bucket)


def running_number(df: DataFrame, group: Sequence[str], bucket: str,
                   order: Sequence[str | Column], out: str) -> DataFrame:
    """``row_number`` over ``group`` by ``order``."""
    earlier = _along_buckets(group, bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*group, bucket, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    numbered = df.withColumn("_local", local).join(before, [*group, bucket])
    return numbered.withColumn(out, (F.col("_before") + F.col("_local")).cast("long")).drop("_before", "_local")


def running_total(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str | Column],
                  value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows strictly before the current one."""
    earlier = _along_buckets(group, bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
        .select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    )
    inside = (Window.partitionBy(*group, bucket).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    summed = df.withColumn("_local", local).join(before, [*group, bucket])
    return summed.withColumn(out, F.col("_before") + F.col("_local")).drop("_before", "_local")


def next_row(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str],
             columns: Sequence[str], out: str) -> DataFrame:
    """Struct of ``columns`` of the following row, NULL on the last one."""
    row = F.struct(*columns)
    following = (
        df.groupBy(*group, bucket).agg(F.min_by(row, F.struct(*order)).alias("_head"))
        .select(*group, bucket, F.lead("_head").over(_along_buckets(group, bucket)).alias("_following"))
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    joined = df.withColumn("_next", F.lead(row).over(inside)).join(following, [*group, bucket])
    return joined.withColumn(out, F.coalesce("_next", "_following")).drop("_next", "_following")


def earliest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str],
                     latest: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by ``order``. A hash or sort
    aggregate with map-side combine, so a key with many copies stays cheap."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    if list(order) == rest:
        chosen = (F.max if latest else F.min)(F.struct(*rest))
    else:
        rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
        chosen = (F.max_by if latest else F.min_by)(F.struct(*rest), rank)
    return (
        df.groupBy(*key).agg(chosen.alias("_row"))
        .select(*key, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )
