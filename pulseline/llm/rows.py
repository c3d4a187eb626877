"""Whole rows carried through an operator as one struct, so that no column name can clash
with the operator's own. Columns named like an operator's results are replaced by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def packed(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, and all others as the struct ``rest``, whose fields are named by place."""
    others = [named(c).alias(f"c{place}") for place, c in enumerate(docs.columns) if c not in kept]
    return docs.select(*kept, F.struct(F.lit(True).alias("row"), *others).alias("rest"))


def unpacked(rows: DataFrame, columns: Sequence[str], kept: Sequence[str], results: Sequence[str]) -> DataFrame:
    """The rows of ``packed`` as ``columns`` again, with ``results`` behind them."""
    old = [named(c) if c in kept else F.col(f"rest.c{place}").alias(c) for place, c in enumerate(columns) if c not in results]
    return rows.select(*old, *results)
