"""Request parameters: line lists and time windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_HOURS, MAX_HOURS = 0.05, 24.0


def parse_instant(text: str | None) -> datetime | None:
    """ISO text to a UTC instant; no offset means UTC, nonsense means None."""
    try:
        value = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return value.replace(tzinfo=value.tzinfo or timezone.utc).astimezone(timezone.utc)


def parse_lines(text: str | None) -> list[str] | None:
    """``"71, 92"`` to ``["71", "92"]``; nothing named means all lines."""
    return [part.strip() for part in (text or "").split(",") if part.strip()] or None


@dataclass(frozen=True)
class TimeFilter:
    """An explicit range, or the last ``hours`` before the newest trip end."""

    hours: float = 1.0
    start: datetime | None = None
    end: datetime | None = None

    @classmethod
    def parse(cls, hours: str | None = None, start: str | None = None, end: str | None = None,
              default_hours: float = 1.0) -> "TimeFilter":
        try:
            wanted = float(hours) if hours else default_hours
        except ValueError:
            wanted = default_hours
        first, last = parse_instant(start), parse_instant(end)
        if not (first and last and first < last):
            first = last = None
        return cls(min(max(wanted, MIN_HOURS), MAX_HOURS), first, last)

    def window(self, trips: DataFrame) -> DataFrame:
        """One row (w_start, w_end)."""
        if self.start and self.end:
            one = trips.sparkSession.range(1)
            return one.select(F.lit(self.start).cast("timestamp").alias("w_start"),
                              F.lit(self.end).cast("timestamp").alias("w_end"))
        latest = trips.agg(F.max("end_ts").alias("w_end"))
        return latest.select((F.col("w_end") - F.lit(timedelta(hours=self.hours))).alias("w_start"), "w_end")


    def bounds(self, trips: DataFrame) -> tuple[Column, Column]:
        """(start, end) as scalar columns, for queries over a window."""
        window = self.window(trips)
        return window.select("w_start").scalar(), window.select("w_end").scalar()

    def instant(self, trips: DataFrame) -> Column:
        """The window's end, for queries at an instant."""
        return self.bounds(trips)[1]


def filter_trips(trips: DataFrame, lines: list[str] | None = None, direction: int | None = None) -> DataFrame:
    """Optional line and direction filters; None keeps everything."""
    if lines is not None:
        trips = trips.where(F.col("lineid").isin(lines))
    if direction is not None:
        trips = trips.where(F.col("direction") == direction)
    return trips


def latest_end(trips: DataFrame) -> Column:
    """The newest trip end as a scalar subquery."""
    return trips.agg(F.max("end_ts")).scalar()
