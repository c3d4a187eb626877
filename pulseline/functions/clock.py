"""Service days: lines whose id starts with N turn over at local midnight,
all others at 03:30 local, so that one night of operation stays together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Brussels"
DAY_SHIFT_MINUTES = 210


def service_day(lineid: Column, start_ts: Column, zone: str = ZONE,
                shift_minutes: int = DAY_SHIFT_MINUTES) -> Column:
    local = F.from_utc_timestamp(start_ts, zone)
    shifted = local - F.make_dt_interval(mins=F.lit(shift_minutes))
    return F.to_date(F.when(lineid.startswith("N"), local).otherwise(shifted))
