"""Deterministic identities: the same observation always gets the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseline.functions.text import float_text


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def ping_id(lineid: Column, direction: Column, pointid: Column,
            fetched_at_text: Column, distance: Column) -> Column:
    """Hash of the five identity fields; the time enters as the text received."""
    return _digest(lineid, direction, pointid, fetched_at_text,
                   F.coalesce(float_text(distance), F.lit("None")))


def trip_id(first_position_id: Column) -> Column:
    """A trip is named after its first ping, so a rebuild keeps its ids."""
    return _digest(F.lit("local"), first_position_id)


def vehicle_uuid(first_position_id: Column) -> Column:
    return _digest(F.lit("vehicle"), first_position_id)
