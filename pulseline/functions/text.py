"""Text rules of the feeds: aliases, number grammar, colours, ISO times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
WHOLE = r"^[+-]?\d+$"
ISO_DATE_HEAD = r"^\d{4}-\d{2}-\d{2}"


def first_filled(*candidates: Column) -> Column:
    """First value that is neither NULL nor empty text; "0" counts as filled."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def to_double(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(NUMBER) | t.rlike(NOT_FINITE), t.try_cast("double"))


def to_int(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(WHOLE), t.try_cast("int"))


def to_instant(text: Column) -> Column:
    """ISO text to TIMESTAMP; texts without an offset are UTC (session zone)."""
    t = F.trim(text)
    return F.when(t.rlike(ISO_DATE_HEAD), t.try_cast("timestamp"))


def colour(raw: Column) -> Column:
    bare = F.regexp_replace(F.trim(raw), "^#+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), F.upper(bare)))


def float_text(value: Column) -> Column:
    """A double in the shortest plain form: 34.0, 0.0005, 1e+16, 5e-05."""
    raw, size = value.cast("string"), F.abs(value)
    # Some JVMs print 16 or 17 digits where fewer already name the same double.
    fifteen, sixteen = F.format_string("%.14e", value), F.format_string("%.15e", value)
    short = (
        F.when(F.length(raw) <= 16, F.lower(raw)).when(fifteen.cast("double") == value, fifteen)
        .when(sixteen.cast("double") == value, sixteen).otherwise(F.lower(raw))
    )
    plain = F.regexp_replace(
        F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_replace(F.substring_index(short, "e", 1), "0+$", ""), r"\.$", "")
    power = F.substring_index(short, "e", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (
        F.when(value.isNull(), None)
        .when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when((value == 0) | ((size >= 1e-3) & (size < 1e7) & (F.length(raw) <= 16)), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def first_truthy(parsed: Column, *names: str) -> Column:
    """Of a parsed JSON object (variant), the first field that is neither null,
    empty, zero nor false, as text; the last field counts whatever it holds. A
    quoted "0" is not empty, a bare 0 is."""
    def filled(name: str) -> Column:
        raw = F.try_variant_get(parsed, f"$.{name}", "string")
        quoted = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "STRING"
        return F.when(~((raw == "") | (~quoted & raw.isin("0", "0.0", "false", "[]", "{}"))), raw)

    return F.coalesce(*[filled(n) for n in names[:-1]], F.try_variant_get(parsed, f"$.{names[-1]}", "string"))
