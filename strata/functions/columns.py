"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(column: Column, bounds: list[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that the value reaches, from the highest down."""
    out = F.lit(default)
    for bound, label in sorted(bounds):
        out = F.when(column >= bound, F.lit(label)).otherwise(out)
    return out


def not_equal_or_null(column: Column, value) -> Column:
    return (column != value) | column.isNull()


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def map_columns(df: DataFrame, fn: Callable[[Column], Column], columns: list[str]) -> DataFrame:
    """fn over many columns in one projection."""
    return df.select(*(fn(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def cast_all(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Casts that give null where a value has no such form."""
    return df.select(*(F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns))


def cast_losses(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """column and lost: values that a cast turns into null."""
    one = df.agg(*(F.count(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), 1)).alias(c) for c, t in casts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("lost")) for c in casts))).alias("x")).select("x.*")


def surrogate_key(*columns: str) -> Column:
    """A key from business keys; null differs from every text."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def hash_diff(*columns: str) -> Column:
    """Changes when any of the tracked columns does."""
    return surrogate_key(*columns)


def mask_phone(column: Column) -> Column:
    """First three and last two characters; shorter ones are hidden whole; null stays."""
    return F.when(F.length(column) >= 7, F.concat(F.substring(column, 1, 3), F.lit("****"), F.substring(column, -2, 2))).when(column.isNotNull(), F.lit("****"))


def haversine_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance to a point."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def clean_status(column: Column) -> Column:
    """Text without space around it, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def parsed_date(column: Column, *formats: str) -> Column:
    """The date by the first format that fits; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(column, F.lit(f)) for f in formats)).cast("date")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end; null where one is missing or the end comes first."""
    days = F.datediff(end, start)
    return F.when(days >= 0, days)
