"""Change data: latest change per key, upserts and deletes, slowly changing dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import hash_diff
from strata.operators.joins import assert_unique, missing_null_safe
from strata.operators.windows import latest_per_key

OPEN_END = "9999-12-31"


def parse_changes(df: DataFrame, column: str, row: T.StructType) -> DataFrame:
    """before, after, op, ts_ms and source of an envelope in JSON. Tombstones (null) are dropped."""
    source = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("lsn", T.LongType()), T.StructField("table", T.StringType())])
    envelope = T.StructType([T.StructField("before", row), T.StructField("after", row), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("source", source)])
    return df.where(F.col(column).isNotNull()).select(F.from_json(F.col(column).cast("string"), envelope).alias("e")).select("e.*").where("op IS NOT NULL")


def flatten_changes(df: DataFrame) -> DataFrame:
    """The row (before a delete, else after), op, ts_ms of the source and lsn."""
    return df.select(F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")).alias("r"), "op", F.col("source.ts_ms").alias("ts_ms"), F.col("source.lsn").alias("lsn")).select("r.*", "op", "ts_ms", "lsn")


def last_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key by source time and log position."""
    return latest_per_key(changes, keys, ["ts_ms", "lsn"])


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """target after changes: deletes go, updates replace, inserts come; a delete of an unknown key does nothing.
    Applying the same changes once more changes nothing."""
    last = last_changes(changes, keys)
    return missing_null_safe(target, last, keys).unionByName(last.where("op <> 'd'").select(*target.columns))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """updates, one row a key, replace or join the target; several rows a key are refused, unless the caller knows that
    there are none. Null keys are one key."""
    if check:
        assert_unique(updates, keys)
    return missing_null_safe(target, updates, keys).unionByName(updates.select(*target.columns))


def current_state(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a change log describes."""
    return last_changes(changes, keys).where("op <> 'd'").drop("op", "ts_ms", "lsn")


def delete_where(target: DataFrame, condition) -> DataFrame:
    """target without the rows for which the condition is true; null is not true."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def scd1_apply(dim: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes are overwritten where a hash of them differs; keys that staged lacks stay."""
    tracked = [c for c in dim.columns if c not in keys]
    old = dim.select(*keys, hash_diff(*tracked).alias("_old"))
    fresh = staged.withColumn("_new", hash_diff(*tracked)).join(old, keys, "left").where(~F.col("_new").eqNullSafe(F.col("_old")))
    return upsert(dim, fresh.select(*dim.columns), keys)


def scd2_apply(dim: DataFrame, staged: DataFrame, keys: list[str], tracked: list[str], effective) -> DataFrame:
    """A staged snapshot against a dimension with valid_from, valid_to and is_current: current rows whose tracked
    columns differ are closed at `effective` and opened anew, new keys are opened, all others stay as they are."""
    at, end = F.lit(effective).cast("date"), F.lit(OPEN_END).cast("date")
    now = staged.select(*keys, *tracked).withColumn("_new", hash_diff(*tracked))
    old = dim.where("is_current").select(*keys, hash_diff(*tracked).alias("_old"))
    fresh = now.join(old, keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).select(*keys, *tracked)
    closed = fresh.select(*keys).withColumn("_closed", F.lit(True))
    kept = dim.join(closed, keys, "left").withColumn("_closed", F.coalesce("_closed", F.lit(False)) & F.col("is_current"))
    kept = kept.withColumn("valid_to", F.when(F.col("_closed"), at).otherwise(F.col("valid_to"))).withColumn("is_current", F.col("is_current") & ~F.col("_closed")).drop("_closed")
    return kept.unionByName(fresh.withColumns({"valid_from": at, "valid_to": end, "is_current": F.lit(True)}).select(*dim.columns))


def scd2_from_changes(changes: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """The whole history that a change log describes: each change opens a version at its time that the next one
    closes; deletes open none. Repeated changes count once, so that a replay adds nothing."""
    from pyspark.sql import Window

    once = latest_per_key(changes, [*keys, "ts_ms"], ["lsn"])
    w = Window.partitionBy(*keys).orderBy("ts_ms")
    marked = once.withColumn("valid_to", F.lead("ts_ms").over(w)).where("op <> 'd'")
    return marked.select(*keys, *tracked, F.col("ts_ms").alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def scd3_apply(dim: DataFrame, staged: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column takes the staged value, and previous_<column> the one it had, where they differ."""
    previous = f"previous_{column}"
    new = staged.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_there"))
    base = dim if previous in dim.columns else dim.withColumn(previous, F.lit(None).cast(dim.schema[column].dataType))
    both = base.join(new, keys, "full_outer")
    differs = F.coalesce("_there", F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_new"))
    return both.withColumns({previous: F.when(differs, F.col(column)).otherwise(F.col(previous)), column: F.when(differs, F.col("_new")).otherwise(F.col(column))}).drop("_new", "_there")


def check_scd2(history: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with other than one open version at most, or with versions that overlap."""
    from pyspark.sql import Window

    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    marked = history.withColumn("_overlap", F.coalesce(F.col("valid_to") > following, F.lit(False)))
    return marked.groupBy(*keys).agg(F.count(F.when(F.col("is_current"), 1)).alias("open"), F.count(F.when(F.col("_overlap"), 1)).alias("overlaps")).where("open > 1 OR overlaps > 0")


def dim_date(spark, low: str, high: str) -> DataFrame:
    """A row for each day with its parts."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias("date"))
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "week": F.weekofyear}
    return days.select(F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", *(f("date").alias(k) for k, f in parts.items()), (F.dayofweek("date").isin(1, 7)).alias("is_weekend"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
