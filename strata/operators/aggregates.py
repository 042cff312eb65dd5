"""Aggregates beyond one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_sum(df: DataFrame, rows: list[str], column: str, values: list, value: Column) -> DataFrame:
    """Sums by named values of a column, which spares the job that would look for them; 0 where there are none."""
    return df.groupBy(*rows).agg(*(F.coalesce(F.sum(F.when(F.col(column) == v, value)), F.lit(0)).alias(str(v)) for v in values))


def rollup_levels(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Totals of all levels, with grouping_id as `level`."""
    return df.rollup(*keys).agg(F.grouping_id().alias("level"), *aggregates)


def approx_distinct(df: DataFrame, keys: list[str], column: str, rsd: float = 0.05) -> DataFrame:
    return df.groupBy(*keys).agg(F.approx_count_distinct(column, rsd).alias(f"approx_{column}"))


def salted_agg(df: DataFrame, keys: list[str], n: int, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Groups by key and salt first, then by key: for aggregates that Spark doesn't combine before its shuffle, such
    as collected sets, over hot keys. final is over the names of partial."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    part = df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*(c.alias(k) for k, c in partial.items()))
    return part.groupBy(*keys).agg(*(c.alias(k) for k, c in final.items()))


def lateness_quantiles(df: DataFrame, event: str, arrival: str, accuracy: int = 10_000) -> DataFrame:
    """p50, p99 and p999 of the seconds between event and arrival, from which a watermark's delay is chosen."""
    late = F.col(arrival).cast("timestamp").cast("double") - F.col(event).cast("timestamp").cast("double")
    return df.agg(*(F.percentile_approx(late, q, accuracy).alias(n) for n, q in (("p50", 0.5), ("p99", 0.99), ("p999", 0.999))))


def hot_keys(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The most frequent keys with their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.orderBy(F.desc("n"), *keys).limit(n).crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


def partition_health(df: DataFrame) -> DataFrame:
    """Rows of each partition, against the mean."""
    each = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_rows"))
    return each.agg(F.count("*").alias("partitions"), F.sum("n_rows").alias("n_rows"), F.avg("n_rows").alias("mean"), F.stddev_pop("n_rows").alias("deviation"), F.max("n_rows").alias("largest"), (F.max("n_rows") / F.avg("n_rows")).alias("max_to_mean"))


def replicate(df: DataFrame, n: int, key: str, day: str | None = None, shift_days: int = 0) -> DataFrame:
    """Every row n times, with keys of its own, and each copy so many days later than the one before: for tests at scale."""
    out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(key, F.concat(F.col(key).cast("string"), F.lit("-"), F.col("_copy")))
    return (out.withColumn(day, F.date_add(F.col(day), F.col("_copy") * shift_days)) if day else out).drop("_copy")


def inject_skew(df: DataFrame, key: str, share: float, value) -> DataFrame:
    """A share of the rows, chosen by hash, gets one key."""
    return df.withColumn(key, F.when(F.pmod(F.xxhash64(*df.columns), F.lit(10_000)) < int(share * 10_000), F.lit(value)).otherwise(F.col(key)))
