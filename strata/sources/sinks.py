"""Writers: idempotent partitioned writes, layouts, compaction, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", codec: str | None = None, sort_by: list[str] | None = None, range_by: list[str] | None = None, n_files: int | None = None, coalesce: int | None = None, max_records: int | None = None, **options) -> None:
    """mode: overwrite (the only one that a retry leaves alike), append, errorifexists, ignore. sort_by sorts within
    files, so that row groups can be skipped; range_by orders files among themselves. options are the format's own."""
    if range_by:
        df = df.repartitionByRange(*([n_files] if n_files else []), *range_by)
    elif n_files:
        df = df.repartition(n_files)
    elif coalesce:
        df = df.coalesce(coalesce)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if codec:
        writer = writer.option("compression", codec)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.options(**options).save(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], files_per_key: int = 1, by: str | None = None, max_records: int = 0, mode: str = "overwrite", overwrite: str = "dynamic") -> None:
    """One file for each key's folder, or files_per_key, dealt by a hash of column `by`, for keys with very many rows.
    overwrite: dynamic replaces only the folders that df has rows for, static the whole table."""
    deal = [*keys] if files_per_key == 1 else [*keys, F.pmod(F.crc32(F.col(by).cast("string").cast("binary")), F.lit(files_per_key))]
    df.repartition(*deal).write.mode(mode).option("partitionOverwriteMode", overwrite).option("maxRecordsPerFile", max_records).partitionBy(*keys).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the partitions that df has rows for and no others."""
    write_partitioned(df, path, keys)


def rebuild(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces the whole table."""
    write_partitioned(df, path, keys, overwrite="static")


def write_dim(df: DataFrame, path: str) -> None:
    """A small dimension, in one file."""
    write_table(df, path, mode="overwrite", coalesce=1)


def write_quarantine(df: DataFrame, reason: str | Column, path: str) -> None:
    """Appends rejected rows with the reason."""
    df.withColumn("quarantine_reason", F.lit(reason) if isinstance(reason, str) else reason).write.mode("append").parquet(path)


def split_by_day(df: DataFrame, path: str, day: Column) -> None:
    """A folder of CSV for each day."""
    df.withColumn("dt", day).repartition("dt").write.mode("overwrite").partitionBy("dt").option("header", True).csv(path)


def force(df: DataFrame) -> None:
    """Reads every column of every row and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and rows of each file of a Parquet table."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def compact(spark: SparkSession, path: str, to: str, keys: list[str], target_bytes: int, sort_by: list[str] | None = None) -> None:
    """The same rows in files of about target_bytes (in each key's folder, if there are keys), sorted within; written
    beside the old table."""
    df = spark.read.option("basePath", path).parquet(path)
    if keys:
        # files of a key by its bytes; rows are dealt over them by a hash. A null key is a key like any other
        each = df.select(*keys, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")).distinct()
        n = each.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(F.ceil(F.sum("_size") / target_bytes).cast("int").alias("_files"))
        salt = F.pmod(F.xxhash64(*df.columns), F.col("_files")).alias("_salt")
        total = n.agg(F.sum("_files")).collect()[0][0] or 1  # a given number of partitions is not merged at run time
        same_key = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        df = df.join(n, same_key).select(*df.columns, salt).repartition(2 * total, *keys, "_salt").drop("_salt")
    else:
        size = file_stats(spark, path).agg(F.sum("bytes")).collect()[0][0] or 0
        df = df.repartition(max(1, -(-size // target_bytes)), *(sort_by or []))
    df = df.sortWithinPartitions(*keys, *(sort_by or [])) if keys or sort_by else df
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(to)


def choose_grain(df: DataFrame, date_col: str, total_bytes: int, target_bytes: int) -> str:
    """The finest of day, month and year at which a partition has target_bytes on average; else none."""
    d = F.col(date_col)
    n = df.agg(*(F.countDistinct(F.date_trunc(g, d)).alias(g) for g in ("day", "month", "year"))).collect()[0]
    return next((g for g in ("day", "month", "year") if n[g] and total_bytes / n[g] >= target_bytes), "none")


def partition_transform(column: str, spec: str) -> Column:
    """A partition key from a column: identity, years, months, days, hours, bucket(n) or truncate(w)."""
    name, _, size = spec.rstrip(")").partition("(")
    c = F.col(column)
    if name == "bucket":
        return F.pmod(F.hash(c), F.lit(int(size)))
    if name == "truncate":
        return F.substring(c.cast("string"), 1, int(size))
    if name == "identity":
        return c
    return F.date_format(c, {"years": "yyyy", "months": "yyyy-MM", "days": "yyyy-MM-dd", "hours": "yyyy-MM-dd-HH"}[name])


def prune_filter(df: DataFrame, column: str, partition: str, spec: str, low, high) -> DataFrame:
    """low <= column < high, with the same bounds on the derived partition column, which the scan can prune by."""
    c, p = F.col(column), F.col(partition)
    bound = {"years": "yyyy", "months": "yyyy-MM", "days": "yyyy-MM-dd", "hours": "yyyy-MM-dd-HH"}[spec]
    at = lambda x: F.date_format(F.lit(x).cast("timestamp_ntz"), bound)
    return df.where((c >= F.lit(low).cast("timestamp_ntz")) & (c < F.lit(high).cast("timestamp_ntz")) & (p >= at(low)) & (p <= at(high)))
