"""A keyed table in buckets: a row lives in the bucket of its key's hash, and a manifest names each bucket's folder.

A merge rewrites the buckets that its rows fall into; all others keep their files. Manifests are versioned, so that readers
see the table before a merge or after it, and old ones can be read until their files are vacuumed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.windows import latest_per_key
from strata.session import cut
from strata.sources import versions

MANIFEST = "bucket int, of int, folder string"


def bucket_of(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """bucket, of (the number of buckets) and folder; a bucket without rows has none."""
    return versions.read_version(spark, f"{root}/manifest", version)


def read_buckets(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets. LookupError if there is no such version."""
    rows = manifest(spark, root, version)
    rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    folders = [r["folder"] for r in rows.collect()]  # a row for each bucket
    if not folders:
        raise LookupError(f"no such rows under {root}")
    return spark.read.parquet(*folders)


def lookup(spark: SparkSession, root: str, key: dict) -> DataFrame:
    """The row of one key, from its bucket alone."""
    of = manifest(spark, root).agg(F.max("of")).collect()[0][0]
    row = spark.createDataFrame([tuple(key.values())], spark_schema(spark, root, list(key)))
    bucket = row.select(bucket_of(list(key), of)).collect()[0][0]
    try:
        found = read_buckets(spark, root, buckets=[bucket])
    except LookupError:
        return read_buckets(spark, root).limit(0)
    return found.where(reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items())))


def spark_schema(spark: SparkSession, root: str, columns: list[str]):
    return read_buckets(spark, root).select(*columns).schema


def published(spark: SparkSession, root: str, note: str) -> bool:
    return not versions.history(spark, f"{root}/manifest").where(F.col("note") == note).isEmpty()


def merge_buckets(rows: DataFrame, root: str, keys: list[str], order: list[str], n: int = 64, note: str = "") -> int:
    """Merges rows into the table, of each key the last by `order`, and returns how many buckets were rewritten.

    n: the number of buckets of a new table; an old one keeps its own. A note that was published before is left out, so that the
    replay of a batch changes nothing. Null keys are one key. One writer at a time."""
    spark = rows.sparkSession
    if note and published(spark, root, note):
        return 0
    try:
        old = {r["bucket"]: (r["of"], r["folder"]) for r in manifest(spark, root).collect()}
    except LookupError:
        old = {}
    n = next(iter(old.values()))[0] if old else n
    # a key's rows are reduced before they are dealt to buckets: a hot key is one row there
    last = cut(latest_per_key(rows, keys, order).withColumn("_bucket", bucket_of(keys, n)), "merge")
    touched = [r[0] for r in last.select("_bucket").distinct().collect()]  # n at most
    if not touched and not old:
        return 0
    folder = f"{root}/data/{uuid.uuid4().hex}"
    if touched:
        if mine := [old[b][1] for b in touched if b in old]:
            before = spark.read.parquet(*mine)
            last = before.withColumn("_bucket", bucket_of(keys, n)).unionByName(last.select(*before.columns, "_bucket"))
        # dealt by bucket, which is all that the aggregate asks for
        merged = latest_per_key(last.repartition("_bucket"), ["_bucket", *keys], order)
        merged.withColumnRenamed("_bucket", "bucket").write.partitionBy("bucket").parquet(folder)
    now = old | {b: (n, f"{folder}/bucket={b}") for b in touched}
    versions.publish(spark.createDataFrame([(b, of, at) for b, (of, at) in sorted(now.items())], MANIFEST).coalesce(1), f"{root}/manifest", note)
    return len(touched)


def rebucket(spark: SparkSession, root: str, keys: list[str], n: int) -> None:
    """The same rows in n buckets, for a table that has outgrown its own."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    read_buckets(spark, root).withColumn("bucket", bucket_of(keys, n)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    buckets = [r[0] for r in spark.read.parquet(folder).select("bucket").distinct().collect()]  # n at most
    versions.publish(spark.createDataFrame([(b, n, f"{folder}/bucket={b}") for b in sorted(buckets)], MANIFEST).coalesce(1), f"{root}/manifest", f"{n} buckets")


def vacuum(spark: SparkSession, root: str, retain_last: int = 1) -> int:
    """Deletes bucket folders that none of the last few manifests names, and says how many. Not beside a writer."""
    last = [r["version"] for r in versions.history(spark, f"{root}/manifest").orderBy(F.desc("version")).limit(retain_last).collect()]
    kept = {r["folder"].rstrip("/") for v in last for r in manifest(spark, root, v).collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(f"{root}/data")
    fs, gone = top.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for write in fs.listStatus(top) if fs.exists(top) else []:
        for each in fs.listStatus(write.getPath()):
            name = f"{root}/data/{write.getPath().getName()}/{each.getPath().getName()}"
            if each.isDirectory() and name not in kept:
                gone += fs.delete(each.getPath(), True)
    return gone
