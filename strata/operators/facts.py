"""Facts against dimensions with versions: an unknown member where none holds yet, and repair when a version comes late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.columns import surrogate_key
from strata.operators.joins import join_scd2
from strata.session import cut
from strata.sources.sinks import overwrite_partitions

#: The key of the member that stands for all that are not known.
UNKNOWN = "-1"


def keyed(dim: DataFrame, key: str) -> DataFrame:
    """A dimension's versions (valid_from, valid_to) with their surrogate key, dim_key."""
    return dim.withColumn("dim_key", surrogate_key(key, "valid_from"))


def with_unknown(dim: DataFrame, key: str) -> DataFrame:
    """keyed() versions and the unknown member, whose other columns are null, so that every fact joins."""
    none = dim.sparkSession.range(1).select(*((F.lit(UNKNOWN) if c == "dim_key" else F.lit(None).cast(dim.schema[c].dataType)).alias(c) for c in dim.columns))
    return dim.unionByName(none)


def resolve(fact: DataFrame, dim: DataFrame, key: str, ts: str, name: str = "dim_key") -> DataFrame:
    """fact with the surrogate key of the version that held at ts, or the unknown member's. No row is lost or doubled as long as
    versions of a key don't overlap. dim: keyed()."""
    found = join_scd2(fact.drop(name), dim.select(key, "valid_from", "valid_to", F.col("dim_key").alias(name)), key, ts)
    return found.withColumn(name, F.coalesce(name, F.lit(UNKNOWN))).drop("valid_from", "valid_to")


def repair(spark: SparkSession, path: str, dim: DataFrame, late: DataFrame, key: str, ts: str, parts: list[str], name: str = "dim_key") -> DataFrame:
    """Resolves a partitioned fact table again where versions have come late, and returns how many rows changed, by partition.

    late: the keys of the late versions, which may stand before, between or after those that were known. Only partitions with a row
    whose version is now another one are rewritten; all others keep their files. Run again, it changes nothing."""
    fact = spark.read.option("basePath", path).parquet(path)
    # facts of the late keys alone are looked at; their new keys decide which partitions to write
    now = resolve(fact.join(late.select(key).distinct(), key, "left_semi").withColumn("_old", F.col(name)), dim, key, ts, name)
    changed = now.where(F.col("_old") != F.col(name)).groupBy(*parts).agg(F.count("*").alias("n_changed"))
    changed = cut(changed, "changed")
    touched = fact.join(changed.select(*parts), parts, "left_semi")
    # written beside the table first: a scan of files that are being replaced would lose them
    rows = cut(resolve(touched, dim, key, ts, name).select(*fact.columns), "repaired")
    overwrite_partitions(rows, path, parts)
    return changed
