"""Distinct counts by sketches that are kept in a table and merged, so that no level is counted from the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of a sketch's buckets. The relative standard error is about 0.83 / sqrt(buckets): 1.3 per cent.
LOG_BUCKETS = 12
ERROR = 0.8326 / 2 ** (LOG_BUCKETS / 2)


def sketched(df: DataFrame, keys: list[str], item: str, name: str = "sketch") -> DataFrame:
    """A sketch of item's distinct values for each key; nulls don't count. A few kB a key at most, made where the rows are."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, LOG_BUCKETS).alias(name))


def merged(sketches: DataFrame, keys: list[str], name: str = "sketch") -> DataFrame:
    """Sketches of finer keys merged to coarser ones, none of them for all."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg(name).alias(name))


def estimated(sketches: DataFrame, name: str = "sketch", to: str = "n_distinct") -> DataFrame:
    return sketches.withColumn(to, F.hll_sketch_estimate(name)).drop(name)


def within(estimate, exact, deviations: float = 4.0):
    """Whether an estimate lies within so many standard errors of a count; small counts may be one off."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), deviations * ERROR * exact)
