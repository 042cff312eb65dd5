"""Joins: existence, point in time, ranges, fan-out guards, and hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side is sent to all executors only below this many bytes, as counted from its files or given by the caller.
BROADCAST_BYTES = 64 << 20


class DuplicateKeys(Exception):
    """A lookup side has several rows for a key."""


def join(a: DataFrame, b: DataFrame, on, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """strategy: broadcast, merge or shuffle_hash; none leaves it to Spark. Broadcast is for sides of a known bound."""
    return a.join(b.hint(strategy) if strategy else b, on, how)


def exists_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_semi")


def missing_from(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys), keys, "left_anti")


def join_null_safe(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Null keys match each other."""
    other = b.withColumnRenamed(key, f"_{key}")
    return a.join(other, F.col(key).eqNullSafe(F.col(f"_{key}")), how).drop(f"_{key}")


def missing_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a whose key b lacks; null keys match each other."""
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys))
    return a.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with low <= point < high. Both sides are cut into cells of a width and meet by cell, so no pair of rows
    from different cells is ever formed; width should be near the usual length of a range."""
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    a = points.withColumn("_cell", F.floor(F.col(point) / width))
    b = ranges.where(F.col(high) > F.col(low)).withColumn("_cell", F.explode(cells))
    return a.join(b, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def join_scd2(fact: DataFrame, dim: DataFrame, key: str, ts: str, how: str = "left") -> DataFrame:
    """Each fact with the version of its dimension that held at ts: valid_from <= ts < valid_to."""
    d = dim.withColumnRenamed(key, "_key")
    return fact.join(d, (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("valid_from")) & (F.col(ts) < F.col("valid_to")), how).drop("_key")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no key has several rows."""
    if found := duplicate_keys(df, keys).limit(5).collect():
        raise DuplicateKeys(str(found))
    return df


def salted_join(big: DataFrame, dim: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """A join whose hot keys are dealt over n tasks: big's rows by a hash of the whole row, dim's rows n times."""
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(n)).cast("int")
    each = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return big.withColumn("_salt", salt).join(each, [key, "_salt"], how).drop("_salt")


def hot_cold_join(big: DataFrame, dim: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join; the rows of a few named hot keys, whose side of dim is small, skip the shuffle."""
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(dim.where(is_hot))  # rows of len(hot) keys of a lookup table
    return big.where(is_hot).join(few, key).unionByName(big.where(~is_hot).join(dim.where(~is_hot), key))


def inherit_column(child: DataFrame, parent: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Children with a column of their parent, and the orphans."""
    out = child.join(parent.select(key, column), key, "left")
    return out.where(F.col(column).isNotNull()), out.where(F.col(column).isNull()).drop(column)


def enrich(items: DataFrame, orders: DataFrame, order_key: tuple[str, str], dims: list[tuple[DataFrame, str, str]], where: Column | None = None) -> DataFrame:
    """Items with their orders, filtered early, and then with each dimension (frame, key in items, key in dimension)."""
    out = items.join(orders if where is None else orders.where(where), F.col(order_key[0]) == F.col(order_key[1]))
    for dim, left, right in dims:
        out = out.join(dim, F.col(left) == F.col(right))
    return out


def referential_report(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """For each (name, child, foreign key, parent, key): rows, orphans and their percentage."""
    parts = []
    for name, child, fk, parent, pk in relations:
        known = parent.select(F.col(pk).alias("_pk")).distinct().withColumn("_known", F.lit(True))
        row = child.join(known, F.col(fk) == F.col("_pk"), "left").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("_known").isNull(), 1)).alias("orphans"))
        parts.append(row.select(F.lit(name).alias("relation"), "n_rows", "orphans", F.round(100 * F.col("orphans") / F.col("n_rows"), 4).alias("percent")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
