"""Python functions, for what built-in ones can't say: Arrow batches, never single rows in a hot path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def mask_phone_py(phone):
    """The row-wise form of columns.mask_phone, for comparison."""
    return None if phone is None else f"{phone[:3]}****{phone[-2:]}" if len(phone) >= 7 else "****"


def score_partitions(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Scores batch by batch with a model that a task loads once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        yield from map(model, batches)

    return df.mapInPandas(run, schema)


def apply_per_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each group, which must fit in a task."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


@F.pandas_udf(T.DoubleType())
def weighted_mean(value: pd.Series, weight: pd.Series) -> float:
    """An aggregate over a group, which its task holds whole; weighted_means() has no such bound."""
    total = weight.sum()
    return float((value * weight).sum() / total) if total else None


def weighted_means(df: DataFrame, keys: list[str], value: str, weight: str, name: str = "mean") -> DataFrame:
    """keys and the weighted mean of each group, however large: every Arrow batch gives its sums by group, which Spark adds up. Null where the
    weights are 0 or there are no values; a null key is a key like any other."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_value"), F.col(weight).cast("double").alias("_weight"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            v, w = (pc.if_else(pc.is_nan(batch.column(c)), None, batch.column(c)) for c in ("_value", "_weight"))  # NaN counts as null
            found = pa.table({**{k: batch.column(k) for k in keys}, "_sum": pc.multiply(v, w), "_total": w}).group_by(keys, use_threads=False).aggregate([("_sum", "sum"), ("_total", "sum")])
            yield from found.select([*keys, "_sum_sum", "_total_sum"]).rename_columns([*keys, "_sum", "_total"]).to_batches()

    double = T.DoubleType()
    sums = rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), T.StructField("_sum", double), T.StructField("_total", double)]))
    total = F.sum("_total")
    return sums.groupBy(*keys).agg(F.when(total != 0, F.sum("_sum") / total).alias(name))


@F.pandas_udf(T.DoubleType())
def haversine_km(lat: pd.Series, lon: pd.Series, lat0: pd.Series, lon0: pd.Series) -> pd.Series:
    """Great-circle distance of points in degrees; null where a coordinate is."""
    a, b, c, d = (np.radians(x.astype("float64")) for x in (lat, lon, lat0, lon0))
    h = np.sin((a - c) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((b - d) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(h.clip(0, 1)))


class GroupTooLarge(Exception):
    """A group has more rows than a task may hold."""


def zscores(df: DataFrame, key: str, column: str, most: int = 5_000_000) -> DataFrame:
    """df with z, the distance to the mean of its group in (sample) standard deviations: Arrow batches, and one group at a time in a task. 0 where the
    group's values don't differ or are one; null where the value is. A group of more than `most` rows is refused by its task; windows over
    built-in aggregates have no such bound."""

    def run(keys, group):
        import pyarrow as pa
        import pyarrow.compute as pc

        if group.num_rows > most:
            raise GroupTooLarge(f"{keys[0]}: {group.num_rows} rows")
        values = group.column(column).cast(pa.float64())
        n = len(values) - values.null_count
        deviation = pc.stddev(values, ddof=1).as_py() if n > 1 else None
        z = pc.divide(pc.subtract(values, pc.mean(values)), deviation) if deviation else pc.if_else(pc.is_valid(values), 0.0, pa.scalar(None, pa.float64()))
        return group.append_column("z", z)

    schema = T.StructType([*df.schema.fields, T.StructField("z", T.DoubleType())])
    return df.groupBy(key).applyInArrow(run, schema)


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]), useArrow=True)
class Words:
    """A table function: the words of a text with their places. A text without words, or null, gives none, or with `keep` a row of nulls:
    an outer lateral join doesn't keep rows for which a Python function gives nothing."""

    def eval(self, text: str, keep: bool):
        words = (text or "").split()
        yield from ((w, k) for k, w in enumerate(words))
        if keep and not words:
            yield None, None


def with_words(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """df beside each of its texts' words: a lateral join to the table function. keep_empty: texts without words keep a row."""
    return df.lateralJoin(Words(F.col(column).outer(), F.lit(keep_empty)))
