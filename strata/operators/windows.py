"""Windows: latest rows, top n, running and rolling figures, ranks without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], ties: list[str] | None = None) -> DataFrame:
    """The last row of each key by the order columns; ties, which should make the order total, settle equal ones.

    Written as an aggregate, so that a hot key is reduced before the shuffle and never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*(F.col(c) for c in [*order, *(ties or [])]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def top_n_share(df: DataFrame, group: str, item: str, value: Column, n: int) -> DataFrame:
    """The n largest items of each group with their share of the group's total."""
    sums = df.groupBy(group, item).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(group)
    ranked = sums.select(group, item, "total", F.row_number().over(w.orderBy(F.desc("total"), item)).alias("place"), (F.col("total") / F.sum("total").over(w)).alias("share"))
    return ranked.where(F.col("place") <= n)


def running_total(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(w))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def rolling_days(df: DataFrame, keys: list[str], day: str, n: int, aggregate: Column, name: str) -> DataFrame:
    """An aggregate over the last n calendar days, this one included, gaps or not."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-(n - 1), 0)
    return df.withColumn(name, aggregate.over(w))


def rolling_rows(df: DataFrame, keys: list[str], order: list[str], n: int, aggregate: Column, name: str) -> DataFrame:
    """An aggregate over the last n rows, this one included."""
    return df.withColumn(name, aggregate.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)))


def period_change(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """The change against the period before, and as a share of it."""
    last = F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    return df.withColumns({"previous": last, "change": F.col(value) - last, "change_share": (F.col(value) - last) / F.nullif(last, F.lit(0))})


def purchase_gaps(df: DataFrame, customer: str, day: str, tie: str) -> DataFrame:
    """A customer's orders in turn, and the days since the one before."""
    w = Window.partitionBy(customer).orderBy(day, tie)
    return df.withColumns({"nth": F.row_number().over(w), "gap_days": F.datediff(F.col(day), F.lag(day).over(w))})


def rank_within(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """All ranks over one window."""
    w = Window.partitionBy(group).orderBy(F.desc(value))
    return df.withColumns({"row_number": F.row_number().over(w.orderBy(F.desc(value), tie)), "rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w)})


def global_rank(df: DataFrame, column: str, tie: str, name: str = "place", n: int | None = None) -> DataFrame:
    """row_number over the whole frame, largest first, without one task for all: rows are dealt out by ranges, ranked
    within each, and moved by the number of rows in the ranges before. Ranges are sampled, so the dealt rows are written
    once: dealt out anew for the counts, they could fall into other ranges."""
    ranged = df.repartitionByRange(*([n] if n else []), F.desc(column), F.col(tie)).sortWithinPartitions(F.desc(column), tie).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(before, "_part").withColumn(name, F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def ranks_in_groups(df: DataFrame, group: list[str], value: str, tie: list[str], n: int | None = None) -> DataFrame:
    """df with row_number, rank and dense_rank within groups, largest value first, like rank_within(), but a group of any size is
    spread over tasks: rows are dealt by ranges of (group, value, tie) and ranked within each range; a group's ranges, a row each, then tell by
    how much. A value may go on over several ranges. Null groups are one group, null values come last."""
    order = [*(F.col(c) for c in group), F.desc(value), *(F.col(c) for c in tie)]
    ranged = df.repartitionByRange(*([n] if n else []), *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")  # once: dealt out anew, rows could fall into other ranges
    own = Window.partitionBy("_part", *group).orderBy(F.desc(value))
    local = ranged.withColumns({"_rank": F.rank().over(own), "_dense": F.dense_rank().over(own), "_row": F.row_number().over(own.orderBy(F.desc(value), *tie))})
    local = cut(local, "local")
    # a row for each group and range
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col("_rank").alias("r")), "_row")
    each = local.groupBy(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.max("_dense").alias("_values"), F.min_by(F.struct(F.col(value).alias("v")), "_row").alias("_first"), last.alias("_last"))
    parts = Window.partitionBy(*(f"_g{k}" for k in range(len(group)))).orderBy("_p")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    goes_on = F.lag(F.lit(True), 1, False).over(parts) & F.col("_first.v").eqNullSafe(F.lag("_last.v").over(parts))
    each = each.withColumns({"_before": before, "_goes_on": goes_on})
    # where the last value of a range began; a range that only goes on with one doesn't know
    each = each.withColumn("_began", F.when(~(F.col("_goes_on") & (F.col("_values") == 1)), F.col("_before") + F.col("_last.r")))
    moves = each.withColumns({
        "_begun": F.when(F.col("_goes_on"), F.last("_began", ignorenulls=True).over(earlier)),
        "_values_before": F.coalesce(F.sum("_values").over(earlier), F.lit(0)) - F.sum(F.col("_goes_on").cast("int")).over(parts.rowsBetween(Window.unboundedPreceding, 0)),
    })
    moves = moves.select(*(f"_g{k}" for k in range(len(group))), "_p", "_before", "_begun", "_values_before")
    on = [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group))]
    rank = F.when((F.col("_rank") == 1) & F.col("_begun").isNotNull(), F.col("_begun")).otherwise(F.col("_rank") + F.col("_before"))
    return local.join(moves, on).select(*df.columns, (F.col("_row") + F.col("_before")).alias("row_number"), rank.alias("rank"), (F.col("_dense") + F.col("_values_before")).alias("dense_rank"))


def zscore_outliers(df: DataFrame, group: str, column: str, bound: float = 3.0) -> DataFrame:
    """Rows further than bound standard deviations from their group's mean."""
    stats = df.groupBy(group).agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    z = (F.col(column) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return df.join(stats, group).withColumn("z", z).where(F.abs("z") > bound).drop("_mean", "_sd")
