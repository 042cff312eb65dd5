"""Counts of tokens over a corpus, and per-document sums of a value that each distinct token has.

The values of all distinct tokens are a table of unbounded size. Its most frequent HEAD tokens, of at most
HEAD_TOKEN_BYTES each, go to every task (so 200,000 x 64 bytes and their values at most); the rest of a document's
tokens, a tenth of them in natural text, meet the table in a shuffle join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_TOKEN_BYTES = 200_000, 64
#: A task hands on its counts when it holds so many tokens.
HELD_TOKENS = 400_000


def token_counts(docs: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """token (binary) and n, how often it occurs in all texts; combined in each task before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from strata.llm.shared import utf8

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                counts.update(split(text))
            if len(counts) > HELD_TOKENS:
                yield out()
                counts = Counter()
        if counts:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head(values: DataFrame, order: str, names: list[str]) -> dict[bytes, tuple]:
    """The values of the most frequent tokens: of all those above a frequency that HEAD tokens at most exceed, so that
    no more than these ever reach the driver."""
    short = values.where(F.length("token") <= HEAD_TOKEN_BYTES).withColumn("_bin", F.floor(F.log2(F.col(order)) * 16).cast("int"))
    left, least = HEAD, None
    for r in short.groupBy("_bin").agg(F.count("*").alias("k")).orderBy(F.desc("_bin")).collect():  # 1,024 rows at most
        left -= r["k"]
        if left < 0:
            break
        least = r["_bin"]
    if least is None:
        return {}
    rows = short.where(F.col("_bin") >= least).select("token", *names).toPandas()
    return dict(zip(map(bytes, rows["token"]), zip(*(rows[c] for c in names), strict=True), strict=True))


def sums(docs: DataFrame, start: Callable[[dict[bytes, int]], Callable], values: DataFrame, order: str, names: list[str], extra: list[str], absent: dict[str, Column] | None = None) -> DataFrame:
    """For each row of docs: doc_id, `extra`, and the sum over its tokens of each column in `names` of `values`.

    start() runs once in a task, with the places of the head's tokens, and returns a function from a list of texts to, for
    each of them, its tokens, their places (-1: none; or None, and they are looked up here) and the numbers of `extra`. A token that isn't in the table has the values of `absent`, expressions over
    the column `token`, or else zero. Every row of docs counts by itself, whatever its doc_id.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(head(values, order, names))
    k = len(names)
    doubles = [f"_s{i}" for i in range(k)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from strata.llm.shared import utf8

        place = {w: i for i, w in enumerate(known.value)}
        of = start(place)
        # the last row is for tokens without a place, which have -1
        each = np.array([*known.value.values(), (0.0,) * k], dtype=np.float64)
        task, row = TaskContext.get().partitionId() << 33, 0
        columns = ["_row", "doc_id", *extra, *doubles, "token", "_n"]
        for batch in batches:
            texts = utf8(batch.column(1))
            numbers, sure, rest, tokens_n, many = [], [], [], [], []
            for tokens, at, more in of(texts):
                if at is None:
                    at = np.fromiter(map(place.get, tokens, repeat(-1)), np.int64, len(tokens))
                far = Counter(map(tokens.__getitem__, np.flatnonzero(at < 0).tolist()))
                numbers.append(more)
                sure.append(each[at].sum(axis=0))
                rest.extend(far)
                tokens_n.extend(far.values())
                many.append(len(far))
            rows = np.arange(task + row, task + row + len(texts))
            row += len(texts)
            # of each document a row with what is known, whose token no text has, and one for each token that is left
            first = [*np.array(numbers, dtype=np.float64).reshape(-1, len(extra)).T, *np.array(sure).reshape(-1, k).T]
            marks = [b"\x00row%d" % x for x in rows.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), *map(pa.array, first), pa.array(marks, pa.binary()), pa.array(np.zeros(len(rows), dtype=np.int64))], names=columns)
            if rest:
                none = [pa.nulls(len(rest), pa.float64())] * len(extra) + [pa.array(np.zeros(len(rest)))] * k
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, many)), pa.nulls(len(rest), pa.int64()), *none, pa.array(rest, pa.binary()), pa.array(tokens_n, pa.int64())], names=columns)

    kinds = ", ".join(["_row long", "doc_id long", *(f"{c} double" for c in [*extra, *doubles]), "token binary", "_n long"])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)
    met = rows.join(values.select("token", *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names))), "token", "left")
    other = lambda c: (absent or {}).get(c, F.lit(0.0))
    total = [F.sum(F.col(f"_s{i}") + F.col("_n") * F.coalesce(F.col(f"_v{i}"), other(c))).alias(c) for i, c in enumerate(names)]
    return met.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), *(F.max(c).alias(c) for c in extra), *total).drop("_row")
