"""Functions in Python on odd rows, and statistics that change a plan."""

import uuid

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strata import inspection
from strata.functions import columns, udfs


def test_masks_agree(spark):
    df = spark.createDataFrame([(None,), ("",), ("123456",), ("1234567",), ("é2345678",), ("x" * 1000,)], "p string")
    both = df.select(columns.mask_phone(F.col("p")).alias("a"), udfs.mask_phone_py("p").alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] == [None, "****", "****", "123****67", "é23****78", "xxx****xx"]


def test_zscores_of_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", 2.0), ("c", 2.0), ("d", None), (None, 1.0), (None, 2.0)], "k string, x double")
    got = sorted(((r.k, r.x, None if r.z is None else round(r.z, 4)) for r in udfs.zscores(df, "k", "x").collect()), key=repr)
    assert got == sorted([("a", 1.0, -0.7071), ("a", 3.0, 0.7071), ("a", None, None), ("b", 5.0, 0.0), ("c", 2.0, 0.0), ("c", 2.0, 0.0), ("d", None, None), (None, 1.0, -0.7071), (None, 2.0, 0.7071)], key=repr)
    assert udfs.zscores(df.limit(0), "k", "x").isEmpty()
    with pytest.raises(PythonException, match="3 rows"):
        udfs.zscores(df, "k", "x", most=2).collect()


def test_words_beside_rows(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, None), (1, "a b  c")], "k int, t string")
    got = sorted((r.k, r.word, r.place) for r in udfs.with_words(df, "t").collect())
    assert got == sorted([(1, "a", 0), (1, "b", 1), (1, "c", 2)] * 2)
    assert sorted(r.k for r in udfs.with_words(df, "t", keep_empty=True).where("word IS NULL").collect()) == [2, 3]


def test_models_are_loaded_once_a_task(spark, tmp_path):
    def load():
        (tmp_path / uuid.uuid4().hex).touch()
        return lambda f: f.assign(y=f.x * 2)

    got = udfs.score_partitions(spark.range(40_000).withColumnRenamed("id", "x").repartition(3), load, "x long, y long")
    assert got.agg(F.sum("y")).collect()[0][0] == 40_000 * 39_999
    assert len(list(tmp_path.iterdir())) == 3


def test_statistics_change_the_join_order(spark, tmp_path):
    run = uuid.uuid4().hex[:8]
    big, middle, small = (f"{n}_{run}" for n in ("big", "middle", "small"))
    ids = spark.range(20_000)
    ids.select((F.col("id") % 100).alias("m"), (F.col("id") % 5000).alias("s"), "id").write.parquet(f"{tmp_path}/big")
    ids.select((F.col("id") % 100).alias("mk"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/middle")
    spark.range(5000).select(F.col("id").alias("sk"), (F.col("id") % 1000).alias("tag")).write.parquet(f"{tmp_path}/small")
    try:
        for t in (big, middle, small):
            spark.sql(f"CREATE TABLE {t} USING parquet LOCATION '{tmp_path}/{t.split('_')[0]}'")
        by_cost = inspection.planned_by_cost(spark)
        query = f"SELECT count(*) FROM {big} JOIN {middle} ON m = mk JOIN {small} ON s = sk WHERE tag = 7"
        assert inspection.join_order(by_cost.sql(query)) == [big, middle, small]
        for t, cols in ((big, ["m", "s", "id"]), (middle, ["mk", "v"]), (small, ["sk", "tag"])):
            inspection.analyze(spark, t, cols)
        by_cost = inspection.planned_by_cost(spark)
        after = inspection.join_order(by_cost.sql(query))
        assert set(after[:2]) == {big, small} and after[2] == middle  # the few rows of the small table go first
        assert inspection.join_order(spark.sql(query)) == [big, middle, small]  # the caller's session plans as before
        assert by_cost.sql(query).collect() == spark.sql(query).collect()
        got = {r.column: (r.low, r.high, r.n_nulls) for r in inspection.statistics(spark, small, ["sk", "tag"]).collect()}
        assert got == {"sk": ("0", "4999", 0), "tag": ("0", "999", 0)}
    finally:
        for t in (big, middle, small):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
