import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Null, empty, repeated, long and odd texts, a null id, an id that stands twice, and clashing columns.
ODD = [(1, "one two three four five"), (2, None), (3, ""), (4, " \n\t "), (5, "one two three four five"), (5, "one two three four five"), (None, "lost words here"), (7, "x" * 20_000), (8, "word " * 9_000), (9, "É ü   ź <s> <|endoftext|> 漢字"), (10, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, rank int, n int, token string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0, 0, 0, "t") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def shuffled(spark):
    """How many bytes a function's jobs shuffle where no side of a join is small enough to go to all tasks by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def measure(run):
        store = spark.sparkContext._jsc.sc().statusStore()

        def total():
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
            return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

        start = total()
        run()
        return total() - start

    yield measure
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
