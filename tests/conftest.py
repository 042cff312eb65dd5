import pytest

from strata.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("test", **{"spark.master": "local[4]", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
