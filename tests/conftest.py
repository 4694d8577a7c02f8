import pytest

from panelforge.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
