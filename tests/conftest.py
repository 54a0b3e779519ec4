import pytest

from sparkloom.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from sparkloom.plans.registry import Tables

    return Tables(spark, "/root/testdata/sf0.001")
