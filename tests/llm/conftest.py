import pytest

from . import cases


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], cases.DOCS)
