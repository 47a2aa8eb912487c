import pytest

from wattline.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "wattline-tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="3",
        spark__default__parallelism="3",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="10000",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
