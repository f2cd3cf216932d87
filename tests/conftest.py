import pytest

from tidewheel.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    s.sparkContext.setLogLevel("ERROR")
    return s
