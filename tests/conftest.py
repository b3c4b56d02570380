import pytest

from steadfast.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_driver_memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
