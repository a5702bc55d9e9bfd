import pytest

from docsift.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import pyspark.sql

    pyspark.sql.SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    s = local_session(4, partitions=4, name="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
