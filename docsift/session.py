"""Spark session for tests, benchmarks and local use."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str | None = None, partitions: int = 8, name: str = "docsift") -> SparkSession:
    """A local session; on a cluster, build the session with the cluster's own settings instead."""
    cores = cores or os.environ.get("BENCH_CPUS", 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DOCSIFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A temporary one only for a local master that names none: executors
    of a cluster wouldn't see it, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="docsift-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df as a table below folder (the shared one, if none is given), under a name of its own: it isn't worked out again for a second reader or a lost executor. It stays until the folder is cleared."""
    spark = df.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/docsift-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
