"""Labelling as a stream of tasks: what is done is known from the checkpoint, so a run that was killed goes on where it stopped, and no task is labelled twice."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.labelling import assign_labels

TASK = "image_path string, stem string, degradation string"
DONE = "image_path string, degradation string, cer double, label string, batch long"


def task_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Tasks from files that are added to a folder; files_at_once bounds a batch, and so what a kill can cost."""
    return spark.readStream.schema(TASK).option("maxFilesPerTrigger", files_at_once).json(path)


def label_stream(tasks: DataFrame, recognise: Callable[[DataFrame], DataFrame], truth: DataFrame, path: str, checkpoint: str, ready: float = 0.05, not_ready: float = 0.20):
    """Starts labelling all tasks that are there. recognise: from tasks to (image_path, text), called with a batch at a time.

    A batch has a folder of its own under its number. A batch that was cut off has the same number and the same tasks when it is run again, so it
    replaces what it left; a folder counts only with its _SUCCESS, which is written last. A task that occurs again in a later batch keeps its first label, see written_labels.
    """
    spark = tasks.sparkSession
    path = path.rstrip("/")

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["image_path"])
        none = spark.createDataFrame([], "image_path string")
        labels = assign_labels(batch, recognise(batch), truth, none, ready=ready, not_ready=not_ready)
        labels.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tasks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of batches that are complete; a folder for each batch is listed, no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(at(path))] if files.exists(at(path)) else []
    return sorted(p.toString() for p in found if p.getName().startswith("batch=") and files.exists(at(p, "_SUCCESS")))


def written_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, degradation, cer, label, batch) of all complete batches; of a task in several of them, the first."""
    folders = whole_batches(spark, path)
    if not folders:
        return spark.createDataFrame([], DONE)
    rows = spark.read.schema(DONE).parquet(*folders)
    first = F.min_by(F.struct("degradation", "cer", "label", "batch"), F.col("batch")).alias("r")
    return rows.groupBy("image_path").agg(first).select("image_path", "r.*")
