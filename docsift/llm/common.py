"""What the operators of this package share: reading, cutting lineage, batches as bytes."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


#: The tables that the run in hand has written so far: runs nest, and each context (so each thread) has its own.
running: ContextVar[list[DataFrame] | None] = ContextVar("running", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: later readers don't recompute it, and lost executors cost nothing.

    It belongs to the run in hand (settled()), which deletes it in the end; without a run it stays until the folder is cleared.
    """
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark).rstrip('/')}/docsift-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")  # once the table stands, its shuffle files are of no use
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(tidy, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (own := running.get()) is not None:
        own.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again. Deleting one twice does nothing."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make gives, as a written table, when the tables that make has written on the way are deleted: those and no others.

    They are deleted if it fails, too. make hands out nothing but what it returns, so that no one else can read them.
    """
    token = running.set(own := [])
    try:
        out = written(make(), label)
    except BaseException:
        running.reset(token)
        discard(*own)
        raise
    running.reset(token)
    discard(*own[:-1])  # all but out
    if (outer := running.get()) is not None:
        outer.append(out)
    return out


@cache
def trim():
    """The C library's function that gives free memory back, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def tidied(run):
    """run, a function of batches, which gives back what it has freed when it ends: workers are used again, and idle ones count too."""

    @wraps(run)
    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim()(0)

    return own


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20):
    """The batch in pieces of about limit bytes of the given string column, so that memory doesn't depend on row length."""
    sizes = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)
