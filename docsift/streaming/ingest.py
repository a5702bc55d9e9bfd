"""Streaming extraction: the same expressions over a stream of texts, written by batch so that a repeated batch changes nothing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.receipts import parse_receipt
from docsift.functions.text import clean_line


def receipt_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_at_once: int = 100) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return extracted(rows)


def extracted(rows: DataFrame) -> DataFrame:
    """(doc_id, receipt), for streams and tables alike. Lines are cleaned one by one, as line breaks carry the receipt's structure."""
    lines = F.array_join(F.transform(F.split("text", "\n"), clean_line), "\n")
    return rows.select("doc_id", parse_receipt(lines).alias("receipt"))


def write_receipts(stream: DataFrame, path: str, checkpoint: str):
    """Each batch goes to a folder of its own, which a repeated batch overwrites."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
