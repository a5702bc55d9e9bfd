"""Labelling images by recognition error, so that it can go on where it stopped."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.metrics import cer
from docsift.operators.experiments import resume, statistics
from docsift.operators.quality import cer_label


def tasks(originals: DataFrame, variants: DataFrame) -> DataFrame:
    """(image_path, stem, degradation) of originals and of degraded images."""
    return originals.select("image_path", "stem", F.lit("original").alias("degradation")).unionByName(variants.select("image_path", "stem", "degradation"))


def assign_labels(todo: DataFrame, recognised: DataFrame, truth: DataFrame, done: DataFrame, limit: int | None = None, ready: float = 0.05, not_ready: float = 0.20) -> DataFrame:
    """(image_path, degradation, cer, label) of what isn't done. recognised: (image_path, text); truth: (stem, gt), blank ones are left out."""
    left = resume(todo, done, "image_path", limit)
    rows = left.join(recognised, "image_path").join(truth.where("trim(gt) <> ''"), "stem")
    rate = rows.withColumn("rate", cer(F.col("text"), F.col("gt")))
    return rate.select("image_path", "degradation", F.round("rate", 4).alias("cer"), cer_label(F.col("rate"), ready, not_ready).alias("label"))


def distribution(labels: DataFrame) -> DataFrame:
    """(label, n, share) and error statistics by degradation are what a run reports."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def error_statistics(labels: DataFrame) -> DataFrame:
    return statistics(labels, "cer", ["degradation"])
