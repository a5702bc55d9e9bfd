"""Connected components of a graph given as edges, by least labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import discard, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for each node of edges (a, b) the least node of its component.

    In each round a node takes the least label among its neighbours and itself, and then that label's label, so that chains
    shorten by half. Every round is written to the shared folder. More rounds than the limit are an error, not a cut.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumps = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = taken.join(jumps, "label").select("node", "old", F.least("label", "next").alias("label"))
        new = written(new, "labels")
        discard(labels)
        labels = new
        if new.where("old <> label").isEmpty():
            discard(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components have not settled after {rounds} rounds")
