"""Ranks, running values and medians of groups of any size: groups are cut into ranges of their order, so that none has to be sorted in one task.

Rows are dealt into ranges by Spark's own sampling and written as a table in the shared folder, since ranges must be the same wherever they are used; a group of a third of all rows has a third of the ranges.
What is carried from range to range is a row for each group and range. Rows that are equal in keys and order are parted by their place in the input, so
that they are cut into ranges like others; they follow one another in any order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.session import kept

#: A running value: how rows are summed up within a range, and how that is added to what came before.
SUM = (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + own)
MAX = (F.max, lambda before, own: F.greatest(before, own))


def ranged(rows: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, Column], descending: bool = False) -> DataFrame:
    """A written table (row, keys, o0, o1, ..., range, and values): all of rows' columns stand in one, so that names can't clash. Null keys are keys of their own; nulls come first, or last if descending."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    way = F.desc if descending else F.asc
    dealt = rows.select(F.struct("*").alias("row"), F.struct(F.lit(0).alias("all"), *keys).alias("keys"), *(o.alias(f"o{i}") for i, o in enumerate(order)), F.monotonically_increasing_id().alias(f"o{len(order)}"), *(v.alias(n) for n, v in values.items()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(dealt.repartitionByRange(parts, "keys", *(way(f"o{i}") for i in range(len(order) + 1))).withColumn("range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: list[str], order: list[Column | str], value: Column, how: tuple, upto: str, total: str | None = None, descending: bool = False, itself: bool = True) -> DataFrame:
    """rows with upto, the running value of their keys in this order, with the row itself or only what is before it, and total, over all rows of the keys."""
    (agg, combine), n = how, len([*order])
    dealt = ranged(rows, keys, order, {"amount": value}, descending)
    way = F.desc if descending else F.asc
    all_, before = Window.partitionBy("keys"), Window.partitionBy("keys").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("keys", "range").agg(agg("amount").alias("own"))
    sums = sums.select("keys", "range", agg("own").over(before).alias("before"), agg("own").over(all_).alias("total"))
    within = Window.partitionBy("keys", "range").orderBy(*(way(f"o{i}") for i in range(n + 1))).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    own = dealt.select("row", "keys", "range", agg("amount").over(within).alias("within"))
    out = own.join(sums, ["keys", "range"])
    return out.select("row.*", combine(F.col("before"), F.col("within")).alias(upto), *([F.col("total").alias(total)] if total else []))


def accumulated(rows: DataFrame, keys: list[str], order: list[Column | str], amount: Column, upto: str, total: str, descending: bool = False) -> DataFrame:
    """rows with upto (the sum of amount over rows of the same keys up to and with this one) and total (over all rows of the keys)."""
    return running(rows, keys, order, amount, SUM, upto, total, descending)


def medians(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(keys, metric, n, nulls, mean, median) of each number by keys, exact; a row for each name in values. rows are read once and counted by value; groups of nulls have null means and medians."""
    names = [f"k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("v")) for m, v in values.items())))
    long = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), each.alias("e")).select(*names, "e.metric", "e.v")
    counts = long.groupBy(*names, "metric", "v").agg(F.count("*").alias("c"))
    some = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(F.lit(0))
    at = accumulated(counts, [*names, "metric"], ["v"], some, "upto", "total")
    reached = lambda place: F.min(F.when((F.col("upto") >= place) & (F.col("upto") > 0), F.col("v")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    out = at.groupBy(*names, "metric").agg(F.sum("c").alias("n"), (F.sum("c") - F.sum(some)).alias("nulls"), F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum(some)).alias("mean"), reached(low).alias("low"), reached(high).alias("high"))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "metric", "n", "nulls", "mean", (0.5 * F.col("low") + 0.5 * F.col("high")).alias("median"))
