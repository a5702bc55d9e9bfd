"""Quality labels, gates, and reports on classifiers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.metrics import ratio
from docsift.operators.ranges import MAX, accumulated, running

LABELS = ("ready", "marginal", "not_ready")


def cer_label(cer: Column, ready: float = 0.05, not_ready: float = 0.20) -> Column:
    """By the unrounded error rate; both limits are marginal."""
    return F.when(cer < ready, "ready").when(cer > not_ready, "not_ready").otherwise("marginal")


def gate_rejects(label: Column, score: Column, threshold: float = 0.5) -> Column:
    """The pipeline's gate: not_ready with a score above the threshold."""
    return (label == "not_ready") & (score > threshold)


def penalised(rejected: Column, rate: Column) -> Column:
    """Rejected rows count as wholly wrong."""
    return F.when(rejected, F.lit(1.0)).otherwise(rate)


def threshold_sweep(rows: DataFrame, thresholds=(0.0, 0.3, 0.5, 0.7), p_col: str = "p_not_ready", rate_col: str = "cer") -> DataFrame:
    """(threshold, accepted, rejected, cer): accepted are rows whose p is below the threshold; cer is their mean, 0.0 if there are none.

    One pass: a conditional aggregate for each threshold, no cross join.
    """
    p, rate = F.col(p_col), F.col(rate_col)
    sums = rows.agg(*(x for i, t in enumerate(thresholds) for x in (F.count_if(p < t).alias(f"a{i}"), F.avg(F.when(p < t, rate)).alias(f"c{i}"))), F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("accepted"), (F.col("n") - F.col(f"a{i}")).alias("rejected"), F.coalesce(f"c{i}", F.lit(0.0)).alias("cer")) for i, t in enumerate(thresholds)))
    return sums.select(F.inline(each))


def confusion(rows: DataFrame, true_col: str, pred_col: str, classes=(0, 1, 2)) -> DataFrame:
    """One row for each true class, one column for each predicted one; classes that don't occur have zeros."""
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], "true int")
    counts = rows.groupBy(F.col(true_col).cast("int").alias("true")).agg(*(F.count_if(F.col(pred_col) == c).alias(f"pred_{c}") for c in classes))
    return every.join(counts, "true", "left").fillna(0)


def confusion_shares(rows: DataFrame, true_col: str, pred_col: str, classes=(0, 1, 2)) -> DataFrame:
    """The confusion matrix with rows that sum to 1; a class that doesn't occur has zeros."""
    counts = confusion(rows, true_col, pred_col, classes)
    every = rows.groupBy(F.col(true_col).cast("int").alias("true")).agg(F.count("*").alias("every"))
    return counts.join(every, "true", "left").select("true", *(ratio(F.col(f"pred_{c}"), F.col("every")).alias(f"pred_{c}") for c in classes))


def weighted_means(batches: DataFrame, by: list[str], weight: str, values: dict[str, str]) -> DataFrame:
    """Means of batch values (name to column) by keys, each batch weighing as many samples as it has."""
    n = F.col(weight).cast("double")
    return batches.groupBy(*by).agg(*(F.try_divide(F.sum(F.col(c).cast("double") * n), F.sum(n)).alias(name) for name, c in values.items()))


def class_report(rows: DataFrame, true_col: str, pred_col: str, classes=(0, 1, 2)) -> DataFrame:
    """(class, precision, recall, f1, support), with rows for macro and weighted means and accuracy. One aggregation."""
    t, p = F.col(true_col), F.col(pred_col)
    sums = rows.agg(F.count("*").alias("n"), F.count_if(t == p).alias("right"), *(x for c in classes for x in (F.count_if((t == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"p{c}"), F.count_if(t == c).alias(f"t{c}"))))
    scores = {c: (ratio(F.col(f"tp{c}"), F.col(f"p{c}")), ratio(F.col(f"tp{c}"), F.col(f"t{c}")), ratio(2 * F.col(f"tp{c}"), F.col(f"p{c}") + F.col(f"t{c}"))) for c in classes}
    row = lambda name, values, support: F.struct(F.lit(name).alias("class"), *(v.alias(k) for k, v in zip(("precision", "recall", "f1"), values, strict=True)), support.cast("long").alias("support"))
    total = lambda values: sum(values[1:], values[0])
    macro = [total([scores[c][i] for c in classes]) / len(classes) for i in range(3)]
    weighted = [ratio(total([scores[c][i] * F.col(f"t{c}") for c in classes]), F.col("n")) for i in range(3)]
    accuracy = ratio(F.col("right"), F.col("n"))
    out = [row(str(c), scores[c], F.col(f"t{c}")) for c in classes] + [row("macro", macro, F.col("n")), row("weighted", weighted, F.col("n")), row("accuracy", [accuracy] * 3, F.col("n"))]
    return sums.select(F.inline(F.array(*out)))


def class_weights(rows: DataFrame, label_col: str, n_classes: int | None = None) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class). The total is joined as one row."""
    counts = rows.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("total") / ((F.lit(n_classes) if n_classes else F.col("k")) * F.col("n"))).alias("weight"))


def roc_auc(rows: DataFrame, positive: Column, score: Column, group: str | None = None) -> DataFrame:
    """Area under the ROC curve. Rows are summed by distinct score first; ties share a point."""
    keys = [group] if group else []
    points = rows.groupBy(*keys, score.alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    area = accumulated(points, keys, ["score"], F.col("p"), "above", "positives", descending=True)
    sums = area.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("above") - F.col("p") / 2)).alias("area"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*keys, F.try_divide(F.col("area"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def stratified_split(rows: DataFrame, label_col: str, order: list, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """With split: of each label, in the given order, the first int(n * train) rows train, the next int(n * val) validate, the rest test.

    All columns of rows are written on the way, so give those that are needed.
    """
    ranked = accumulated(rows.select(F.struct("*").alias("row"), F.col(label_col).alias("label"), *((F.col(o) if isinstance(o, str) else o).alias(f"by{i}") for i, o in enumerate(order))), ["label"], [f"by{i}" for i in range(len(order))], F.lit(1), "rank", "n")
    a, b = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(val))
    return ranked.select("row.*", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "val").otherwise("test").alias("split"))


def random_order(*keys: str, seed: int = 42) -> list[Column]:
    """An order for splits and samples: by a seeded hash, the same on every run."""
    return [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)]


def running_best(rows: DataFrame, group: str, order: list, value: str) -> DataFrame:
    """With best (the largest value so far) and is_best (whether this row set it: of equals, the earliest). A group's rows are cut into ranges of their order, and each range takes over the best of those before it."""
    found = running(rows.select(F.struct("*").alias("row"), F.col(group).alias("group"), F.col(value).alias("value"), *((F.col(o) if isinstance(o, str) else o).alias(f"by{i}") for i, o in enumerate(order))), ["group"], [f"by{i}" for i in range(len(order))], F.col("value"), MAX, "before", itself=False)
    return found.select("row.*", F.greatest("before", "value").alias("best"), (F.col("before").isNull() | (F.col("value") > F.col("before"))).alias("is_best"))
