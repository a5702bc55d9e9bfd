"""Experiments: named configurations, each a path of steps from a sample to a text or to the fields of a receipt.

Paths form a prefix tree. A step that configurations share is one node, worked out once for each sample, whatever experiments it stands in; column steps
of a subtree are one projection, and a step that needs Python or a shuffle is a table of its own. Every node that a configuration ends in is scored once. Scores are a
narrow table (sample, node, measures), from which all experiments are summed up; how many configurations there are costs rows there, not work on samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from docsift.functions import metrics
from docsift.functions.distance import text_rates_of
from docsift.operators.experiments import ordered_scores, summarise
from docsift.session import kept

#: A step from one value to the next; it may also read the sample's own columns.
Step = Callable[[Column], Column]


class Table(NamedTuple):
    """A step on a table (sample, value) that gives such a table: recognition, a language model. Samples that it leaves out have a null value."""

    run: Callable[[DataFrame], DataFrame]


class Config(NamedTuple):
    """A path of steps. gate: "penalty" counts rejected samples as wholly wrong; "below" leaves out those whose p isn't below the threshold."""

    path: tuple[str, ...]
    gate: str | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class Experiment:
    title: str
    configs: dict[str, Config]


#: The order in which steps of preprocessing are done; blur is always among them.
ORDER = ("detect", "deskew", "bilateral", "clahe", "blur", "threshold")


def prepared(*steps: str) -> tuple[str, ...]:
    return tuple(s for s in ORDER if s in steps or s == "blur")


FULL = prepared("detect", "deskew", "bilateral", "clahe")
READ, OTHER, PARSE = ("paddleocr",), ("tesseract",), ("regex",)


def catalogue(thresholds=(0.0, 0.3, 0.5, 0.7)) -> dict[str, Experiment]:
    """The thirteen experiments. Their names and those of their configurations, under which results are merged."""
    full = Config(FULL + READ)
    read = lambda *steps: Config(prepared(*steps) + READ)
    return {
        "exp1": Experiment("Preprocessing vs No Preprocessing", {"No Preprocessing": Config(READ), "Full Preprocessing": full}),
        "exp2": Experiment("CLAHE vs No CLAHE", {"Without CLAHE": read("detect", "deskew", "bilateral"), "With CLAHE": full}),
        "exp3": Experiment("Adaptive Threshold", {"Without Adaptive Threshold": full, "With Adaptive Threshold": read("detect", "deskew", "bilateral", "clahe", "threshold")}),
        "exp4": Experiment("Deskew On vs Off", {"Without Deskew": read("detect", "bilateral", "clahe"), "With Deskew": full}),
        "exp5": Experiment("Ablation Study", {"None": Config(READ), "Document Detection Only": read("detect"), "Det + Deskew": read("detect", "deskew"), "Det + Deskew + CLAHE": read("detect", "deskew", "clahe"), "Full Pipeline": full}),
        "exp6": Experiment("PaddleOCR vs Tesseract", {"PaddleOCR": full, "Tesseract": Config(FULL + OTHER)}),
        "exp7": Experiment("CNN Quality Filter", {"No Filter": full, "With CNN Filter": full._replace(gate="penalty")}),
        "exp8": Experiment("CNN Rejection Thresholds", {f"Threshold={t}" if t > 0 else "No Filter": Config(full.path, "below", t) for t in thresholds}),
        "exp9": Experiment("Regex vs LLM", {"Regex": Config(full.path + PARSE), "LLM (Gemini)": Config((*full.path, "llm"))}),
        "exp10": Experiment("LLM Zero-shot vs Few-shot", {"Zero-shot": Config((*full.path, "llm")), "Few-shot": Config((*full.path, "llm_few_shot"))}),
        "exp11": Experiment("GT Text vs Real OCR", {"Ground Truth Text": Config(("truth", *PARSE)), "Real OCR": Config(full.path + PARSE)}),
        "exp12": Experiment("Full Pipeline vs Naive", {"Naive (raw OCR)": Config(READ + PARSE), "Full Pipeline": Config(full.path + PARSE)}),
        "exp13": Experiment("Different Resolutions", {"25% (low)": Config(("quarter", *full.path)), "50% (medium)": Config(("half", *full.path)), "100% (original)": full}),
    }


# --- the tree -------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A step after the path of its parent. ends: whether a configuration ends here, so that the node is scored."""

    path: tuple[str, ...] = ()
    ends: bool = False
    children: dict[str, Node] = field(default_factory=dict)

    def nodes(self) -> Iterator[Node]:
        yield self
        for c in self.children.values():
            yield from c.nodes()


def tree(experiments: dict[str, Experiment]) -> Node:
    root = Node()
    for path in dict.fromkeys(c.path for e in experiments.values() for c in e.configs.values()):
        at = root
        for i, step in enumerate(path):
            at = at.children.setdefault(step, Node(path[: i + 1]))
        at.ends = True
    return root


def name(path: tuple[str, ...]) -> str:
    return "/" + "/".join(path)


def projected(rows: DataFrame, root: Node, steps: dict[str, Step | Table]) -> tuple[DataFrame, list[Node], list[Node]]:
    """rows (sample, value and the sample's columns) with a column for each node that column steps lead to from root, in one pass; those nodes; and the nodes whose next step is a table."""
    column = {root.path: "value"}
    level, reached, waiting = [root], [root], []
    while level:
        below = [c for n in level for c in n.children.values()]
        own = [c for c in below if not isinstance(steps[c.path[-1]], Table)]
        waiting += [c for c in below if isinstance(steps[c.path[-1]], Table)]
        for c in own:
            column[c.path] = f"at_{len(column)}"
        if own:
            rows = rows.select("*", *(steps[c.path[-1]](F.col(column[c.path[:-1]])).alias(column[c.path]) for c in own))
        reached += own
        level = own
    return rows.withColumnsRenamed({column[n.path]: name(n.path) for n in reached}), reached, waiting


TEXT_SCORES, FIELD_SCORES = ("cer", "wer"), ("f1", "anls", "total_em")
SCORE = "struct<node:string,skipped:boolean,cer:double,wer:double,f1:double,anls:double,total_em:double,failed:boolean>"


def scored(value: Column, rates: Column | None, read: Column, node: str, total: str = "total.total_price") -> Column:
    """A node's scores: of fields, or by the rates of a text. Fields that couldn't be had (null) count 0 each; a sample without a text at all (read) is left out."""
    none = F.lit(None).cast("double")
    found = metrics.field_scores(value, F.col("gt_fields"), total) if rates is None else None
    each = {k: rates[k] if rates is not None else none for k in TEXT_SCORES} | {k: found[k] if found is not None else none for k in FIELD_SCORES}
    there = read.isNotNull()
    parts = {"node": F.lit(node), "skipped": ~there} | {k: F.when(there, v) for k, v in each.items()} | {"failed": (there & found["failed"]) if found is not None else F.lit(False)}
    return F.struct(*(v.alias(k) for k, v in parts.items())).cast(SCORE)


def scores(samples: DataFrame, steps: dict[str, Step | Table], experiments: dict[str, Experiment], folder: str | None = None) -> DataFrame:
    """(sample, p, rejects, node, skipped, cer, wer, f1, anls, total_em, failed): a row for each sample and scored node.

    samples: sample (unique), value (what paths start from), gt (text), gt_fields (a map), p (of not being ready) and rejects (whether the gate turns the sample away).
    A text that stands before parsed fields is scored as well. A table step's result is written below folder before it is read.
    """
    root = tree(experiments)
    missing = sorted({n.path[-1] for n in root.nodes() if n.path} - set(steps))
    if missing:
        raise ValueError(f"no such steps: {', '.join(missing)}")
    own = ["sample", "gt", "gt_fields", "p", "rejects"]
    out, todo = None, [(samples, root, None)]
    while todo:
        rows, at, text_of = todo.pop()
        rows, reached, waiting = projected(rows, at, steps)
        kinds = rows.schema
        is_fields = {n.path: isinstance(kinds[name(n.path)].dataType, MapType) for n in reached}
        texts, fields = {}, {}
        for n in reached:
            # fields stand on the last text of their path
            before = n.path[:-1] if is_fields[n.path] else n.path
            text = F.col(f"`{name(before)}`") if before in is_fields else F.col(text_of)
            if n.ends:
                if is_fields[n.path]:
                    fields[name(n.path)] = text
                if before in is_fields:
                    texts[name(before)] = text
        if texts or fields:
            rates = text_rates_of([*texts.values()], F.col("gt")) if texts else []
            each = [scored(t, r, t, k) for (k, t), r in zip(texts.items(), rates, strict=True)] + [scored(F.col(f"`{k}`"), None, t, k) for k, t in fields.items()]
            # the outer form, as explode would have Spark work out the whole array once more, only to see that it isn't empty
            found = rows.select("sample", "p", "rejects", F.array(*each).alias("all")).select("sample", "p", "rejects", F.explode_outer("all").alias("s")).select("sample", "p", "rejects", "s.*")
            out = found if out is None else out.unionByName(found)
        for n in waiting:
            value = F.col(f"`{name(n.path[:-1])}`")
            made = kept(steps[n.path[-1]].run(rows.select("sample", value.alias("value"))), "step", folder).select("sample", F.col("value").alias("made"))
            joined = samples.drop("value").join(rows.select("sample", value.alias("before")), "sample").join(made, "sample", "left").withColumnRenamed("made", "value")
            todo.append((joined, n, "before"))
    return out if out is not None else samples.select(*own[:1], *own[3:], F.explode(F.array().cast(f"array<{SCORE}>")).alias("s")).select("sample", "p", "rejects", "s.*")


# --- results --------------------------------------------------------------------------------------------------------


def results(samples: DataFrame, steps: dict[str, Step | Table], experiments: dict[str, Experiment] | None = None, folder: str | None = None, arrays: bool = False) -> DataFrame:
    """(exp, config, n, skipped, rejected, failed, cer_mean, cer_median, wer_mean, wer_median, f1_mean, anls_mean, total_em) of every configuration.

    n: samples that have a text; rejected: of them, those that the gate turns away; failed: those without fields. Means over no samples are null, but 0.0
    for a threshold that accepts none. With arrays also cer_scores, wer_scores and f1_scores by sample, for sample sets that fit a row.
    """
    experiments = experiments or catalogue()
    spark = samples.sparkSession
    each = kept(scores(samples, steps, experiments, folder), "scores", folder)
    is_fields = {r["node"] for r in each.where("f1 is not null").select("node").distinct().collect()}  # as many rows as nodes
    named, views = [], {}
    for exp, e in experiments.items():
        for config, c in e.configs.items():
            fields = name(c.path) if name(c.path) in is_fields else None
            view = (name(c.path[:-1] if fields else c.path), c.gate, c.threshold)
            named.append((exp, config, views.setdefault(view, len(views)), fields))
    known = spark.createDataFrame([(v, *k) for k, v in views.items()], "view int, node string, gate string, threshold double")
    # views and names are made on the driver, a row for each configuration at most
    rows = each.where("not skipped").join(F.broadcast(known), "node")
    away = F.when(F.col("gate") == "penalty", F.coalesce("rejects", F.lit(False))).when(F.col("gate") == "below", F.coalesce(F.col("p") >= F.col("threshold"), F.lit(True))).otherwise(F.lit(False))
    rows = rows.withColumn("away", away)
    gated = lambda c: F.when(~F.col("away"), F.col(c)).when(F.col("gate") == "penalty", 1.0)
    rows = rows.select("sample", "view", "away", gated("cer").alias("cer"), gated("wer").alias("wer"))
    text = summarise(rows, ["view"], list(TEXT_SCORES)).join(F.broadcast(rows.groupBy("view").agg(F.count_if("away").alias("rejected"))), "view")
    fields = each.where("not skipped and f1 is not null").groupBy(F.col("node").alias("fields")).agg(F.count_if("failed").alias("failed"), *(F.avg(m).alias(f"{m}_mean") for m in FIELD_SCORES))
    skipped = each.where("skipped").groupBy("node").agg(F.count("*").alias("skipped"))
    if arrays:
        text = text.join(ordered_scores(rows, ["view"], "sample", "cer").withColumnRenamed("scores", "cer_scores"), "view").join(ordered_scores(rows, ["view"], "sample", "wer").withColumnRenamed("scores", "wer_scores"), "view")
        fields = fields.join(ordered_scores(each.where("not skipped and f1 is not null"), ["node"], "sample", "f1").select(F.col("node").alias("fields"), F.col("scores").alias("f1_scores")), "fields")
    out = spark.createDataFrame(named, "exp string, config string, view int, fields string").join(known, "view").join(text, "view", "left").join(fields, "fields", "left").join(skipped, "node", "left")
    empty = F.when(F.col("gate") == "below", 0.0)
    more = [c for c in ("cer_scores", "wer_scores", "f1_scores") if arrays]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("exp", "config", zero("n"), zero("skipped"), zero("rejected"), zero("failed"), F.coalesce("cer_mean", empty).alias("cer_mean"), "cer_median", F.coalesce("wer_mean", empty).alias("wer_mean"), "wer_median", "f1_mean", "anls_mean", F.col("total_em_mean").alias("total_em"), *more)


def nested(rows: DataFrame) -> DataFrame:
    """One row for each experiment: exp, and its configurations as a map from their name to their figures, as results files have them."""
    body = F.struct(*(c for c in rows.columns if c not in ("exp", "config")))
    return rows.groupBy("exp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", body.alias("figures"))))).alias("configs"))


def chosen(numbers: str, experiments: dict[str, Experiment] | None = None) -> dict[str, Experiment]:
    """The experiments of a list like "1,5,13". An unknown number is an error."""
    experiments = experiments or catalogue()
    names = [f"exp{int(x)}" for x in numbers.split(",") if x.strip()]
    if unknown := [n for n in names if n not in experiments]:
        raise ValueError(f"no such experiment: {', '.join(unknown)}")
    return {n: experiments[n] for n in names}


