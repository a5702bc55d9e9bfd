"""From images to receipts: preprocessing, quality gate, recognition, clean-up, parsing, as one plan around the seams."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docsift.functions import receipts
from docsift.operators import images, layout, quality, seams
from docsift.operators.preprocess import Steps, preprocess


def netpbm(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, image): grey or red, green, blue arrays as files that any image reader takes."""
    head = F.concat(F.when(F.col("channels") == 1, "P5").otherwise("P6"), F.lit("\n"), F.col("width"), F.lit(" "), F.col("height"), F.lit("\n255\n"))
    return table.select(F.col(id_col).alias("doc_id"), F.concat(F.encode(head, "UTF-8"), F.col("data")).alias("image"))


def extract(
    table: DataFrame,
    folder: str,
    engine: Callable[[], seams.Engine],
    steps: Steps | None = Steps(),
    assessed: DataFrame | None = None,
    threshold: float = 0.5,
    parser: str = "regex",
    ask: Callable[[str], str] | None = None,
    observation: Observation | None = None,
    attempts: int = 2,
    wait: float = 65.0,
) -> DataFrame:
    """(doc_id, ocr_text, quality_label, quality_score, rejected, receipt, error, seconds) of every image (doc_id, height, width, channels, data).

    Without steps images are recognised as they are. assessed (doc_id, label, score) is what a classifier says of the originals; images that the
    gate rejects are neither recognised nor parsed. parser: "regex", the rules, or "llm", which puts prompts to ask, each up to attempts times if it is refused. What fails
    anywhere gives an error, with whatever came before it. doc_id is unique. Prepared images, boxes and answers are written below folder, a shared
    one, and read from there: engines and models are the dear part, and don't run again for a lost executor or a second reader.
    """
    if parser not in PARSERS:
        raise ValueError(f"unknown parser: {parser}")
    if parser == "llm" and ask is None:
        raise ValueError("the parser llm needs ask")
    spark = table.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rejects = F.coalesce(quality.gate_rejects(F.col("quality_label"), F.col("quality_score"), threshold), F.lit(False))
    every = table.select("doc_id")
    if assessed is None:
        every = every.select("doc_id", F.lit(None).cast("string").alias("quality_label"), F.lit(None).cast("double").alias("quality_score"))
    else:
        every = every.join(assessed.select("doc_id", F.col("label").alias("quality_label"), F.col("score").cast("double").alias("quality_score")), "doc_id", "left")
    every = every.withColumn("rejected", rejects)
    wanted = table if assessed is None else table.join(every.where("not rejected").select("doc_id"), "doc_id", "left_semi")

    ready = kept(images.transformed(wanted, (lambda x: preprocess(x, steps)) if steps else (lambda x: x if x.ndim == 2 else x[..., ::-1])), "prepared")
    boxes = kept(seams.recognise(netpbm(ready.where("error is null")), engine, keep_errors=True), "boxes")
    texts = layout.document_text(boxes.where("error is null and text is not null")).withColumnRenamed("text", "ocr_text")
    broken = ready.where("error is not null").select("doc_id", "error").unionByName(boxes.where("error is not null").select("doc_id", "error"))
    took = ready.select("doc_id", F.col("seconds").alias("prepared")).join(boxes.groupBy("doc_id").agg(F.max("seconds").alias("recognised")), "doc_id", "left")
    out = every.join(texts, "doc_id", "left").join(broken, "doc_id", "left").join(took, "doc_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
    whole = ~F.col("rejected") & F.col("error").isNull()
    if parser == "regex":
        return finished(out.withColumn("receipt", F.when(whole, receipts.parse_receipt(F.col("ocr_text")))).withColumn("asked", F.lit(None).cast("double")), observation)
    answers = seams.answered_in_passes(out.where(whole).select("doc_id", receipts.prompt(F.col("ocr_text")).alias("prompt")), ask, folder, attempts, wait)
    read = answers.select("doc_id", F.when(receipts.is_object(F.col("answer")), receipts.from_model_json(F.col("answer"))).alias("receipt"), F.col("error").alias("refused"), F.col("seconds").alias("asked"))
    error = F.coalesce("error", "refused", F.when(whole & F.col("receipt").isNull(), "the answer isn't a receipt"))
    return finished(out.join(read, "doc_id", "left").withColumn("error", error), observation)


def finished(out: DataFrame, observation: Observation | None) -> DataFrame:
    """The columns of the result, with seconds by stage: null for stages that a row didn't come to, and for the rules, which are part of the plan. observation gets the sums when the result is run."""
    seconds = F.struct(F.col("prepared").alias("prepare"), F.col("recognised").alias("recognise"), F.col("asked").alias("ask"), sum((F.coalesce(c, F.lit(0.0)) for c in ("prepared", "recognised", "asked")), F.lit(0.0)).alias("total"))
    out = out.withColumn("seconds", seconds).select(*COLUMNS)
    if observation is None:
        return out
    total = [F.coalesce(F.sum(f"seconds.{k}"), F.lit(0.0)).alias(f"{k}_seconds") for k in ("prepare", "recognise", "ask", "total")]
    return out.observe(observation, F.count(F.lit(1)).alias("images"), F.count_if("rejected").alias("rejected"), F.count("error").alias("failed"), F.count("receipt").alias("parsed"), *total)


PARSERS = ("regex", "llm")
COLUMNS = ["doc_id", "ocr_text", "quality_label", "quality_score", "rejected", "receipt", "error", "seconds"]
