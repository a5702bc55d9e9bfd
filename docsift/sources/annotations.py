"""Sources of the domain: annotation files, images, results, labels."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions.text import stem, strip

ANNOTATION_DDL = "valid_line array<struct<words:array<struct<text:string>>>>"
METADATA_DDL = "original string, degradation string, output string"
LABEL_DDL = "image_path string, degradation string, cer double, label string"


def annotation_words(json: Column) -> Column:
    """The stripped words of each line, without empty ones."""
    lines = F.from_json(json, ANNOTATION_DDL)["valid_line"]
    return F.coalesce(F.transform(lines, lambda x: F.filter(F.transform(x["words"], lambda w: strip(w["text"])), lambda w: w != "")), F.array().cast("array<array<string>>"))


def annotation_text(json: Column, by_lines: bool = True) -> Column:
    """Ground-truth text: words joined by blanks, lines by line breaks, without empty lines; or all words joined by blanks."""
    words = annotation_words(json)
    if by_lines:
        return F.array_join(F.filter(F.transform(words, lambda w: F.array_join(w, " ")), lambda x: x != ""), "\n")
    return F.array_join(F.flatten(words), " ")


def ground_truth(json: Column) -> Column:
    """The JSON text of gt_parse, which may be an object or a string that holds one; {} if it is missing."""
    return F.coalesce(F.get_json_object(json, "$.gt_parse"), F.lit("{}"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(stem, json) of every annotation file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("json"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(stem, extension, path, content) of image files; unreadable ones are left to the decoder's error column."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,tiff}").load(path)
    return files.select(stem(F.col("path")).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "path", "content")


def paired_samples(notes: DataFrame, files: DataFrame, limit: int | None = 20) -> DataFrame:
    """(stem, path, text): the first annotations by name, then those that have an image (png before jpg) and text."""
    chosen = notes.orderBy("stem").limit(limit) if limit else notes
    own = files.where("extension in ('png', 'jpg')").groupBy("stem").agg(F.min_by("path", F.when(F.col("extension") == "png", 0).otherwise(1)).alias("path"))
    return chosen.join(own, "stem").withColumn("text", annotation_text(F.col("json"))).where("trim(text) <> ''").select("stem", "path", "text")


def dataset_rows(spark: SparkSession, paths: list[str], split: str) -> DataFrame:
    """(split, idx, image, ground_truth) of shards; idx counts on across shards, in the shards' order."""
    from pyspark.sql import Window

    order = F.array_position(F.array(*(F.lit(p.rsplit("/", 1)[-1]) for p in paths)), F.col("_metadata.file_name"))
    rows = spark.read.parquet(*paths).select(F.lit(split).alias("split"), F.col("image.bytes").alias("image"), "ground_truth", order.alias("shard"), F.col("_metadata.row_index").alias("row"))
    first = rows.groupBy("shard").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))  # one row for each shard
    return rows.join(F.broadcast(first.select("shard", "before")), "shard").select("split", (F.col("before") + F.col("row")).alias("idx"), "image", "ground_truth")


def experiment_results(spark: SparkSession, path: str) -> DataFrame:
    """(exp, config, metric, value, ord) of a nested results file; arrays give a row for each element."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("exp", "configs")).select("exp", F.explode("configs").alias("config", "body"))
    metrics = entries.select("exp", "config", F.explode(F.from_json("body", "map<string,string>")).alias("metric", "v"))
    values = F.when(F.col("v").startswith("["), F.from_json("v", "array<double>")).otherwise(F.array(F.col("v").try_cast("double")))
    return metrics.select("exp", "config", "metric", F.posexplode(values).alias("ord", "value"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_DDL).json(path, multiLine=True)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_DDL).json(path, multiLine=True)


def upload(spark: SparkSession, content: bytes, name: str) -> DataFrame:
    """One uploaded image as a row, if its extension is one of those that are taken."""
    extension = name.rsplit(".", 1)[-1].lower()
    if extension not in ("jpg", "jpeg", "png", "bmp", "tiff"):
        raise ValueError(f"unsupported image type: {extension}")
    return spark.createDataFrame([(name, bytearray(content))], "doc_id string, image binary")
