"""The corpus pipeline: toxicity, near duplicates, repeated text, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. A stage deletes the tables that it has written on the way, and no others. All but the last return the columns that they were given. A null text counts as empty throughout; extra
columns are carried along, whatever their names.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontamination, jaccard_join, packing, suffix_dedup, toxicity
from docsift.llm.common import discard, settled, table
from docsift.llm.recurring import LARGEST

#: Near duplicates of the stage: Jaccard similarity of 0.8 or more of five-word shingles. The op6 query has its own contract (3 and 90).
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def carried(docs: DataFrame) -> DataFrame:
    """Id, text and, in one column row, the others and whether there is a text: each text is carried once."""
    others = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    return docs.select("doc_id", "text", F.struct(others.alias("others"), docs["text"].isNotNull().alias("there")).alias("row"))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from a text and what was carried along."""
    return rows.select(*((F.col("text") if c == "text" else F.col("carried.others").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    scored = toxicity.score_toxicity(carried(docs), table(spark, sf_dir, "labels"), carry="row")
    return restored(scored.where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents link by NEAR_SHINGLE and NEAR_PERCENT. Of each group of linked documents one row stays: of least id, then of least hash of its text.

    Rows of one id, or without any, are documents of their own. Rows without words link with nothing, so all of them stay.
    """
    found = settled(lambda: jaccard_join.join(docs.select("doc_id", "text"), percent=NEAR_PERCENT, size=NEAR_SHINGLE), "groups")
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LARGEST))
    heads = found.where(known("doc_id") == known("component_id")).where("n_shingles > 0 and version = component_version")
    heads = heads.groupBy(known("doc_id").alias("id"), "version").agg(F.count("*").alias("times"))
    # the documents' columns stand in one column, so that names can't clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), known("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.coalesce(F.col("text").cast("string").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False)).alias("words"))
    kept = rows.where("words").join(heads.select("id", "version"), ["id", "version"], "left_semi")
    # rows that stand twice are one group each; without any there is nothing to look for
    if not heads.where("times > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "version"])
    return kept.select("row.*").unionByName(rows.where("not words").select("row.*"))


def drop_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters all of whose bytes are covered by a string of 200 bytes that starts elsewhere too go; n_chars follows."""
    cut = suffix_dedup.without_repeats(carried(docs), whole_characters=True, carry="row")
    out = restored(cut.select(F.when(F.col("carried.there"), F.decode("kept", "UTF-8")).alias("text"), "carried"), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    found = decontamination.find_contamination(carried(docs), table(spark, sf_dir, "benchmark"), carry="row")
    return restored(found.where("not contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_text),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]
#: Learned scores, tokenizer ids and a packing plan are not to be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables of this run go when its next stage stands; those that the result reads stay until the shared folder is cleared."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
