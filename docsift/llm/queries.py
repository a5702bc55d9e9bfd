"""The registered queries of this package: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import oracles
from docsift.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard_join": oracles.OP6, "op7_phrase_dedup": oracles.OP7, "op9_benchmark_decontamination": oracles.OP9, "op11_centroid_clustering": oracles.k_means_sql(), "op13_merkle_manifest": oracles.OP13}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.decontamination import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every row whose id is divisible by 100, among all rows."""
    from docsift.llm.topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE_SQL["op1_exact_topk"] = """
with codes as (
  select vec_id, list_reduce(list_prepend(0::ubigint, [case when embedding[i] > 0 then (1::ubigint << (i - 1)::ubigint) else 0::ubigint end for i in range(1, 65)]), lambda a, b: a | b) as code
  from embeddings where embedding is not null),
pairs as (
  select q.vec_id as query_id, v.vec_id, bit_count(xor(q.code, v.code))::int as distance
  from codes q, codes v where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, distance from ranked where rank <= 10
"""


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docsift.llm.suffix_dedup import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docsift.llm.phrase_dedup import without_repeats

    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.clustering import k_means

    return k_means(table(spark, sf_dir, "embeddings"))


@query
def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docsift.llm.retrieval_packing import pack_by_retrieval

    return pack_by_retrieval(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
