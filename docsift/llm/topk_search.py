"""Exact top-k by Hamming distance with incremental multi-index hashing, in DataFrame operations.

Codes are the signs of an embedding. A code is cut into segments of about log2(number of distinct codes) bits, at most 20. In round r
a query probes each segment's index at distance r exactly. Codes within distance m*(r+1)-1 are then all found, m being the
number of segments; a query is done once its k-th verified distance is no more than that.

Equal codes are one entry with its k smallest ids, and equal queries are searched once, so a frequent code is no larger
bucket than any other.

Null embeddings have no code: they are neither found nor asked for. A null element counts as not positive. Ties in
distance go to the smaller id. Ids that occur twice are found once for each code. Fewer than k rows: all of them.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import written


def sign_code(embedding, bits: int = 64):
    """Bit i is set where element i is positive; bits beyond 64 are not coded."""
    return F.when(embedding.isNotNull(), F.aggregate(F.transform(F.slice(embedding, 1, min(bits, 64)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def segments(code, m: int, bits: int):
    """(segment, value) of each of m segments of nearly equal size."""
    cuts = [round(i * bits / m) for i in range(m + 1)]
    value = lambda a, b: F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*(F.struct(F.lit(i).alias("segment"), value(a, b).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def flips(spark, sizes: list[int], r: int) -> DataFrame:
    """(size, flip): for each size of segment the values with r bits set. At most 2^20 rows, and far fewer in early rounds, however many codes there are."""
    each = [spark.range(1 << size).where(F.bit_count("id") == r).select(F.lit(size).alias("size"), F.col("id").alias("flip")) for size in sorted(set(sizes))]
    return reduce(DataFrame.unionByName, each)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query its k nearest codes, itself among them if it is a row of vectors."""
    spark = vectors.sparkSession
    codes = vectors.select(F.col(id_col).cast("long").alias("vec_id"), sign_code(F.col(vector_col), bits).alias("code")).where("vec_id is not null and code is not null").distinct()
    first = Window.partitionBy("code").orderBy("vec_id")
    entries = codes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = written(entries, "codes")
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), sign_code(F.col(vector_col), bits).alias("query")).where("query_id is not null and query is not null").distinct()
    asked = written(asked, "queries")
    size = entries.count()
    m = max(1, min(bits, math.ceil(bits / min(20, max(4, round(math.log2(max(size, 2))))))))
    sizes = [round((i + 1) * bits / m) - round(i * bits / m) for i in range(m)]
    widest = max(sizes)
    index = written(entries.select("code", "ids", F.inline(segments(F.col("code"), m, bits))), "segments")
    open_, done, best = asked.select("query").distinct(), [], None
    for r in range(widest + 1):
        own = open_.select("query", F.inline(segments(F.col("query"), m, bits))).withColumn("size", F.element_at(F.array(*map(F.lit, sizes)), F.col("segment") + 1))
        probes = own.join(F.broadcast(flips(spark, sizes, r)), "size").select("query", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        found = probes.join(index, ["segment", "value"]).select("query", "code", "ids", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int").alias("distance"))
        if best is not None:
            found = found.unionByName(best)
        nearest = Window.partitionBy("query").orderBy("distance", F.element_at("ids", 1), "code")
        found = found.dropDuplicates(["query", "code"]).withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k).drop("at")
        found = written(found, f"round{r}")
        covered = m * (r + 1) - 1
        state = found.groupBy("query").agg(F.sum(F.when(F.col("distance") <= covered, F.size("ids")).otherwise(0)).alias("sure"))
        state = written(open_.join(state, "query", "left").select("query", (F.coalesce("sure", F.lit(0)) >= k).alias("over")), f"state{r}")
        done.append(found.join(state.where("over"), "query", "left_semi"))
        open_ = state.where(~F.col("over")).select("query")
        best = found.join(open_, "query", "left_semi")
        if r == widest or open_.isEmpty():
            done.append(best)
            break
    results = reduce(DataFrame.unionByName, done).select("query", "distance", F.explode("ids").alias("vec_id"))
    results = results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return asked.join(results, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")
