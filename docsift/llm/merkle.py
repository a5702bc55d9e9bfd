"""A Merkle manifest of a table: one digest for all rows, and for each row a proof that it is under it.

Rows of a language, by id, are the leaves of a binary tree; the languages' roots are the leaves of another. Leaves are cut
into aligned blocks of BLOCK, a power of two. A task traverses its block in post-order: each subtree gives back its digest, and
while the recursion unwinds, each sibling is appended to the proofs of the leaves below the other. Block roots are the leaves of the
next traversal, which is distributed in the same way, until every language has one root. Proofs are completed from the top:
a block's leaves share all that stands above its root.

Places come from ranges of the order, counted apart, so no language is sorted in one task. A block's height doesn't depend on how many
leaves the last block has: where a node has no sibling it is hashed alone, as the tree has it.

Nulls: any value may be null and is written as -. A null id comes first and is never tampered with; a null language is one of its own and comes first.
Ties: rows of one id are ordered by their leaves, so that the digests don't depend on the order of the input; equal rows have equal
leaves and each its own proof. Long and empty texts are hashed whole. Empty table: no rows. Extra columns are left out, whatever their names.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import discard, written

BLOCK = 1024
#: Rows of a range of the order: about 200 bytes each.
RANGE_ROWS = 200_000
#: Up to so many trees, a few hundred bytes each, what stands above them is broadcast; more are joined by a shuffle.
FEW_TREES = 10_000


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """- for null, else the length in bytes, a colon, and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def traversed(leaves: list[str], height: int) -> tuple[str, list[list[str]]]:
    """The digest of a subtree of this height and, for each leaf, its siblings from below: < or > for the side, then the digest; empty where there is none."""
    proofs: list[list[str]] = [[] for _ in leaves]

    def subtree(first: int, height: int) -> str:
        if not height:
            return leaves[first]
        middle, after = first + (1 << height - 1), first + (1 << height)
        left = subtree(first, height - 1)
        if middle >= len(leaves):
            for proof in proofs[first:]:
                proof.append("")
            return digest(left)
        right = subtree(middle, height - 1)
        for proof in proofs[first:middle]:
            proof.append(f">{right}")
        for proof in proofs[middle:after]:
            proof.append(f"<{left}")
        return digest(left, right)

    return subtree(0, height), proofs


def folded(leaf: Column, proof: Column) -> Column:
    """The digest at the top of a proof, which is a string of siblings, each ended by a comma."""
    step = lambda below, s: F.when(s == "", F.sha2(below.cast("binary"), 256)).when(s.startswith("<"), F.sha2(F.concat(F.substr(s, F.lit(2)), below).cast("binary"), 256)).otherwise(F.sha2(F.concat(below, F.substr(s, F.lit(2))).cast("binary"), 256))
    steps = F.slice(F.split(proof, ","), 1, F.size(F.split(proof, ",")) - 1)
    return F.aggregate(steps, leaf, step)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes, a written table with a column tree, with at (the place within the tree by order) and total (the tree's nodes).

    Ranges of the order are written, then counted; a range of a tree is what a task sorts.
    """
    n = max(1, -(-nodes.count() // RANGE_ROWS), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = written(nodes.repartitionByRange(n, "tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("tree", "range").agg(F.count("*").alias("n"))
    own = Window.partitionBy("tree")
    before = counts.select(F.col("tree").alias("t"), F.col("range").alias("r"), (F.sum("n").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    within = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    found = ranges.withColumn("within", within).join(before, F.col("tree").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
    return found.withColumn("at", F.col("before") + F.col("within")).drop("range", "t", "r", "before", "within")


def traversal(nodes: DataFrame, kept: list[str], label: str, block: int) -> DataFrame:
    """A written table: nodes (tree, at, total, digest, and the columns kept) with block, proof within the block, and in its first row the block's root."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    columns = ["tree", "at", "total", "digest", *kept]
    source = nodes.select(*columns, F.floor(F.col("at") / block).alias("block"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        total = table["total"][0].as_py()
        root, proofs = traversed(table["digest"].to_pylist(), (min(total, block) - 1).bit_length())
        joined = ["".join(f"{s}," for s in proof) for proof in proofs]
        return table.append_column("proof", pa.array(joined, pa.string())).append_column("root", pa.array([root, *[None] * (len(proofs) - 1)], pa.string()))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", block long, proof string, root string"
    return written(source.groupBy("tree", "block").applyInArrow(run, schema), label)


def proofs_of(nodes: DataFrame, order: list[str], kept: list[str], block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of trees (tree, digest, and the columns kept) by order: the lowest traversal, what follows its proofs by block (tree, at, tail), and the trees' roots (tree, root)."""
    levels = [traversal(placed(nodes, order), kept, "leaves", block)]
    roots = lambda level: level.where("root is not null")
    while not roots(levels[-1]).where("block > 0").isEmpty():
        above = roots(levels[-1]).select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / block).alias("total"), F.col("root").alias("digest"))
        levels.append(traversal(above, [], f"level{len(levels)}", block))
    trees = roots(levels[-1]).select("tree", "root")
    tails = trees.select("tree", F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"))
    for level in levels[:0:-1]:
        tails = with_tails(level, tails).select("tree", "at", F.concat("proof", "tail").alias("tail"))
    return levels[0], tails, trees


def with_tails(level: DataFrame, tails: DataFrame) -> DataFrame:
    """A traversal's nodes with what tails has for their blocks. A key is one block."""
    own = tails.withColumnsRenamed({"tree": "t", "at": "b"})
    return level.join(own, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", order: str = "doc_id", tampered: tuple[str, int] = ("n_chars", 7), block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes columns; rows of one tree are ordered by order. As a trial of the proofs, rows whose crc32 of the order column tampered[1] divides get 1 added
    to the column tampered[0]; folded_root is worked out from that leaf and the untampered siblings.
    """
    if block & block - 1:
        raise ValueError("a block is a power of two")
    own = {c: docs[c] for c in columns}
    victim = (F.crc32(own[order].cast("string").cast("binary")) % tampered[1]) == 0
    forged = leaf_of([F.try_add(v, F.lit(1)) if c == tampered[0] else v for c, v in own.items()])
    # the text is read once; seq parts equal rows, so that a row that stands often is cut into ranges like any other
    leaves = docs.select(own[tree].alias("tree"), own[order].cast("long").alias("doc_id"), leaf_of(list(own.values())).alias("digest"), F.when(victim, forged).alias("forged"), F.monotonically_increasing_id().alias("seq"))
    leaves = written(leaves, "manifest")
    below, tails, subroots = proofs_of(leaves, ["doc_id", "digest", "seq"], ["doc_id", "forged"], block)
    top = written(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    discard(leaves)
    upper, over, root = proofs_of(top, ["name"], ["name"], block)
    above = with_tails(upper, over).select("name", F.col("digest").alias("subroot"), F.concat("proof", "tail").alias("rest"), "tree").join(root, "tree").drop("tree")
    # a tree may hold all rows: what stands above it goes to its blocks, not to its rows
    above = F.broadcast(above) if top.count() <= FEW_TREES else above
    blocks = tails.join(above, F.col("tree").eqNullSafe(F.col("name"))).select("tree", "at", "subroot", "root", F.concat("tail", "rest").alias("tail"))
    rows = with_tails(below.drop("root"), blocks)
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "forged", "subroot", "root", F.concat("proof", "tail").alias("proof"))
    rows = rows.withColumn("folded_root", folded(F.coalesce("forged", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.translate("proof", "<>,", "").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
