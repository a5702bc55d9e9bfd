"""N-gram Jaccard join: size-aware, heavy and light.

A document is the set of its word shingles. Two link if their Jaccard similarity reaches a threshold. Equal sets are one
class from the start. Candidates come from keys that linked sets must share, by size:

* Light sets: all subsets of each size that a link with a set of allowed size needs in common. They are few while a set is
  small: only one or two elements may be missing.
* Heavy sets: inverted lists. Their keys are blocks of shingles: with D the most elements by which linked sets of about this
  size differ, shingles are dealt by hash into D + 1 blocks, so linked sets agree in some block. Lists of single shingles
  would be long for frequent ones; a block of about nine is rare unless its documents are alike.

The boundary is the size up to which subsets cost no more than scanning the lists of blocks; sets below it that can link
with one above it have both kinds of keys. If all blocks in which two sets agree are empty, then one of them is followed by
a block with one difference at most, and keys for that are emitted too (see block_keys).

At 0.87 and below, blocks would be so small that many hold one shingle or none, and tie unlike sets together. There the keys are runs of
neighbours in the order of hashes, taken as a circle: D elements that differ leave D gaps for c common ones, so some gap holds c / D or
more, and c / D is at least t / (1 - t) for a threshold t (four at 0.8). Those neighbours are neighbours in both sets.

The lists' sets form clusters; in a cluster, intersections are counted exactly, with bit matrices. No pairs are emitted.

Null or empty texts have the empty set and link with nothing. With fewer words than a shingle has, the sequence is one shingle. A
null id counts as the largest. Rows of one id are separate documents. Empty table: no rows.
"""

from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, discard, slices, tidied, written
from docsift.llm.components import components
from docsift.llm.recurring import LARGEST, keyed, mixed, word_units

SHINGLE, PERCENT = 3, 90
#: What scanning a posting of an inverted list costs, against emitting a key.
SCAN = 8
STEP = 1.25
#: Under this run of common neighbours, runs are keys instead of blocks.
RUN = 8
PASSES = 4
#: Sets of a cluster that one task holds, and shingles for each of these on average; larger clusters are compared chunk by chunk.
CHUNK, CHUNK_SHINGLES = 2000, 1000
#: Bytes of each array that a cluster is compared with.
MATRIX_BYTES = 16 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_units(words)
    out = h if len(h) >= size else h[:1]
    for k in range(1, min(size, len(h))):
        out = mixed(out[: len(h) - k] if len(h) >= size else out, h[k:] if len(h) >= size else h[k : k + 1])
    if len(h) < size:
        out = mixed(out, np.array([len(h)], np.uint64))
    return np.unique(out)


class Scheme:
    """Sizes, keys and the boundary for a threshold of percent."""

    def __init__(self, percent: int = PERCENT, scan: int = SCAN):
        self.percent = percent
        self.run = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
        n = 1
        while self.subset_cost(n) <= scan * (self.most_different(n, self.largest(n)) + 1) and n < 60:
            n += 1
        self.boundary = n
        self.starts = [max(1, self.smallest(self.boundary))]
        while self.starts[-1] < 1 << 40:
            self.starts.append(int(self.starts[-1] * STEP) + 1)

    def smallest(self, n: int) -> int:
        return -(-n * self.percent // 100)

    def largest(self, n: int) -> int:
        return n * 100 // self.percent

    def common(self, n: int, m: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def most_different(self, n: int, m: int) -> int:
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({c for m in range(self.smallest(n), self.largest(n) + 1) if (c := self.common(n, m)) <= min(n, m)})

    def subset_cost(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))

    @cache
    def buckets(self, n: int) -> list[tuple[int, int]]:
        """(bucket, number of blocks) of a heavy set: its own, and the one below if it can link with a set in there."""
        b = int(np.searchsorted(self.starts, n, "right")) - 1
        if b < 0:
            return []
        own = [b, b - 1] if b and self.smallest(n) < self.starts[b] else [b]
        return [(x, self.most_different(self.starts[x + 1] - 1, self.largest(self.starts[x + 1] - 1)) + 1) for x in own]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The keys of a set of distinct shingles. Sets that link share one, unless they are equal."""
        n = len(s)
        weights = mixed(s, s >> np.uint64(7))
        out = []
        if n < self.boundary:
            if self.largest(n) > n or self.smallest(n) < n:
                whole = int(weights.sum(dtype=np.uint64))
                values = weights.tolist()
                for c in self.subset_sizes(n):
                    sums = np.array([(whole - sum(x)) & 0xFFFFFFFFFFFFFFFF for x in combinations(values, n - c)], np.uint64)
                    out.append(mixed(sums, np.full(len(sums), c, np.uint64)))
        if n >= self.starts[0] and self.run < RUN:
            out.append(run_keys(weights, self.run))
        elif n >= self.starts[0]:
            for bucket, blocks in self.buckets(n):
                out.append(block_keys(s, weights, bucket, blocks))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def run_keys(weights: np.ndarray, run: int) -> np.ndarray:
    """A key for each run of so many neighbours in the order of hashes, the last and the first being neighbours."""
    sums = sum((np.roll(weights, -i) for i in range(1, run)), weights.copy())
    return mixed(sums, np.full(len(sums), run, np.uint64))


def block_keys(s: np.ndarray, weights: np.ndarray, bucket: int, blocks: int) -> np.ndarray:
    """A key for each block that isn't empty. For an empty one, keys of the next block: whole, and less each of its elements."""
    block = (mixed(s, np.full(len(s), bucket, np.uint64)) % np.uint64(blocks)).astype(np.int64)
    sums = np.zeros(blocks, np.uint64)
    np.add.at(sums, block, weights)
    filled = np.bincount(block, minlength=blocks) > 0
    label = np.arange(blocks, dtype=np.uint64) + np.uint64(bucket << 32)
    out = [mixed(sums[filled], label[filled])]
    for i in np.flatnonzero(~filled).tolist():
        j = (i + 1) % blocks
        variants = sums[j] - np.concatenate([np.zeros(1, np.uint64), weights[block == j]])
        out.append(mixed(variants, np.full(len(variants), (bucket << 32) + i + (1 << 62), np.uint64)))
    return np.concatenate(out)


def links_within(sets: list[np.ndarray], percent: int, others: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each set, which of the later sets (or of the others) it links with."""
    all_ = sets + (others or [])
    sizes = np.array(list(map(len, all_)))
    values, number, counts = np.unique(np.concatenate(all_), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[number] > 1
    rows, columns = np.repeat(np.arange(len(all_)), sizes)[keep], shared[number[keep]]
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    width = -(-int((counts > 1).sum()) // 64) or 1
    wide = max(1, MATRIX_BYTES // (8 * len(all_)))  # words of a block of the matrix
    tall = max(1, MATRIX_BYTES // (4 * len(all_)))

    def block(at: int) -> np.ndarray:
        a, b = np.searchsorted(columns, [64 * at, 64 * (at + wide)])
        bits = np.zeros((len(all_), min(wide, width - at)), np.uint64)
        np.bitwise_or.at(bits, (rows[a:b], (columns[a:b] >> 6) - at), np.uint64(1) << (columns[a:b] & 63).astype(np.uint64))
        return bits

    whole = block(0) if width <= wide else None
    out = []
    for first in range(0, len(sets), tall):
        some = range(first, min(first + tall, len(sets)))
        common = np.zeros((len(some), len(all_)), np.int32)
        for at in range(0, width, wide):
            bits = block(at) if whole is None else whole
            for i in some:
                a = i + 1 if others is None else len(sets)
                common[i - first, a:] += np.bitwise_count(bits[a:] & bits[i]).sum(1, dtype=np.int32)
        for i in some:
            a = i + 1 if others is None else len(sets)
            both = common[i - first, a:].astype(np.int64)
            out.append(np.flatnonzero(100 * both >= percent * (sizes[a:] + sizes[i] - both)) + (a if others is None else 0))
    return out


def join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, version, component_version) of every row; component_id: the least id reachable by links.

    version: a hash of the text, which tells rows of one id apart. component_version: the least one of the component's rows with its least id;
    unlinked components may share an id, but not both.
    """
    scheme = Scheme(percent)
    rows = keyed(docs, id_col, text_col)

    @tidied
    def sets(batches):
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                found = [shingles(t, size) for t in as_bytes(part.column(2))]
                k = np.array([digest(s) for s in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(len, found)), pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], ["id", "version", "n", "k1", "k2"])

    every = written(rows.mapInArrow(sets, "id long, version long, n long, k1 long, k2 long"), "sets")
    classes = written(every.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "version")).alias("rep"), F.count("*").alias("copies")), "classes")

    @tidied
    def keys(batches):
        """The keys of one text of each class."""
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                found = [scheme.keys(shingles(t, size)) for t in as_bytes(part.column(1))]
                nodes = np.repeat(part.column(0).to_numpy(), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(found).view(np.int64))], ["node", "key"])

    # none of the sides that are joined below has a bounded size, so they are shuffled whatever their size (AQE splits skewed keys)
    reps = rows.join(classes.select("rep.id", "rep.version", F.col("k1").alias("node")).hint("merge"), ["id", "version"]).select("node", "text")
    postings = written(reps.mapInArrow(keys, "node long, key long"), "postings")

    def edges_of(postings):
        hubs = postings.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
        return postings.join(hubs.hint("merge"), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    # a share of the keys at a time, so that the shuffle files of one pass at most are on disk
    shares = PASSES if scheme.run < RUN else 1
    passes = [written(edges_of(postings.where(F.pmod("key", F.lit(shares)) == i)), "pass") for i in range(shares)]
    discard(postings)
    # a set and all its hubs are linked with the least of them instead: the same clusters from far fewer edges, as most sets of a group share theirs
    stars = reduce(DataFrame.union, passes).groupBy("a").agg(F.collect_set("b").alias("hubs"))
    stars = stars.select(F.explode(F.concat(F.array("a"), "hubs")).alias("a"), F.array_min("hubs").alias("b")).distinct()
    clusters = components(stars)
    discard(*passes)

    members = classes.join(clusters.select(F.col("node").alias("k1"), F.col("label").alias("cluster")), "k1")
    members = written(members.select("cluster", "k1", "k2", "n", "copies", "rep.id", "rep.version"), "members")
    largest = members.groupBy("cluster").agg(F.greatest(F.count("*"), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("m"))
    large = written(largest.where(F.col("m") > chunk), "large")

    @tidied
    def gathered(batches):
        for batch in batches:
            for part in slices(batch, 1):
                packed = [shingles(t, size).tobytes() for t in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (0, *range(2, part.num_columns))), pa.array(packed, pa.binary())], [*(part.schema.names[i] for i in (0, *range(2, part.num_columns))), "packed"])

    own = "cluster long, k1 long, k2 long, copies long, packed binary"
    full = rows.join(members.hint("merge"), ["id", "version"]).select("cluster", "text", "k1", "k2", "copies").mapInArrow(gathered, own)
    full = full.dropDuplicates(["k1", "k2"])  # a row may stand several times
    if not large.isEmpty():
        full = written(full, "large-sets")
    small = full.join(large.select("cluster"), "cluster", "left_anti") if not large.isEmpty() else full
    tasks = max(1, round(int(members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]) * 8 / (8 << 20)))
    solved = small.repartition(tasks, "cluster").sortWithinPartitions("cluster").mapInArrow(solver(percent), LINKED)
    if not large.isEmpty():
        solved = solved.unionByName(solved_by_chunks(full.join(large, "cluster"), percent, chunk))
    solved = written(solved, "solved")
    discard(members, large)

    # the least (id, version) of each class, and of the classes that are linked with it
    least = classes.select("k1", "k2", F.col("rep").alias("least"), "copies").join(solved, ["k1", "k2"], "left")
    least = least.withColumn("g1", F.coalesce("g1", "k1")).withColumn("g2", F.coalesce("g2", "k2"))
    group = least.groupBy("g1", "g2").agg(F.min("least").alias("component"))
    least = least.join(group, ["g1", "g2"]).select("k1", "k2", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    real = lambda c: F.when(F.col(c) != LARGEST, F.col(c))
    out = every.where("n > 0").select("id", "version", "n", "k1", "k2").join(least.hint("merge"), ["k1", "k2"]).select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component.id").alias("component_id"), "n_links", "version", F.col("component.version").alias("component_version"))
    alone = every.where("n = 0").select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "version", F.col("version").alias("component_version"))
    return out.unionByName(alone)


#: A class, the class that stands for its component, and how many documents of other classes it links with.
LINKED = "k1 long, k2 long, g1 long, g2 long, others long"


def digest(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def solver(percent: int):
    """Clusters, sorted by their number, one after another: the components within each."""

    def solve(group: list[tuple]) -> list[tuple]:
        group.sort(key=lambda r: len(r[4]))
        links = links_within([np.frombuffer(r[4], np.uint64) for r in group], percent)
        component = np.arange(len(group))
        others = np.zeros(len(group), np.int64)
        copies = np.array([r[3] for r in group])
        for i, js in enumerate(links):
            if len(js):
                others[i] += copies[js].sum()
                others[js] += copies[i]
                meet = np.unique(np.append(component[js], component[i]))
                if len(meet) > 1:
                    component[np.isin(component, meet)] = meet[0]
        return [(r[1], r[2], group[c][1], group[c][2], int(n)) for r, c, n in zip(group, component.tolist(), others.tolist(), strict=True)]

    @tidied
    def run(batches):
        group: list[tuple] = []
        out: list[tuple] = []
        names = ["k1", "k2", "g1", "g2", "others"]
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if group and row[0] != group[0][0]:
                    out += solve(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)
                out = []
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*solve(group), strict=True)], names)

    return run


def solved_by_chunks(full: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Clusters (with their sizes m) that one task shouldn't hold: each two chunks of a cluster meet in a task of their own, and only a link from
    each class to each component it meets there is kept."""
    chunks = F.greatest(F.lit(2), F.ceil(F.col("m") * 2 / chunk)).cast("int")
    dealt = full.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    dealt = dealt.withColumn("meet", F.explode(meets)).select("cluster", "meet.i", "meet.j", "chunk", "k1", "k2", "copies", "packed")

    def pairs(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("chunk", "k1", "k2", "copies", "packed")), strict=True))
        a, b = [r for r in rows if r[0] == i], [r for r in rows if r[0] == j]
        sets_of = lambda own: [np.frombuffer(r[4], np.uint64) for r in own]
        found = links_within(sets_of(a), percent) if i == j else links_within(sets_of(a), percent, sets_of(b)) if a and b else []
        b = a if i == j else b
        root = {(r[1], r[2]): (r[1], r[2]) for r in [*a, *b]}
        others = dict.fromkeys(root, 0)

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for r, js in zip(a, found, strict=False):
            for k in js.tolist():
                x, y = (r[1], r[2]), (b[k][1], b[k][2])
                others[x] += b[k][3]
                others[y] += r[3]
                root[top(y)] = top(x)
        out = [(*x, *top(x), n) for x, n in others.items()]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k1", "k2", "g1", "g2", "others"])

    met = written(dealt.groupBy("cluster", "i", "j").applyInArrow(pairs, LINKED), "chunks")
    linked = components(met.select(F.col("k1").alias("a"), F.col("g1").alias("b")))
    sums = met.groupBy("k1", "k2").agg(F.sum("others").alias("others"))
    heads = sums.select("k1", "k2").groupBy("k1").agg(F.min("k2").alias("k2")).select(F.col("k1").alias("g1"), F.col("k2").alias("g2"))
    return sums.join(linked.select(F.col("node").alias("k1"), F.col("label").alias("g1")), "k1", "left").withColumn("g1", F.coalesce("g1", "k1")).join(heads, "g1").select("k1", "k2", "g1", "g2", "others")
