"""Packing by lexical retrieval: sequences are filled with documents that are like one another.

A document's ids fill whole windows as far as they go; what is left of it is an item. Items are sorted by their three strongest terms and
cut into shards of about SHARD tokens, so that like items meet. Each shard has an inverted index with BM25 weights, whose
document frequencies and mean length are those of the whole table. The first unused item is a seed: the index returns the unused items by
score, and they fill the seed's window greedily. The one that no longer fits is cut, and the rest of it is the next seed, so every window is full.

Terms are token ids, so what has to be known of all documents is bounded by the vocabulary. A seed is compared with its shard alone: to ask all shards for each seed
would cost the square of the input. What is left at a partition's end, less than a window, goes to the next shards with what is left elsewhere,
until one task has it all; its last sequences have powers of two of ids, which need no padding.

Nulls: a null text is empty and has the end token alone. A null id is kept. Repeated rows are packed as often as they occur. A very long text is cut into whole windows, none of
which waits for a shard. Ties in score or key: the order of items, by a hash of id and start. Empty table: no rows. Extra columns are left out.
"""

import json
import os
import zlib
from array import array
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import slices, tidied, written
from docsift.llm.packing import Recent, gathered
from docsift.llm.token_counts import Counter, classes, starts

WINDOW, END_ID = 2048, 1
#: Tokens of a shard, whose index is searched by its seeds, and of a partition, which a task packs shard by shard.
SHARD, PARTITION = 1 << 18, 1 << 22
K1, B = 1.2, 0.75
#: Distinct pre-tokens whose ids a worker keeps, in each of two generations.
MOST_PARTS = 300_000
#: Bits of a term in a sort key.
TERM_BITS = 21


# --- tokens ---------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of a byte-level vocabulary. Texts are cut into pre-tokens by array operations; only distinct ones that are new go to a merge model,
    which takes the file's merges as ranks of bytes.

    Texts with special strings go to the library whole, as does everything if the file's ids don't follow its merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.library, self.parts = Tokenizer.from_file(path), Recent(MOST_PARTS)
        self.size = self.library.get_vocab_size()
        self.kind, self.code = (np.dtype("<u2"), "H") if self.size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.merges = self.by_rank(file)

    def by_rank(self, file: dict):
        """A merge model from bytes to ids, if each merge's id follows those of the bytes and of the merges before it."""
        import tiktoken

        back = Counter.characters()
        vocabulary = {t: i for t, i in file["model"]["vocab"].items() if t not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        if len(vocabulary) != 256 + len(pairs) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def of_parts(self, parts: list[str]) -> list[bytes]:
        merges, code = self.merges, self.code
        return [array(code, merges(p.encode())).tobytes() for p in parts]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if self.merges is None:
            return [self.whole(t) for t in texts.to_pylist()]
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            apart = {i: self.whole(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
            texts = pc.if_else(pa.array(odd), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        lead = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        cuts, sizes, before = [], [], 0
        for t in texts.to_pylist():
            at = starts(t)
            cuts.append(at + before)
            sizes.append(len(at))
            before += len(t)
        cuts = np.concatenate([*cuts, np.empty(0, np.int64)])
        if before < len(lead):  # from characters to bytes
            cuts = np.flatnonzero((lead & 0xC0) != 0x80)[cuts]
        cuts = np.append(cuts + offsets[0], offsets[-1]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        packed = self.parts.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.of_parts)
        flat, lengths = np.frombuffer(b"".join(packed), self.kind), np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        ids, until = gathered(flat, lengths, coded.indices.to_numpy())
        ends = np.concatenate([[0], until])[np.cumsum([0, *sizes])]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        if odd.any():
            for i, own in apart.items():
                out[i] = own
        return out


@cache
def encoder(path: str) -> Encoder:
    classes()
    return Encoder(path)


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each occurs."""
    n, s = len(ids), np.sort(ids, kind="stable")
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = new.nonzero()[0]
    times = np.empty(len(at), np.int64)
    if n:
        np.subtract(at[1:], at[:-1], out=times[:-1])
        times[-1] = n - at[-1]
    return s[at], times


# --- items and statistics -------------------------------------------------------------------------------------------

PLACED, ITEM, COUNTS = 0, 1, 2
ROWS = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, terms array<int>, counts array<long>"
KINDS = (pa.int32(), *(pa.int64(),) * 7, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
#: Terms under which the numbers of documents, of items and of the items' tokens are counted.
DOCS, ITEMS, TOKENS = -1, -2, -3


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], COLUMNS)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def tokenized(docs: DataFrame, path: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """A written table: whole windows, which are placed already, items, and each task's counts of documents by term."""

    @tidied
    def run(batches):
        encode = encoder(path)
        frequency = np.zeros(encode.size, np.int64)
        totals, sequence = [0, 0, 0], TaskContext.get().partitionId() << 28
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                out = []
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids(part.column(1)), strict=True):
                    ids = np.append(ids, encode.kind.type(END_ID))
                    frequency[terms_of(ids)[0]] += 1
                    n, rest = len(ids), len(ids) % window
                    for i in range(0, n - rest, window):
                        out.append((PLACED, doc, i, window, crc32(ids[i : i + window]), n, sequence, 0, None, None, None))
                        sequence += 1
                    if rest:
                        out.append((ITEM, doc, n - rest, rest, None, n, None, None, ids[n - rest :].tobytes(), None, None))
                    totals[0] += 1
                    totals[1] += bool(rest)
                    totals[2] += rest
                if out:
                    yield batch_of(out)
        there = np.flatnonzero(frequency)
        yield batch_of([(COUNTS, *(None,) * 8, [*there.tolist(), DOCS, ITEMS, TOKENS], [*frequency[there].tolist(), *totals])])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(run, ROWS), "items")


class Statistics:
    """What BM25 needs of the whole table: inverse document frequencies by term, and the items' mean length."""

    def __init__(self, counts: dict[int, int]):
        n = counts.get(DOCS, 0)
        frequency = np.zeros(max(counts, default=0) + 1)
        for t, c in counts.items():
            if t >= 0:
                frequency[t] = c
        self.idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        self.mean = max(1.0, counts.get(TOKENS, 0) / max(1, counts.get(ITEMS, 0)))

    def weights(self, terms: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
        """Of each term of an item of this length."""
        return self.idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))


def statistics(table: DataFrame) -> Statistics:
    """Summed over all tasks; at most as many numbers as the vocabulary has entries, and three, come to the driver."""
    rows = table.where(F.col("kind") == COUNTS).select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return Statistics({r["t"]: r["n"] for r in rows.groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("n")).collect()})


# --- shards ---------------------------------------------------------------------------------------------------------


class Shard:
    """Items with their inverted index. Of an item that was cut, only what is left counts as unused."""

    def __init__(self, items: list[tuple], known: Statistics):
        self.items, n = items, len(items)
        self.at = [0] * n
        self.left = np.array([len(x[3]) for x in items], np.int64)
        own = [terms_of(x[3]) for x in items]
        sizes = np.array([len(t) for t, _ in own], np.int64)
        terms = np.concatenate([t for t, _ in own])
        weights = np.concatenate([known.weights(t, f, len(x[3])) for (t, f), x in zip(own, items, strict=True)])
        by = np.argsort(terms, kind="stable")
        self.found, self.weight = np.repeat(np.arange(n), sizes)[by], weights[by]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(known.idf)))])

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The BM25 score of every item for a query of these ids."""
        terms = terms_of(ids)[0]
        spans = list(zip(self.begin[terms].tolist(), self.begin[terms.astype(np.int64) + 1].tolist(), strict=True))
        return np.bincount(np.concatenate([self.found[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), len(self.items))

    def neighbours(self, ids: np.ndarray):
        """Unused items, the best first; of equals, in order. Of many, the best are sorted before the rest."""
        live = self.left.nonzero()[0]
        s = -self.scores(ids)[live]
        some = 64
        if len(live) > 4 * some:
            limit = np.partition(s, some)[some]
            best = np.flatnonzero(s <= limit)
            yield from live[best[np.argsort(s[best], kind="stable")]].tolist()
            rest = np.flatnonzero(s > limit)
            yield from live[rest[np.argsort(s[rest], kind="stable")]].tolist()
        else:
            yield from live[np.argsort(s, kind="stable")].tolist()

    def take(self, i: int, most: int) -> tuple:
        """(doc, start, ids, tokens of the document) of the next ids of an item, at most so many."""
        doc, start, total, ids = self.items[i]
        at, n = self.at[i], min(most, int(self.left[i]))
        self.at[i] += n
        self.left[i] -= n
        return doc, start + at, ids[at : at + n], total

    def rest(self) -> list[tuple]:
        return [(d, s + at, t, ids[at:]) for (d, s, t, ids), at, n in zip(self.items, self.at, self.left, strict=True) if n]

    def windows(self, window: int):
        """Full windows as lists of what they took. Less than a window stays."""
        unused, tokens, seed = 0, int(self.left.sum()), None
        while tokens >= window:
            if seed is None or not self.left[seed]:
                while not self.left[unused]:
                    unused += 1
                seed = unused
            _, _, _, ids = self.items[seed]
            query = ids[self.at[seed] :]
            taken, room, cut = [self.take(seed, window)], window, None
            room -= len(taken[0][2])
            for i in self.neighbours(query) if room else ():
                if self.left[i]:
                    taken.append(self.take(i, room))
                    room -= len(taken[-1][2])
                    if not room:
                        cut = i
                        break
            tokens -= window
            seed = cut
            yield taken


def powers(tokens: int) -> list[int]:
    """A number as powers of two, the largest first."""
    return [1 << i for i in range(tokens.bit_length() - 1, -1, -1) if tokens >> i & 1]


def sequences(items: list[tuple], sizes: list[int]) -> list[list[tuple]]:
    """Items in turn, cut into sequences of these sizes."""
    out, i, at = [], 0, 0
    for size in sizes:
        own = []
        while size:
            doc, start, total, ids = items[i]
            n = min(size, len(ids) - at)
            own.append((doc, start + at, ids[at : at + n], total))
            size, at = size - n, at + n
            if at == len(ids):
                i, at = i + 1, 0
        out.append(own)
    return out


def packed(items: DataFrame, known: Statistics, path: str, level: int, last: bool, window: int, shard: int) -> DataFrame:
    """A written table of items that are sorted within partitions: what was placed, and as items what is left, which is nothing if this is the last level."""
    share = items.sparkSession.sparkContext.broadcast(known)

    @tidied
    def run(batches):
        known, kind = share.value, encoder(path).kind
        first = level << 54 | TaskContext.get().partitionId() << 28
        count, held, tokens = 0, [], 0

        def placed(taken: list[tuple]) -> list[tuple]:
            nonlocal count
            out, offset = [], 0
            for doc, start, ids, total in taken:
                out.append((PLACED, doc, start, len(ids), crc32(ids), total, first + count, offset, None, None, None))
                offset += len(ids)
            count += 1
            return out

        def full():
            nonlocal held, tokens
            index, out = Shard(held, known), []
            for taken in index.windows(window):
                out += placed(taken)
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            held = index.rest()
            tokens = sum(len(x[3]) for x in held)

        for b in batches:
            for doc, start, total, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.append((doc, start, total, np.frombuffer(ids, kind)))
                tokens += len(held[-1][3])
                if tokens >= shard:
                    yield from full()
        if tokens >= window:
            yield from full()
        if held and last:
            yield batch_of([row for own in sequences(held, powers(tokens)) for row in placed(own)])
        elif held:
            yield batch_of([(ITEM, d, s, len(ids), None, t, None, None, ids.tobytes(), None, None) for d, s, t, ids in held])

    return written(items.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(run, ROWS), f"packed{level}")


def keyed(items: DataFrame, known: Statistics, path: str) -> DataFrame:
    """doc_id, start, doc_tokens, ids, and what items are sorted by: the three strongest terms, then a hash, so that no key is too frequent for a partition."""
    share = items.sparkSession.sparkContext.broadcast(known)

    @tidied
    def run(batches):
        known, kind = share.value, encoder(path).kind
        for b in batches:
            keys = []
            for raw in b.column(3).to_pylist():
                ids = np.frombuffer(raw, kind)
                terms, times = terms_of(ids)
                weights = known.weights(terms, times, len(ids))
                best = np.argpartition(-weights, 2)[:3] if len(terms) > 3 else np.arange(len(terms))
                strongest = terms[best[np.lexsort((best, -weights[best]))]].tolist()
                keys.append(sum(t << TERM_BITS * (2 - i) for i, t in enumerate(strongest)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "key"])

    source = items.select("doc_id", "start", "doc_tokens", "ids")
    return source.mapInArrow(run, "doc_id long, start long, doc_tokens long, ids binary, key long").withColumn("salt", F.xxhash64("doc_id", "start", "doc_tokens"))


def pack_by_retrieval(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD, partition: int = PARTITION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece. path: the tokenizer file, which every executor has at that place."""
    tables = [tokenized(docs, path, window, id_col, text_col)]
    known = statistics(tables[0])
    while True:
        items = tables[-1].where(F.col("kind") == ITEM)
        tokens = items.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
        if not tokens:
            break
        n, order = -(-tokens // partition), ["key", "salt"]
        # written, as dealing by range reads its input twice
        rows = written(keyed(items, known, path), "keyed")
        rows = rows.repartitionByRange(n, *order) if n > 1 else rows.repartition(1)  # one task gets at most a partition's tokens
        tables.append(packed(rows.sortWithinPartitions(*order), known, path, len(tables), n == 1, window, shard))
    out = reduce(DataFrame.unionByName, [t.where(F.col("kind") == PLACED) for t in tables])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
