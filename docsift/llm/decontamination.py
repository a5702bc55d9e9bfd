"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. The patterns are the windows of the benchmark items, all of one length per table. A table of
shifts, by the hash of a block of up to three words, says how far a window's end can move without passing an
occurrence; where it says 0, the bucket of that block's hash holds the windows to try, and words are compared directly.
Many stretches of text are searched side by side, so each step is a few array operations.

Nulls in text or id columns: a null text has no words; a null item is no pattern. An item with fewer words than a window
is one window of its own length. Empty documents: no rows; no items: nothing is hit. Repeated rows are kept as they are.
"""

import hashlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, slices, tidied, written

#: Most bytes of benchmark text searched for, and so broadcast, in one pass. More items take more passes.
PASS_BYTES = 16 << 20
LANE = 512
#: 0-9 and a-z and all bytes from 0x80 on are parts of words; A-Z become a-z, all else parts words.
TO_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class WuManber:
    """Search for windows of one length. windows: (n, length) word numbers from 1 on; 0 stands for every other word."""

    def __init__(self, windows: np.ndarray):
        n, self.length = windows.shape
        self.windows = windows
        self.block = min(3, self.length)
        bits = max(8, int(np.ceil(np.log2(4 * n * self.length + 1))))
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.length - self.block + 1, np.uint8)
        for end in range(self.block - 1, self.length):  # later ends have smaller shifts and overwrite
            self.shift[self.hashed(windows.T, end)] = self.length - 1 - end
        last = self.hashed(windows.T, self.length - 1)
        self.order = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.order], np.arange((1 << bits) + 1))

    def hashed(self, words: np.ndarray, end) -> np.ndarray:
        """Of the blocks of words that end at end."""
        h = words[end].astype(np.int64)
        for k in range(1, self.block):
            h = h * np.int64(1000003) + words[end - k]
        return (h ^ (h >> np.int64(17))) & self.mask

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences: (first word, window)."""
        found = []
        at = np.arange(self.length - 1, len(words), LANE)
        until = np.minimum(at + LANE, len(words))
        while len(at):
            step = self.shift[self.hashed(words, at)]
            if len(hit := at[step == 0]):
                found.append(hit)
            at = at + np.maximum(step, 1)
            alive = at < until
            at, until = at[alive], until[alive]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.concatenate(found)
        bucket = self.hashed(words, ends)
        size = self.first[bucket + 1] - self.first[bucket]
        starts, tries = [], []
        for i in range(0, len(ends), 1 << 15):  # a part of the candidates at a time
            e, b, n = (x[i : i + (1 << 15)] for x in (ends, bucket, size))
            begin = np.repeat(e, n) - self.length + 1
            window = self.order[np.repeat(self.first[b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            for k in range(self.length):
                same = words[begin + k] == self.windows[window, k]
                begin, window = begin[same], window[same]
            starts.append(begin)
            tries.append(window)
        return np.concatenate(starts), np.concatenate(tries)


class Patterns:
    """The windows of some items: a number for each of their words, a search for each length of window, and the windows' items."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(width, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.searches = [(WuManber(np.array(list(w), np.int32)), list(w.values())) for _, w in sorted(by_length.items())]

    def search(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[int]]]:
        """Of each text: a flag for each word that is hit, and the items that hit it."""
        sizes = np.array([len(t) + 1 for t in texts])
        words = np.fromiter(map(self.number.get, chain.from_iterable(chain(t, (b"",)) for t in texts), repeat(0)), np.int32, int(sizes.sum()))
        cover = np.zeros(len(words) + 1, np.int32)
        ends = np.cumsum(sizes)
        items: list[set[int]] = [set() for _ in texts]
        for search, owners in self.searches:
            start, window = search.find(words)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + search.length, -1)
            of = np.searchsorted(ends, start, "right")
            for d, w in set(zip(of.tolist(), window.tolist(), strict=True)):
                items[d] |= owners[w]
        hit = np.cumsum(cover)[:-1] > 0
        return [hit[e - n : e - 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], items


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES, carry: str | None = None
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs, and the text and the column carry, as carried, if one is named.

    No shuffle: the windows of at most pass_bytes of items are broadcast at a time. More items are dealt into parts by id,
    and the documents pass each part in turn.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) // pass_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<long>").alias("items"), *([F.col(carry).alias("carried")] if carry else []))
    more = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        patterns = spark.sparkContext.broadcast(Patterns([(r["item_id"], r["text"].encode()) for r in own.collect()], width))  # at most about pass_bytes of text
        if part:
            rows = written(rows, "decontamination")
        rows = rows.mapInArrow(scan(patterns, part == parts - 1, carry), (ROWS if part < parts - 1 else RESULT + ", text string" * bool(carry)) + more)
    return rows


ROWS = "doc_id long, text string, hit binary, items array<long>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def scan(patterns, last: bool, carry):
    """One pass over documents. Hits of earlier passes come as packed bits."""

    @tidied
    def run(batches):
        search = patterns.value.search
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                texts = [words_of(t) for t in as_bytes(part.column(1))]
                hits, items = search(texts)
                for i, (packed, others) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    items[i].update(others or ())
                    if packed:
                        hits[i] = hits[i] | np.unpackbits(np.frombuffer(packed, np.uint8), count=len(hits[i])).astype(bool)
                if not last:
                    packed = pa.array([np.packbits(h).tobytes() for h in hits], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed, pa.array([sorted(x) for x in items], pa.list_(pa.int64())), *part.columns[4:]], part.schema.names)
                    continue
                n = [int(h.sum()) for h in hits]
                digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), n, list(map(len, items)))), pa.array(digests, pa.string()), pa.array([x > 0 for x in n], pa.bool_()), *([part.column(1)] if carry else []), *part.columns[4:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["text"] if carry else []), *part.schema.names[4:]])

    return run
