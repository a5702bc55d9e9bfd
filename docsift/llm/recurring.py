"""Where long strings recur across documents: the part that suffix-array and phrase-automaton dedup share.

Units are bytes or words. A window is a fixed number of consecutive units. Of the shorter grams in a window the one of
least hash, the rightmost if there are several, is its anchor, so equal windows have equal anchors at equal places, and the windows of a
document fall into runs that share one anchor. Such a run's text is a snippet. A window can recur only if its anchor
does, so only snippets whose anchor recurs are looked at; there is about one anchor for half a window of text.

Nothing here depends on how often an anchor occurs: equal snippets become one row before they are dealt by anchor, and what
is left of a frequent anchor is dealt by window (see hot_windows).
"""

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, discard, settled, slices, tidied, written

PLACE_BITS = 27
PLACE = np.uint64((1 << PLACE_BITS) - 1)
LARGEST = (1 << 63) - 1
#: Bytes of one anchor's distinct snippets, as many as a task holds. Beyond, they are compared window by window instead of together.
HOT_BYTES = 4 << 20
MOST_WORDS = 80_000
#: A key is frequent if it has more than this share of all rows, so that fewer than the inverse are; those go by broadcast.
FREQUENT, FEW = 1 / 2000, 1000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@cache
def word_hashes() -> WordHashes:
    return WordHashes()


@cache
def byte_hashes() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], np.uint64)


def byte_units(text: bytes) -> np.ndarray:
    return byte_hashes()[np.frombuffer(text, np.uint8)]


def word_units(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x


def grams(units: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size consecutive units; size is a power of two."""
    h, k = units, 1
    while k < size:
        h = mixed(h[:-k], h[k:])
        k *= 2
    return h


def anchors(units: np.ndarray, owner: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, last window) of each anchor. owner: the text that each unit is of; windows keep within one."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = grams(units, gram)
    key = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
    span, k, least = width - gram + 1, 1, key
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < span:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    windows = np.flatnonzero(owner[:n] == owner[width - 1 :])
    place = (PLACE - (least[windows] & PLACE)).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[windows[1:]] != owner[windows[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return h[place[first]], windows[first], windows[last[: len(first)]]


class Kind:
    """Bytes or words: how a text is cut into units and how units are joined again."""

    def __init__(self, name: str, width: int, gram: int):
        self.name, self.width, self.gram = name, width, gram

    def cut(self, text: bytes | None):
        text = text or b""
        return text.split() if self.name == "words" else text  # of bytes, split() parts at 20 and 09-0D

    def hashes(self, units) -> np.ndarray:
        return word_units(units) if self.name == "words" else byte_units(units)

    def joined(self, units) -> bytes:
        return b" ".join(units) if self.name == "words" else units

    def anchors(self, texts: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text, given as units: (gram hash, first window, last window) of its anchors."""
        most = 1 << (PLACE_BITS - 1)
        out, at = [], 0
        pieces = [(i, start, u[start : start + most + self.width - 1]) for i, u in enumerate(texts) for start in range(0, max(len(u) - self.width + 1, 0), most)]
        out = [[] for _ in texts]
        while at < len(pieces):  # some at a time, as many as places can tell apart
            part, total = [], 0
            while at < len(pieces) and (not part or total + len(pieces[at][2]) <= 1 << 20):
                part.append(pieces[at])
                total += len(pieces[at][2])
                at += 1
            sizes = [len(u) for _, _, u in part]
            units = np.concatenate([self.hashes(u) for _, _, u in part])
            h, first, last = anchors(units, np.repeat(np.arange(len(part)), sizes), self.width, self.gram)
            starts = np.cumsum([0, *sizes])
            cut = np.searchsorted(first, starts)
            for k, (i, start, _) in enumerate(part):
                a, b = cut[k], cut[k + 1]
                out[i].append((h[a:b], first[a:b] - starts[k] + start, last[a:b] - starts[k] + start))
        empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return [tuple(np.concatenate(x) for x in zip(*o, strict=True)) if o else empty for o in out]


KEY = "id long, version long"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version, text: an id that is null counts as the largest; rows of one id are told apart by a hash of their texts."""
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LARGEST)).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def snippets(rows: DataFrame, kind: Kind, across: bool) -> DataFrame:
    """A written table (id, version, anchor, same, first, snippet): the snippets of recurring anchors.

    across: an anchor recurs only if two ids have it; else two places are enough. same: a hash of the snippet.
    """

    @tidied
    def marks(batches):
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                found = kind.anchors([kind.cut(t) for t in as_bytes(part.column(2))])
                at = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _, _ in found]))
                h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(h.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "version", "anchor", "first", "last"])

    every = written(rows.mapInArrow(marks, f"{KEY}, anchor long, first int, last int"), "anchors")
    groups = every.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    groups = groups.where(F.col("a") < F.col("b")) if across else groups.where(F.col("n") > 1)
    groups = written(groups, "recurring")
    total = every.count()
    lists = met(every, groups.select("anchor", "n"), ["anchor"], total).groupBy("id", "version").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("recurring"))

    @tidied
    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                ids, versions, units = part.column(0).to_pylist(), part.column(1).to_pylist(), [kind.cut(t) for t in as_bytes(part.column(2))]
                places = part.column(3)
                places = zip(places.offsets.to_pylist(), places.offsets.to_pylist()[1:], strict=False), *(x.to_pylist() for x in places.values.flatten())
                out = []
                for i, (a, b) in enumerate(places[0]):
                    for anchor, lo, hi in zip(*(x[a:b] for x in places[1:]), strict=True):
                        text = kind.joined(units[i][lo : hi + kind.width])
                        out.append((ids[i], versions[i], anchor, xxhash.xxh3_64_intdigest(text) - (1 << 63), lo, text))
                if out:
                    kinds = (pa.int64(),) * 5 + (pa.binary(),)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "version", "anchor", "same", "first", "snippet"])

    out = written(rows.join(lists, ["id", "version"]).mapInArrow(cut, f"{KEY}, anchor long, same long, first long, snippet binary"), "snippets")
    discard(every, groups)
    return out


def met(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows, total of them, joined with groups, a written table with a row for each key and n, how many rows have it.

    Frequent keys, fewer than 1 / FREQUENT, are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    frequent = groups.where(F.col("n") > max(FEW, total * FREQUENT))
    few, many = frequent.drop("n"), groups.where(F.col("n") <= max(FEW, total * FREQUENT)).drop("n")
    if frequent.isEmpty():
        return rows.join(many.hint("merge"), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return rest.join(many.hint("merge"), keys).unionByName(rows.join(F.broadcast(few), keys))


def recurring_spans(rows: DataFrame, kind: Kind, across: bool, resolve: Callable, bytes_in_task: int = HOT_BYTES) -> DataFrame:
    """(id, version, spans): the units of each row that recurring windows cover, as a list of [start, end) in order.

    resolve takes the distinct snippets of a task, in batches of (anchor, same, snippet, least id, largest id, times), and
    gives (anchor, same, runs, times), a run being (first window, last window, least id with them), windows numbered from the
    snippet's start. across: only windows that also stand under a smaller id count for a document.
    """
    return settled(lambda: _spans(rows, kind, across, resolve, bytes_in_task), "spans")


def _spans(rows: DataFrame, kind: Kind, across: bool, resolve: Callable, bytes_in_task: int) -> DataFrame:
    every = snippets(rows, kind, across)
    distinct = every.groupBy("anchor", "same", "snippet").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    distinct = written(distinct, "distinct")
    sizes = distinct.groupBy("anchor").agg(F.sum(F.octet_length("snippet")).alias("bytes"), F.sum("n").alias("all"), F.min("a").alias("least"), F.max("b").alias("most"))
    usable = F.col("least") < F.col("most") if across else F.col("all") > 1
    hot = sizes.where(F.col("bytes") > HOT_BYTES).select("anchor")
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("snippet")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-int(total) // bytes_in_task))
    cold = distinct.join(sizes.where((F.col("bytes") <= HOT_BYTES) & usable).select("anchor"), "anchor", "left_semi").repartition(tasks, "anchor")
    runs = "anchor long, same long, runs array<struct<first:int,last:int,least:long>>, n long"
    found = cold.select("anchor", "same", "snippet", "a", "b", "n").mapInArrow(resolve, runs)
    if not hot.isEmpty():
        found = found.unionByName(hot_windows(distinct.join(hot, "anchor", "left_semi"), kind, across))
    # a snippet has at most as many runs as windows with one anchor, so a frequent one is a small row
    found = written(found, "found")
    discard(distinct)
    places = met(every.select("id", "version", "anchor", "same", "first"), found, ["anchor", "same"], every.count()).select("id", "version", "first", F.explode("runs").alias("run"))
    if across:
        places = places.where(F.col("run.least") < F.col("id"))
    spans = places.select("id", "version", F.struct((F.col("first") + F.col("run.first")).alias("start"), (F.col("first") + F.col("run.last") + kind.width).alias("end")).alias("span"))
    return spans.groupBy("id", "version").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def hot_windows(distinct: DataFrame, kind: Kind, across: bool) -> DataFrame:
    """What resolve gives, for anchors with so many distinct snippets that they are dealt by window: counts are summed before the shuffle."""

    @tidied
    def cut(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                a, s, t, least, most, n = (part.column(i).to_pylist() for i in range(6))
                out = []
                for i, text in enumerate(t):
                    units = text.split(b" ") if kind.name == "words" else text
                    for j in range(len(units) - kind.width + 1):
                        d = xxhash.xxh3_128_digest(kind.joined(units[j : j + kind.width]))
                        out.append((a[i], s[i], j, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), least[i], most[i], n[i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["anchor", "same", "j", "w1", "w2", "a", "b", "n"])

    windows = written(distinct.select("anchor", "same", "snippet", "a", "b", "n").mapInArrow(cut, "anchor long, same long, j long, w1 long, w2 long, a long, b long, n long"), "hot")
    groups = windows.groupBy("w1", "w2").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.sum("n").alias("all"))
    groups = groups.where(F.col("least") < F.col("most")) if across else groups.where(F.col("all") > 1)
    hits = windows.join(groups.select("w1", "w2", "least"), ["w1", "w2"])
    run = F.struct(F.col("j").cast("int").alias("first"), F.col("j").cast("int").alias("last"), "least")
    return hits.groupBy("anchor", "same").agg(F.collect_list(run).alias("runs"), F.max("n").alias("n"))


def batches_by_size(batches, limit: int):
    """Lists of rows (anchor, same, snippet, a, b, n) of about limit bytes of snippets."""
    out, total = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            out.append(row)
            total += len(row[2])
            if total >= limit:
                yield out
                out, total = [], 0
    if out:
        yield out


def as_runs(found: list[tuple[int, int, list[tuple[int, int, int]], int]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())]))
    runs = [[dict(zip(("first", "last", "least"), r, strict=True)) for r in x[2]] for x in found]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(runs, kind), pa.array([x[3] for x in found], pa.int64())], ["anchor", "same", "runs", "n"])


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order of their starts, as maximal runs."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """docs with the spans of each row; null where it has none."""
    own = spans.select(F.col("id").alias(f"{spans_col}_id"), F.col("version").alias(f"{spans_col}_v"), F.col("spans").alias(spans_col))
    key = (F.coalesce(docs[id_col].cast("long"), F.lit(LARGEST)) == F.col(f"{spans_col}_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col(f"{spans_col}_v"))
    return docs.join(own, key, "left").drop(f"{spans_col}_id", f"{spans_col}_v")
