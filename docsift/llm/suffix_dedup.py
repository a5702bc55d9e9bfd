"""Suffix-array dedup with a logarithmic family of indexes.

Candidate text comes as snippets (see recurring), dealt so that all that can match meets in one task. There, each batch of
snippets gets a suffix array of its windows, sorted by their full length, 8 bytes after 8 bytes. The batch is scanned against
each level of the index: a vectorised search, one 8-byte word after another, narrows each window's range in the level's
suffix array; a range that is left after the last word is a match. Then the batch becomes a level, and levels of about equal size
merge: the places found by the search are where the entries are inserted, so nothing is sorted again.

A byte is removed if a window (200 bytes by default) that covers it also starts anywhere else, in the same document too. Null texts are
empty; shorter texts have no windows; repeated rows match each other. Empty table: no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import as_bytes, slices, tidied
from docsift.llm.recurring import Kind, as_runs, batches_by_size, keyed, merged, mixed, recurring_spans, with_spans

WIDTH, GRAM = 200, 32
#: Bytes of snippets that enter the index at once: a task holds several batches, whose levels merge.
BATCH = 2 << 20


def big_endian(text: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as a number that sorts as they do; behind the end come zeros."""
    b = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    out, k = b, 1
    while k < 8:
        out = (out[:-k] << np.uint64(8 * k)) | out[k:]
        k *= 2
    return out[: len(text)]


BLOCK = 8


def hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the BLOCK words and of the width bytes from each place on, as far as there are so many."""
    h, k, block = words, 8, None
    while 2 * k <= width:
        h = mixed(h[:-k], h[k:])
        k *= 2
        block = h if k == 8 * BLOCK else block
    return block, mixed(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def sorted_windows(words: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' places in order, that order, and for each the number of its group of equal windows.

    Windows of one hash are compared byte by byte with the first of them, and only the first are sorted.
    """
    block, whole = hashes(words, width)
    _, first, own = np.unique(whole[places], return_index=True, return_inverse=True)
    offsets = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    head = places[first][own]
    twins = np.flatnonzero(head != places)
    same = np.ones(len(twins), bool)
    for off in offsets:
        same &= words[places[twins] + off] == words[head[twins] + off]
    if not same.all():  # windows of one hash that differ are sorted one by one
        stands = first[own]
        stands[twins[~same]] = twins[~same]
        first, own = np.unique(stands, return_inverse=True)
    order, group = sorted_distinct(words, places[first], block, whole, offsets)
    number = np.empty(len(first), np.int64)
    number[order] = group
    every = number[own]
    order = np.argsort(every, kind="stable")
    return places[order], order, every[order]


def sorted_distinct(words: np.ndarray, places: np.ndarray, block: np.ndarray, whole: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows and the number of each one's group of equals. Sorted by 8 bytes after 8 bytes: in each round only windows of
    groups that tie so far and are known to differ, by their hashes, in the block of words at hand."""
    order = np.argsort(words[places])
    key = words[places[order]]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(places) else np.empty(0, bool)
    for i in range(1, len(offsets), BLOCK):
        part = offsets[i : i + BLOCK]
        own = block if len(part) == BLOCK and part[-1] - part[0] == 8 * (BLOCK - 1) else None
        active = np.arange(len(order))
        for n, off in enumerate(part):
            if not n or own is None:
                group = np.cumsum(new[active]) - 1
                first = np.flatnonzero(new[active])
                at = places[order[active]]
                f = own[at + part[0]] if own is not None else whole[at]
                differs = np.bincount(group, f != f[first][group], len(first)) > 0 if len(at) else np.empty(0, bool)
                active = active[differs[group]]
            else:  # groups that have come apart are done
                alone = new[active] & np.append(new[active][1:], True)
                active = active[~alone]
            if not len(active):
                break
            g = np.cumsum(new[active])
            k = words[places[order[active]] + off]
            by = np.lexsort((k, g))
            order[active] = order[active[by]]
            k = k[by]
            new[active[1:]] |= (k[1:] != k[:-1]) & (g[1:] == g[:-1])
    return order, np.cumsum(new) - 1


class Level:
    """A suffix array of windows: words (8 bytes from each place of the text), places in order, and whether each recurs."""

    def __init__(self, words: np.ndarray, places: np.ndarray, hit: np.ndarray):
        self.words, self.places, self.hit = words, places, hit
        self.head = words[places]

    @classmethod
    def of(cls, text: bytes, places: np.ndarray, times: np.ndarray, width: int) -> "Level":
        words = big_endian(text)
        places, order, group = sorted_windows(words, places, width)
        counts = np.bincount(group, times[order]) if len(group) else np.empty(0)
        return cls(words, places, counts[group] > 1)

    def ranges(self, other: "Level", width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of other's windows the range of equal windows here; an empty one is where it would be inserted."""
        lo, hi = np.searchsorted(self.head, other.head, "left"), np.searchsorted(self.head, other.head, "right")
        alive = np.flatnonzero(lo < hi)
        for off in [*range(8, width - 7, 8), *([width - 8] if width % 8 else [])]:
            if not len(alive):
                break
            want = other.words[other.places[alive] + off]
            a, b = lo[alive], hi[alive]
            lo[alive] = self.bound(want, a, b, off, False)
            hi[alive] = self.bound(want, lo[alive], b, off, True)
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def bound(self, want, lo, hi, off, right):
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            have = self.words[self.places[mid] + off]
            below = have <= want[open_] if right else have < want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def merged(self, other: "Level", at: np.ndarray) -> "Level":
        """Both in one; at: where other's entries go."""
        places = np.insert(self.places, at, other.places + len(self.words))
        return Level(np.concatenate([self.words, other.words]), places, np.insert(self.hit, at, other.hit))


class Index:
    """Levels from large to small. Places in the whole text are kept apart by the order of adding."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.levels: list[tuple[int, Level]] = []  # where its text begins in the whole, and the level
        self.size = 0

    def add(self, text: bytes, places: np.ndarray, times: np.ndarray) -> None:
        new = Level.of(text, places, times, self.width)
        lo = None
        for _, level in self.levels:
            lo, hi = level.ranges(new, self.width)
            found = lo < hi
            new.hit |= found
            change = np.zeros(len(level.places) + 1, np.int64)
            np.add.at(change, lo[found], 1)
            np.add.at(change, hi[found], -1)
            level.hit |= np.cumsum(change)[:-1] > 0
        base = self.size
        self.size += len(text)
        while self.levels and len(self.levels[-1][1].words) <= 1.5 * len(new.words):
            base, level = self.levels.pop()
            new = level.merged(new, level.ranges(new, self.width)[0] if lo is None else lo)
            lo = None  # known for the last level only
        self.levels.append((base, new))

    def recurring(self) -> np.ndarray:
        """A flag for each place of the whole text: whether its window recurs."""
        out = np.zeros(self.size, bool)
        for base, level in self.levels:
            out[base + level.places[level.hit]] = True
        return out


def resolver(width: int):
    @tidied
    def resolve(batches):
        index, rows = Index(width), []
        for part in batches_by_size(batches, BATCH):
            sizes = np.array([len(r[2]) for r in part])
            starts = np.cumsum(sizes) - sizes
            counts = sizes - width + 1
            places = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            index.add(b"".join(r[2] for r in part), places, np.repeat(np.array([r[5] for r in part]), counts))
            rows += [(r[0], r[1], n, r[5]) for r, n in zip(part, sizes.tolist(), strict=True)]
        flags, at, out = index.recurring(), 0, []
        for anchor, same, n, times in rows:
            f = np.flatnonzero(np.diff(np.concatenate([[0], flags[at : at + n - width + 1], [0]])))
            at += n
            if len(f):
                out.append((anchor, same, [(int(a), int(b) - 1, 0) for a, b in f.reshape(-1, 2)], times))
        for i in range(0, len(out), 5000):
            yield as_runs(out[i : i + 5000])

    return resolve


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, spans) of the rows with repeated strings: byte ranges [start, end) that windows cover."""
    return recurring_spans(keyed(docs, id_col, text_col), Kind("bytes", width, gram), False, resolver(width))


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False, carry: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row, and the column carry, if one is named.

    n_spans: maximal removed runs; kept: the bytes that stay. whole_characters: a character goes only if all its bytes do, so
    that kept is always text.
    """
    spans = repeated_spans(docs, width, gram, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(carry).alias("carried")] if carry else []))
    rows = with_spans(rows, spans, "doc_id", "text", "gone").select("doc_id", "text", "gone", *(["carried"] if carry else []))
    more = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""

    @tidied
    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sizes, removed, runs, kept = [], [], [], []
                for text, own in zip(as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                    text = text or b""
                    own = merged((s["start"], s["end"]) for s in own or ())
                    if whole_characters:
                        own = [s for s in (characters(text, *s) for s in own) if s[0] < s[1]]
                    keep, at = [], 0
                    for a, b in own:
                        keep.append(text[at:a])
                        at = b
                    keep.append(text[at:])
                    rest = b"".join(keep)
                    sizes.append(len(text))
                    removed.append(len(text) - len(rest))
                    runs.append(len(own))
                    kept.append(rest)
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *part.schema.names[3:]])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + more)


def characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of [a, b) that is whole characters."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while a < b and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
