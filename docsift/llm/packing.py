"""Packing token sequences by patterns fitted with non-negative least squares.

Documents become token pieces of at most the capacity. How many pieces have each length is all that the plan needs: at
most as many numbers as the capacity, whatever the input. Lengths are grouped; patterns are the ways in which up to four
groups fill a sequence; a non-negative least-squares fit of the patterns' repeat counts to the histogram, rounded down,
is packed first, as far as that pays. What is left, and the room left in the patterns, is filled best fit first, longest pieces first, again
by counts. Pieces find their places by their rank among those of their length.

Nulls: a null text is empty and has the end token alone. A null id is kept. Empty table: no rows. Repeated rows are
packed as often as they occur.
"""

import zlib
from bisect import bisect_left, bisect_right, insort
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import slices, tidied, written

CAPACITY, END_ID = 4096, 1
GROUPS, MOST_IN_PATTERN = 64, 4
MOST_WORDS = 120_000
#: Into so many parts the fit's repeat counts are divided to see how much of them pays.
SHARES = 16


# --- tokens ---------------------------------------------------------------------------------------------------------


#: How the vocabulary file parts a text without white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Recent(dict):
    """The ids, packed, of what was looked up lately: two generations of about so many entries."""

    def __init__(self, most: int = MOST_WORDS):
        self.older: dict[str, bytes] = {}
        self.most = most

    def all(self, keys: list[str], make) -> list[bytes]:
        """The values of distinct keys. make: gives those of a list of keys that aren't known."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        out = list(map(self.get, keys))
        lacking = [i for i, v in enumerate(out) if v is None]
        for i in lacking:
            out[i] = self.older.get(keys[i])
        new = [i for i in lacking if out[i] is None]
        for i, v in zip(new, make([keys[i] for i in new]), strict=True):
            out[i] = v
        self.update((keys[i], out[i]) for i in lacking)
        return out


def gathered(flat: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds entries of these sizes one after another; those of code in a row, and where each of them ends."""
    n = sizes[code]
    until = np.cumsum(n)
    at = np.repeat(((np.cumsum(sizes) - sizes)[code] - until + n).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], until


class Words:
    """Token ids of texts. Words are runs of anything but white space, which this vocabulary drops, so a text's ids are those of
    its words in turn. Arrow splits texts, numbers the distinct words and cuts them as the vocabulary does; only distinct
    parts that are new go to its merge model.

    Words that may hold special strings, U+001C-1F or characters from U+0250 on go to the library whole.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words, self.parts = Recent(), Recent()
        self.odd = re.compile("[\x1c-\x1f]")  # white space to Arrow and str.split, but not to the vocabulary
        self.white = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        #: What stands for each byte in the vocabulary: itself if it can be printed, else the next character from 256 on.
        self.stand_ins = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}

    def split(self, texts: pa.Array) -> pa.ListArray:
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            return pa.array([[w for w in self.white.split(t) if w] if self.odd.search(t) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))
        return pc.utf8_split_whitespace(texts)  # with an empty string where a text begins or ends with white space

    def of_parts(self, parts: list[str]) -> list[bytes]:
        raw = [p if p.isascii() else p.encode().decode("latin-1").translate(self.stand_ins) for p in parts]
        return [np.array([t.id for t in self.model.tokenize(p)], "<u4").tobytes() if p else b"" for p in raw]

    def of_words(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), 2_000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words[k : k + 2_000], add_special_tokens=False)]
        return out

    def packed(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last's end)."""
        split = self.split(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        whole = pc.match_substring_regex(coded.dictionary, "[\x1c-\x1f<\u0130\u0250-\U0010ffff]")
        cut = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary.filter(pc.invert(whole))), PRE_TOKEN, "\\0 ")
        cut = pc.split_pattern(pc.utf8_rtrim(cut, " "), " ")
        parts = cut.flatten().dictionary_encode()
        ids, until = gathered(*self.packed(self.parts.all(parts.dictionary.to_pylist(), self.of_parts)), parts.indices.to_numpy())
        ends = np.concatenate([[0], until])[np.cumsum(pc.list_value_length(cut).to_numpy())]
        others, other_sizes = self.packed(self.words.all(coded.dictionary.filter(whole).to_pylist(), self.of_words))
        # the distinct words in this order: those that were cut, then the others
        whole = whole.to_numpy(zero_copy_only=False)
        number = np.where(whole, np.cumsum(whole) - 1 + len(ends), np.cumsum(~whole) - 1)
        sizes = np.concatenate([np.diff(ends, prepend=0), other_sizes])
        out, until = gathered(np.concatenate([ids, others]), sizes, number[coded.indices.to_numpy()])
        return out, np.concatenate([[0], until])[offsets - offsets[0]]


@cache
def words(path: str) -> Words:
    return Words(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and end token, cut after every capacity ids."""

    @tidied
    def run(batches):
        encode = words(path).ids
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                out = []
                ids, first = encode(part.column(1))
                for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID))
                    for k, i in enumerate(range(0, len(own), capacity)):
                        piece = own[i : i + capacity]
                        out.append((doc, k, i, len(piece), zlib.crc32(piece)))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


# --- the plan -------------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| small, by an active set: the column of steepest descent enters, columns that fall to 0 leave."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, float(b.max())):
            break
        inside[k] = True
        while True:
            at = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if not len(at) or z.min() > 1e-12:
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            out = at[low & (x[at] <= 1e-12 * max(1.0, float(b.max())))]
            if not len(out):
                out = at[low][:1]
            x[out] = 0
            inside[out] = False
    return x


def fitted(histogram: dict[int, int], capacity: int, groups: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (groups of lengths, the longest first) and how often the fit repeats them. Group g holds the lengths up to g / groups of the
    capacity; lengths in the lowest sixteenth are kept back for the room that is left."""
    least = groups // 16 + 1
    ways = [(*w[::-1],) for k in range(1, most + 1) for v in combinations_with_replacement(range(least, groups + 1), k - 1) if (r := groups - sum(v)) >= (v[-1] if v else least) for w in [(*v, r)]]
    a = np.zeros((groups, len(ways)))
    for j, way in enumerate(ways):
        for g in way:
            a[g - 1, j] += 1
    b = np.zeros(groups)
    for n, c in histogram.items():
        b[-(-n * groups // capacity) - 1] += c
    b[: least - 1] = 0
    scale = max(1.0, b.max())
    repeats = np.floor(nnls(a, b / scale) * scale + 1e-6).astype(np.int64)
    return [(ways[j], int(repeats[j])) for j in np.argsort(-repeats, kind="stable") if repeats[j]]


def filled(histogram: dict[int, int], capacity: int, groups: int, ways: list[tuple[tuple[int, ...], int]]) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences that follow ways as far as lengths are there, and then best fit, the longest first, for what is left.

    All slots but the last of a way take the longest of their group; the last takes the longest that fits, so that little room is lost.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    there = sorted(left)
    group = lambda n: -(-n * groups // capacity)
    open_: dict[int, list[list]] = {}  # by room left: [pattern, repeats]
    rooms: list[int] = []

    def put(room: int, pattern: list, times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, times])

    def longest(most: int, taken: dict[int, int]) -> int | None:
        for i in range(bisect_right(there, most) - 1, -1, -1):
            if left[there[i]] > taken.get(there[i], 0):
                return there[i]
        return None

    for way, times in ways:
        while times > 0:
            taken: dict[int, int] = {}
            room = capacity
            for slot, g in enumerate(way):
                last = slot == len(way) - 1
                n = longest(room if last else g * capacity // groups, taken)
                if n is None or (not last and group(n) != g) or (last and 2 * group(n) < g):
                    taken = {}
                    break
                taken[n] = taken.get(n, 0) + 1
                room -= n
            if not taken:
                break
            run = min(times, *(left[n] // c for n, c in taken.items()))
            for n, c in taken.items():
                left[n] -= c * run
                if not left[n]:
                    del left[n]
                    there.remove(n)
            put(room, list(taken.items()), run)
            times -= run

    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                k = capacity // n
                put(capacity, [], max(1, c // k))
                continue
            room = rooms[i]
            pattern, times = open_[room][-1]
            k = min(room // n, c)
            run = min(times, c // k)
            if run == times:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                open_[room][-1][1] -= run
            put(room - k * n, [*pattern, (n, k)], run)
            c -= k * run
    return [(pattern, times) for of in open_.values() for pattern, times in of if pattern]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, most: int = MOST_IN_PATTERN) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many)], repeats) that hold each length as often as the histogram says.

    The fit's repeat counts are rounded to lengths, so not all of them pay: of SHARES shares of them, the largest that gives the fewest sequences is packed first, and the
    rest best fit. The last share is none of them, so that the result is never worse than best fit alone.
    """
    groups = min(groups, capacity)
    ways = fitted(histogram, capacity, groups, most) if any(histogram.values()) else []
    least, best = -(-sum(n * c for n, c in histogram.items()) // capacity), None
    for share in range(SHARES, -1, -1):
        found = filled(histogram, capacity, groups, [(w, t * share // SHARES) for w, t in ways])
        size = sum(times for _, times in found)
        if best is None or size < best[0]:
            best = size, found
        if size == least:
            break
    return best[1]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, how many side by side, offset, first sequence), in order: where pieces of a length go by their rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n, k in pattern:
            rows.append((n, taken.get(n, 0), k, offset, sequence))
            taken[n] = taken.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, a written table of (doc_id, piece, start, length, ids_crc32), with sequence_id and offset.

    To the driver go the counts of each length, at most capacity rows; the plan has a few thousand rows. Ranks within a
    length are taken in groups by a hash of the piece; their number grows with the root of the most frequent length's count,
    so that neither a group nor the groups of a length are many rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = places(plan(histogram, capacity))
    dealt = max(1, round(max(histogram.values(), default=0) ** 0.5 / 4))
    table = spark.sparkContext.broadcast(table)
    rows = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(dealt)).cast("int"))
    counts = rows.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = counts.select("length", "deal", (F.sum("n").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "deal"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    @tidied
    def run(batches):
        t = table.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = t[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(rank) else np.empty((0, 5), np.int64)
            row, beside = np.divmod(rank - at[:, 1], np.maximum(at[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(at[:, 4] + row), pa.array(at[:, 3] + beside * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most capacity tokens."""
    return pack(written(token_pieces(docs, path, capacity, id_col, text_col), "pieces"), capacity)
