"""Edit distances of many pairs of whole texts in a task: rows of the dynamic programme as bits (Myers, Hyyrö), for a batch of pairs at a time. Exact for texts of any length.

It serves projections; a Python function can't stand in a lambda, where metrics.cer and its kin compare short texts in the JVM.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: White space as in metrics, where tokens are split by (?U)\\s+.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What str.split takes for white space besides.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORDS, BYTES, PAIRS = 8, 1 << 21, 4096
COUNTS = StructType([StructField(n, LongType()) for n in ("chars", "words", "gt_chars", "pred_words", "gt_words")])


def long_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Of one pair, with whole columns as numbers of any size; a isn't empty."""
    at: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, d = full, 0, len(a)
    for c in b.tolist():
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(level | up)), up & level
        d += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full & ~(level | more)), more & level
    return d


def flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of a flat array: every element's piece, its place there, and its place in the array."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return of, within, starts[of] + within


def short_distances(codes: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """Of pairs whose shorter text (from a, m long, not empty) has equally many 64-bit words, in descending order of n."""
    rows, width = len(m), int((m[0] + 63) // 64)
    where = np.zeros((rows * kinds, width), np.uint64)
    of, i, place = flat(a, m)
    np.bitwise_or.at(where, (of * kinds + codes[place], i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
    text = np.zeros((int(n[0]), rows), np.int64)
    of, i, place = flat(b, n)
    text[i, of] = of * kinds + codes[place]
    one, high = np.uint64(1), np.uint64(63)
    last = ((m - 1) % 64).astype(np.uint64)
    up, down = np.full((width, rows), ~np.uint64(0)), np.zeros((width, rows), np.uint64)
    d = m.astype(np.int64)
    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    for j, k in enumerate(live.tolist()):
        found = where[text[j, :k]]
        plus, minus = one, np.uint64(0)
        for w in range(width):
            p, q, same = up[w, :k], down[w, :k], found[:, w]
            level = same | q
            same = same | minus
            across = (((same & p) + p) ^ p) | same
            more, less = q | ~(across | p), p & across
            if w == width - 1:
                d[:k] += ((more >> last[:k]) & one).astype(np.int64) - ((less >> last[:k]) & one).astype(np.int64)
            out = more >> high, less >> high
            more, less = (more << one) | plus, (less << one) | minus
            up[w, :k], down[w, :k] = less | ~(level | more), more & level
            plus, minus = out
    return d


def band(m: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first of 64 * size diagonals (places in a less places in b) around those from start to end, and what a path that leaves them costs at least; there are more diagonals than sizes differ by."""
    more = (64 * size - 1 - np.abs(m - n)) // 2
    return np.minimum(0, m - n) - more, np.abs(m - n) + 2 * more + 2


def near_distances(codes: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, kinds: int, size: int) -> np.ndarray:
    """Of pairs in descending order of n, along the diagonals of band() alone, so many words for each element of b: exact where it is no more than a path that leaves them costs."""
    rows, first = len(m), band(m, n, size)[0]
    width = int(n[0] - 1) // 64 + size + 1
    where = np.zeros(rows * kinds * width, np.uint64)
    of, i, place = flat(a, m)
    i = i - first[of]  # so that the window of b's j-th element starts at bit j in every pair
    np.bitwise_or.at(where, (of * kinds + codes[place]) * width + (i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
    text = np.zeros((int(n[0]), rows), np.int64)
    of, i, place = flat(b, n)
    text[i, of] = (of * kinds + codes[place]) * width
    one, high = np.uint64(1), np.uint64(63)
    shift = lambda x: np.where((x >= 0) & (x < 64), x, 64).astype(np.uint64)
    end = [shift(m - n - first - 64 * w) for w in range(size)]
    up = [~np.uint64(0) << np.clip(-first - 64 * w, 0, 64).astype(np.uint64) for w in range(size)]
    down = [np.zeros(rows, np.uint64) for _ in range(size)]
    free = np.zeros(rows, np.uint64)  # steps along the last diagonal that cost nothing
    live = np.searchsorted(-n, -np.arange(int(n[0])), "left")
    for j, k in enumerate(live.tolist()):
        at = text[j, :k] + (j >> 6)
        found = [where.take(at)]
        for w in range(size):
            if j & 63 or w + 1 < size:
                at += 1
                found.append(where.take(at))
        across, over = [], None
        for w in range(size):
            p, same = up[w][:k], found[w]
            if j & 63:
                same = (same >> np.uint64(j & 63)) | (found[w + 1] << np.uint64(64 - (j & 63)))
            x = same & p
            x += p
            if size > 1:
                past = x < p
                if over is not None:
                    x += over
                    past |= x < over
                over = past.astype(np.uint64)
            x ^= p
            x |= same
            x |= down[w][:k]
            across.append(x)
            x = x >> end[w][:k]
            x &= one
            free[:k] += x
        for w in range(size):
            x, p, q = across[w], up[w][:k], down[w][:k]
            more = x | p
            np.invert(more, out=more)
            more |= q
            less = x & p
            x >>= one
            if w + 1 < size:
                x |= across[w + 1] << high
            np.bitwise_or(x, more, out=p)
            np.invert(p, out=p)
            p |= less
            np.bitwise_and(x, more, out=q)
    return np.maximum(m - n, 0) + n - free.astype(np.int64)


def edit_distances(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of pairs of texts given as flat arrays of numbers and the texts' sizes."""
    codes = np.concatenate([a, b]).astype(np.int64)
    known = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    known[codes] = 1
    kinds = int(known.sum())
    codes = (np.cumsum(known) - 1)[codes]
    x, y = np.cumsum(m) - m, len(a) + np.cumsum(n) - n
    longer = m > n
    x, y, m, n = np.where(longer, y, x), np.where(longer, x, y), np.minimum(m, n), np.maximum(m, n)
    out = n.astype(np.int64)
    width = (m + 63) // 64
    for size in (1, 2):
        own, at = np.flatnonzero((width > size) & (n - m < 64 * size)), 0
        own = own[np.argsort(-n[own], kind="stable")]
        while at < len(own):
            longest = int(n[own[at]])
            part = own[at : at + max(1, BYTES // (8 * max(longest, kinds * ((longest - 1) // 64 + size + 1))))]
            d = near_distances(codes, x[part], m[part], y[part], n[part], kinds, size)
            found = d <= band(m[part], n[part], size)[1]
            out[part[found]], width[part[found]] = d[found], 0
            at += len(part)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        own = own[np.argsort(-n[own], kind="stable")]
        if w > WORDS:
            out[own] = [long_distance(codes[x[i] : x[i] + m[i]], codes[y[i] : y[i] + n[i]]) for i in own.tolist()]
            continue
        at, most = 0, max(1, BYTES // (8 * w * kinds))
        while at < len(own):
            part = own[at : at + min(most, max(1, BYTES // (8 * int(n[own[at]]))))]
            out[part] = short_distances(codes, x[part], m[part], y[part], n[part], kinds)
            at += len(part)
    return out


def by_characters(a: list[str], b: list[str]) -> np.ndarray:
    flat_codes = lambda x: np.frombuffer("".join(x).encode("utf-32-le"), "<u4")
    sizes = lambda x: np.fromiter(map(len, x), np.int64, len(x))
    return edit_distances(flat_codes(a), sizes(a), flat_codes(b), sizes(b))


def words(texts: list[str]) -> list[list[str]]:
    return [[w for w in BLANK.split(t) if w] if SEPARATORS.search(t) else t.split() for t in texts]


def by_words(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """The distinct words of b's text are numbered, so that there are no more numbers than a text has words; all words that it lacks share one. A text of b that follows itself is numbered once."""
    left: list[int] = []
    right: list[int] = []
    last, number, own = None, {}, []
    for p, g in zip(a, b, strict=True):
        if g is not last:
            last, number = g, {}
            own = [number.setdefault(t, len(number) + 1) for t in g]
        left += [number.get(t, 0) for t in p]
        right += own
    sizes = lambda x: np.fromiter(map(len, x), np.int64, len(x))
    return edit_distances(np.array(left, np.int64), sizes(a), np.array(right, np.int64), sizes(b))


@F.arrow_udf(ArrayType(COUNTS))
def counted(preds: pa.Array, gt: pa.Array) -> pa.Array:
    """Of each row's texts, all compared with the row's gt."""
    p, of = pc.fill_null(pc.list_flatten(preds), "").to_pylist(), pc.list_parent_indices(preds).to_pylist()
    g = pc.fill_null(gt, "").to_pylist()
    gw = words(g)
    counts = {f.name: [] for f in COUNTS}
    for at in range(0, len(p), PAIRS):
        part, rows = p[at : at + PAIRS], of[at : at + PAIRS]
        pw, gs, gws = words(part), [g[i] for i in rows], [gw[i] for i in rows]
        for name, x in zip(counts, (by_characters(part, gs), by_words(pw, gws), [*map(len, gs)], [*map(len, pw)], [*map(len, gws)]), strict=True):
            counts[name].append(pa.array(x, pa.int64()))
    each = pa.StructArray.from_arrays([pa.chunked_array(x, pa.int64()).combine_chunks() for x in counts.values()], list(counts))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(g) + 1)), pa.int32()), each)


def text_rates_of(preds: list[Column], gt: Column) -> list[Column]:
    """struct(cer, wer) of each of several texts, as metrics.cer and metrics.wer give them; all are compared in one call, for which gt is sent and split once."""
    counts = counted(F.array(*preds), gt)
    rate = lambda distance, empty, n: F.when(n == 0, F.when(empty, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / n)
    each = [F.get(counts, F.lit(i)) for i in range(len(preds))]
    return [F.struct(rate(c["chars"], c["chars"] == 0, c["gt_chars"]).alias("cer"), rate(c["words"], c["pred_words"] == 0, c["gt_words"]).alias("wer")) for c in each]


def text_rates(pred: Column, gt: Column) -> Column:
    return text_rates_of([pred], gt)[0]
