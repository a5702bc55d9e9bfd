"""Fields of two maps compared in batches: pairs of values are matched by (row, field) and their edit distances worked out together."""

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from docsift.functions.distance import by_characters
from docsift.functions.text import BLANKS

COUNTS = StructType([StructField("tp", IntegerType()), StructField("fp", IntegerType()), StructField("fn", IntegerType()), StructField("anls", DoubleType())])
SCORED = StructType([*COUNTS.fields, StructField("failed", BooleanType()), StructField("pred_total", StringType()), StructField("gt_total", StringType())])
PER_FIELD = ArrayType(StructType([StructField("field", StringType()), StructField("pred", StringType()), StructField("gt", StringType()), StructField("score", DoubleType()), StructField("matched", BooleanType())]))


def plain(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def similarities(a: pa.Array, b: pa.Array, threshold: float) -> np.ndarray:
    """As metrics.anls: the normalised similarity of each pair if it reaches the threshold, else 0. Only pairs that differ, and whose lengths allow it, are compared."""
    out = plain(pc.equal(a, b)).astype(float)
    m, n = plain(pc.utf8_length(a)).astype(np.int64), plain(pc.utf8_length(b)).astype(np.int64)
    longest = np.maximum(m, n)
    most = np.floor(longest * (1 - threshold) + 1e-9)
    own = np.flatnonzero((out == 0) & (np.abs(m - n) <= most))
    if len(own):
        at = pa.array(own)
        d = by_characters(plain(a.take(at)).tolist(), plain(b.take(at)).tolist())
        out[own] = np.where(d <= most[own], 1 - d / longest[own], 0.0)
    return np.where(out >= threshold, out, 0.0)


def entries(m: pa.MapArray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of all maps of a batch: each entry's row, its key and its value; null values are empty."""
    offsets = plain(m.offsets)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    return np.repeat(np.arange(len(m)), np.diff(offsets)), m.keys.slice(first, n), pc.fill_null(m.items.slice(first, n), "")


def missing(pred: pa.Array, gt: pa.Array) -> np.ndarray:
    return plain(pred.is_null()) | plain(gt.is_null())


class Pairs:
    """The fields of either map, by row: those of pred in its order, then those that only gt has."""

    def __init__(self, pred: pa.MapArray, gt: pa.MapArray, threshold: float):
        (rows_p, keys_p, values_p), (rows_g, keys_g, values_g) = entries(pred), entries(gt)
        keys = pa.concat_arrays([keys_p, keys_g])
        codes = keys.dictionary_encode()
        kinds = max(1, len(codes.dictionary))
        ids = np.concatenate([rows_p, rows_g]) * kinds + plain(codes.indices).astype(np.int64)
        n = len(rows_p)
        order = np.argsort(ids[n:], kind="stable")
        there = ids[n:][order]
        at = np.minimum(np.searchsorted(there, ids[:n]), max(0, len(there) - 1))
        of = np.where(there[at] == ids[:n], order[at], -1) if len(there) else np.full(n, -1)
        alone = np.ones(len(rows_g), bool)
        alone[of[of >= 0]] = False
        alone = np.flatnonzero(alone)
        in_p, in_g = np.concatenate([np.arange(n), np.full(len(alone), -1)]), np.concatenate([of, alone])
        self.row = np.concatenate([rows_p, rows_g[alone]])
        sort = np.argsort(self.row, kind="stable")
        self.row, in_p, in_g = self.row[sort], in_p[sort], in_g[sort]
        self.field = keys.take(pa.array(np.where(in_p >= 0, in_p, n + in_g)))
        p, g = (pc.fill_null(v.take(pa.array(i, pa.int64(), mask=i < 0)), "") for v, i in ((values_p, in_p), (values_g, in_g)))
        self.pred, self.gt = (pc.utf8_trim(v, characters=BLANKS) for v in (p, g))
        self.score = similarities(self.pred, self.gt, threshold)
        same = plain(pc.and_(pc.equal(p, self.pred), pc.equal(g, self.gt)))
        self.whole = self.score.copy()  # of the values as they are
        if not same.all():
            other = pa.array(~same)
            self.whole[~same] = similarities(p.filter(other), g.filter(other), threshold)
        self.whole[in_g < 0] = 0.0
        self.has_pred, self.has_gt = plain(pc.not_equal(self.pred, "")), plain(pc.not_equal(self.gt, ""))
        self.same = self.has_pred & self.has_gt & (plain(pc.equal(self.pred, self.gt)) | (self.score > 0))


def counts(pred: pa.MapArray, gt: pa.MapArray, threshold: float) -> list[pa.Array]:
    """tp, fp, fn and anls of each row, as counted has them."""
    x, n = Pairs(pred, gt, threshold), len(pred)
    none = missing(pred, gt)
    count = lambda mask: pa.array(np.bincount(x.row[mask], minlength=n).astype(np.int32), mask=none)
    sizes = np.diff(plain(gt.offsets))
    mean = np.bincount(x.row, weights=x.whole, minlength=n) / np.maximum(sizes, 1)
    return [count(x.same), count(x.has_pred & ~x.same), count(x.has_gt & ~x.same), pa.array(mean)]


def chosen(m: pa.MapArray, key: str) -> pa.Array:
    """The value of a key in each map; null if it has none."""
    rows, keys, values = entries(m)
    own = np.flatnonzero(plain(pc.equal(keys, key)))
    at = np.full(len(m), -1)
    at[rows[own]] = own
    return values.take(pa.array(at, mask=at < 0))


@cache
def counted(threshold: float):
    """struct(tp, fp, fn, anls): how many fields match, are wrong or too many, are wrong or missing; and the mean similarity over the fields of gt, 0 without any. Null maps have no counts."""

    def batch(pred: pa.Array, gt: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(counts(pred, gt, threshold), COUNTS.fieldNames())

    batch.__annotations__ = {"pred": pa.Array, "gt": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, COUNTS)


@cache
def scored(threshold: float, total: str):
    """As counted, with all else that is asked of the maps, so that they are worked out for this alone: whether pred is null (failed), and the field total in both."""

    def batch(pred: pa.Array, gt: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([*counts(pred, gt, threshold), pred.is_null(), chosen(pred, total), chosen(gt, total)], SCORED.fieldNames())

    batch.__annotations__ = {"pred": pa.Array, "gt": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, SCORED)


@cache
def listed(threshold: float):
    """An array of (field, pred, gt, score, matched) over the fields that either map has a value for; null if a map is null."""

    def batch(pred: pa.Array, gt: pa.Array) -> pa.Array:
        x, n = Pairs(pred, gt, threshold), len(pred)
        there = x.has_pred | x.has_gt
        mask = pa.array(there)
        matched = x.has_pred & x.has_gt & (x.score > 0)
        each = pa.StructArray.from_arrays([x.field.filter(mask), x.pred.filter(mask), x.gt.filter(mask), pa.array(x.score[there]), pa.array(matched[there])], ["field", "pred", "gt", "score", "matched"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(x.row[there], np.arange(n + 1)), pa.int32()), each, mask=pa.array(missing(pred, gt)))

    batch.__annotations__ = {"pred": pa.Array, "gt": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, PER_FIELD)
