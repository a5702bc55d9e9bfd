"""Error rates and field scores as Column expressions. Null inputs count as empty texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import fields
from docsift.functions.arrays import let
from docsift.functions.distance import text_rates
from docsift.functions.text import strip, tokens

ANLS_THRESHOLD = 0.5


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _rate(distance: Column, empty_pred: Column, n_gt: Column) -> Column:
    """0 for two empty texts, 1 for something where nothing is; may exceed 1 otherwise."""
    return F.when(n_gt == 0, F.when(empty_pred, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / n_gt)


def cer(pred: Column, gt: Column) -> Column:
    """Character error rate, by code points."""
    pred, gt = _text(pred), _text(gt)
    return _rate(F.levenshtein(pred, gt).cast("double"), pred == "", F.length(gt))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens: each distinct token of the pair becomes one character, from U+0100 on."""
    coded = lambda x, known: F.array_join(F.transform(x, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + 255), 4, "0")), "UTF-16BE")), "")
    return let(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(coded(a, known), coded(b, known)))


def wer(pred: Column, gt: Column) -> Column:
    """Word error rate."""
    p, g = tokens(_text(pred)), tokens(_text(gt))
    return _rate(token_distance(p, g).cast("double"), F.size(p) == 0, F.size(g))


def nls(a: Column, b: Column) -> Column:
    """Normalised Levenshtein similarity; 1 for two empty texts."""
    a, b = _text(a), _text(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def at_least(s: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """A similarity if it reaches the threshold, else 0."""
    return F.when(s >= threshold, s).otherwise(F.lit(0.0))


def anls(pred: Column, gt: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """The similarity if it reaches the threshold, else 0.

    A similarity that reaches it has a distance of at most so much of the longer text; texts whose lengths differ by more are not compared, and a comparison ends where it exceeds that.
    """
    a, b = _text(pred), _text(gt)
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * F.lit(1 - threshold) + 1e-9).cast("int")
    distance = F.when(F.abs(F.length(a) - F.length(b)) <= most, F.call_function("levenshtein", a, b, most)).otherwise(F.lit(-1))
    near = F.when(a == b, F.lit(1.0)).otherwise(let(distance, lambda d: F.when(d >= 0, 1 - d / longest).otherwise(F.lit(0.0))))
    return let(near, lambda s: at_least(s, threshold))


def exact_match(a: Column, b: Column, normalize: bool = True) -> Column:
    a, b = _text(a), _text(b)
    return (F.lower(strip(a)) == F.lower(strip(b))) if normalize else a == b


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def set_f1(pred: Column, gt: Column) -> Column:
    """struct(precision, recall, f1) of two arrays as sets, without empty values. Both empty: 1, 1, 1; only gt: 0, 1, 0; only pred: 1, 0, 0."""
    clean = lambda x: F.array_distinct(F.filter(x, lambda v: v.isNotNull() & (v != "")))
    p, g = clean(pred), clean(gt)
    sizes = lambda s: F.struct(F.size(F.array_intersect(s["p"], s["g"])).alias("both"), F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g"))

    def scores(n: Column) -> Column:
        precision = F.when(n["g"] == 0, F.when(n["p"] == 0, 1.0).otherwise(0.0)).when(n["p"] == 0, 1.0).otherwise(ratio(n["both"], n["p"]))
        recall = F.when(n["g"] == 0, 1.0).when(n["p"] == 0, 0.0).otherwise(ratio(n["both"], n["g"]))
        return F.struct(precision.alias("precision"), recall.alias("recall"), F.when((n["p"] == 0) & (n["g"] == 0), 1.0).otherwise(f1_of(precision, recall)).alias("f1"))

    return let(let(F.struct(p.alias("p"), g.alias("g")), sizes), scores)


def field_counts(pred: Column, gt: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """struct(tp, fp, fn) over the fields of two maps. A field that both have but that doesn't match is an fp and an fn."""
    c = fields.counted(threshold)(pred, gt)
    return F.struct(*(c[k].alias(k) for k in ("tp", "fp", "fn")))


def field_f1(pred: Column, gt: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """struct(tp, fp, fn, precision, recall, f1)."""
    return _field_f1(field_counts(pred, gt, threshold))


def _field_f1(c: Column) -> Column:
    precision, recall = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    return F.struct(c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn"), precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"))


def joined_field_counts(pred: DataFrame, gt: DataFrame, key: str, threshold: float = ANLS_THRESHOLD) -> DataFrame:
    """(key, tp, fp, fn) from long tables (key, field, pred) and (key, field, gt), which may be any size."""
    p, g = strip(F.coalesce("pred", F.lit(""))), strip(F.coalesce("gt", F.lit("")))
    rows = pred.join(gt, [key, "field"], "full_outer").select(key, p.alias("p"), g.alias("g")).where("p <> '' or g <> ''")
    match = (F.col("p") == F.col("g")) | (anls(F.col("p"), F.col("g"), threshold) > 0)
    code = F.when(F.col("g") == "", 2).when(F.col("p") == "", 3).when(match, 1).otherwise(4)
    n = lambda name, *of: F.count_if(F.col("code").isin(*of)).cast("int").alias(name)
    return rows.select(key, code.alias("code")).groupBy(key).agg(n("tp", 1), n("fp", 2, 4), n("fn", 3, 4))


def mean_anls(pred: Column, gt: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """Over the fields of gt; a field that pred lacks counts as empty. 0 without fields."""
    return fields.counted(threshold)(pred, gt)["anls"]


def field_scores(pred: Column, gt: Column, total: str = "total.total_price", threshold: float = ANLS_THRESHOLD) -> Column:
    """struct(failed, f1, anls, total_em) of two maps; fields that couldn't be had (null: failed) score 0. The maps are read in one place only: what makes them is worked out once."""
    c = fields.scored(threshold, total)(pred, gt)
    zero = lambda s: F.when(c["failed"], F.lit(0.0)).otherwise(s)
    em = F.when(exact_match(c["pred_total"], c["gt_total"]), 1.0).otherwise(0.0)
    return F.struct(c["failed"].alias("failed"), zero(_field_f1(c)["f1"]).alias("f1"), zero(c["anls"]).alias("anls"), zero(em).alias("total_em"))


def field_text(values: Column) -> Column:
    """The values of a map of fields, joined by blanks, in the map's order."""
    return F.array_join(F.map_values(values), " ")


def receipt_report(pred: Column, gt: Column, total: str = "total.total_price") -> Column:
    """struct(cer, wer, total_exact_match, n_pred, n_gt): error rates of all values as one text, and whether the totals are the same."""
    of = lambda m: F.coalesce(F.try_element_at(m, F.lit(total)), F.lit(""))
    rates = text_rates(field_text(pred), field_text(gt))
    return F.struct(rates["cer"].alias("cer"), rates["wer"].alias("wer"), exact_match(of(pred), of(gt)).alias("total_exact_match"), F.size(pred).alias("n_pred"), F.size(gt).alias("n_gt"))


def per_field(pred: Column, gt: Column, threshold: float = ANLS_THRESHOLD) -> Column:
    """An array of (field, pred, gt, score, matched) over the fields that either map has a value for."""
    return fields.listed(threshold)(pred, gt)
