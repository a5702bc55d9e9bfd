"""Grids of configurations, their statistics, and the table of results."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import openjson
from docsift.functions.metrics import set_f1
from docsift.functions.text import price_key, strip
from docsift.operators.ranges import medians


def with_configs(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """Every sample with every configuration. configs is a driver-made dimension of a few rows, hence broadcast."""
    return samples.join(F.broadcast(configs), F.lit(True))


def summarise(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, exact median and count of each metric by keys; an empty group has no row, a group of nulls has null means.

    scores are read once, for all metrics; no group's values are held in one task.
    """
    found = medians(scores, keys, {m: F.col(m) for m in metrics})
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(of(m, c).alias(f"{m}_{c}") for m in metrics for c in ("mean", "median")))


def ordered_scores(scores: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """The scores of each group as one array, in the order of the samples. For groups that fit a row, such as one configuration's on one sample set."""
    return scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s"))))["s"].alias("scores"))


def split_counts(split: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """(split, images, annotations): how many rows each split has, and how many of them are annotated."""
    known = annotations.select(key).distinct().withColumn("known", F.lit(True))
    return split.join(known, key, "left").groupBy("split").agg(F.count("*").alias("images"), F.count("known").alias("annotations"))


def stage_deltas(rows: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """With delta to the stage before (the first as it is), total (the running sum of deltas) and relative change."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    delta = F.col(value) - F.coalesce(before, F.lit(0.0))
    return rows.withColumn("delta", delta).withColumn("total", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("relative", F.try_divide(F.col(value) - before, before))


def upsert(old: DataFrame, new: DataFrame, key: str = "exp") -> DataFrame:
    """new replaces all rows of its keys; old rows of other keys stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resume(tasks: DataFrame, done: DataFrame, key: str, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Tasks that aren't done, the first of them if a limit is given (0 and None: all)."""
    left = tasks.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(*(order or [key])).limit(limit) if limit else left


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key).distinct(), key, "left_semi")


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, n, density) of equal bins from the least to the greatest value, the last closed; every value that isn't null is in one.

    A single value gets a range of one around it, as in NumPy.
    """
    v = F.col(value).cast("double")
    ends = rows.agg(F.min(v).alias("low"), F.max(v).alias("high"))
    half = F.when(F.col("low") == F.col("high"), F.lit(0.5)).otherwise(F.lit(0.0))
    ends = ends.select((F.col("low") - half).alias("low"), ((F.col("high") - F.col("low") + 2 * half) / bins).alias("width"))
    at = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = rows.select(v.alias("v")).where("v is not null").crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "width").agg(F.count("*").alias("n"))
    return counts.select("bin", "n", (F.col("n") / (F.sum("n").over(Window.partitionBy()) * F.col("width"))).alias("density"))


def statistics(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, std, min, median, max) of the values that aren't null, exact."""
    v = F.col(value)
    plain = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = medians(rows, by, {"value": v})
    same = reduce(Column.__and__, (plain[k].eqNullSafe(middle[k]) for k in by), F.lit(True))
    return plain.join(middle, same).select(*(plain[c] for c in (*by, "n", "mean", "std", "min")), "median", plain["max"])


def completeness(receipts: DataFrame, receipt: str = "receipt") -> DataFrame:
    """(field, present, total): how many receipts have each scalar field, and how many items each item field. One aggregation."""
    r = F.col(receipt)
    scalar = {f"{s}.{k}": r[s][k].isNotNull() for s, ks in (("total", ("total_price", "cashprice", "changeprice")), ("sub_total", ("subtotal_price", "tax_price", "service_price", "discount_price"))) for k in ks}
    have = lambda k: F.size(F.filter(r["menu"], lambda m: m[k].isNotNull()))
    sums = receipts.agg(F.count("*").alias("n"), F.sum(F.size(r["menu"])).alias("items"), *(F.count_if(c).alias(f"s{i}") for i, c in enumerate(scalar.values())), *(F.sum(have(k)).alias(f"m_{k}") for k in ("nm", "cnt", "price")))
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), F.col(a).cast("long").alias("present"), F.col(b).cast("long").alias("total"))
    return sums.select(F.inline(F.array(*(row(name, f"s{i}", "n") for i, name in enumerate(scalar)), *(row(f"menu.{k}", f"m_{k}", "items") for k in ("nm", "cnt", "price")))))


def key_completeness(rows: DataFrame, json: Column, fields: tuple[str, ...] = openjson.FIELDS, items: str = "menu") -> DataFrame:
    """(field, present, nulls, total): how many receipts, or for fields of items how many items, have the key at all, and how many have it as null. One aggregation."""
    each = rows.select(openjson.presence(openjson.parsed(json), fields, items).alias("p"))
    sums = each.agg(F.count("*").alias("n"), F.coalesce(F.sum("p.n_items"), F.lit(0)).alias("items"), *(F.coalesce(F.sum(f"p.{k}_{i}"), F.lit(0)).alias(f"{k}_{i}") for i in range(len(fields)) for k in ("there", "null")))
    row = lambda i, f: F.struct(F.lit(f).alias("field"), F.col(f"there_{i}").alias("present"), F.col(f"null_{i}").alias("nulls"), F.col("items" if f.startswith(f"{items}.") else "n").alias("total"))
    return sums.select(F.inline(F.array(*(row(i, f) for i, f in enumerate(fields)))))


def items_per_receipt(rows: DataFrame, json: Column, by: list[str] = (), items: str = "menu") -> DataFrame:
    """(by, n, mean, std, min, median, max) of how many items receipts have; an object counts as one, a missing or null list as none."""
    own = rows.select(*by, F.size(openjson.elements(openjson.at(openjson.parsed(json), items))).alias("items"))
    return statistics(own, "items", list(by))


def compare_parsers(rows: DataFrame, parsers: dict[str, str]) -> DataFrame:
    """(parser, files, texts, answered, totals, total_matches, by_files, by_texts, by_totals, menu_f1) of each parser (its name and its column).

    rows: text, gt (the true receipt), and a receipt for each parser, null where it failed. Blank texts are left out, but count as files. Totals match if they are
    the same without separators; two missing ones match, too. A failure is no match and an f1 of 0. The rates differ in what they divide by: all files,
    those with text, those with a true total. One pass over the rows, with a row for each parser and file; what is true of a file is worked out once for all parsers.
    """
    total = lambda r: price_key(F.coalesce(F.when(r.isNotNull(), r["total"]["total_price"]), F.lit("")))
    prices = lambda r: F.coalesce(F.transform(r["menu"], lambda m: strip(F.coalesce(m["price"], F.lit("")))), F.array().cast("array<string>"))
    own = lambda c: F.struct(total(F.col(c)).alias("total"), prices(F.col(c)).alias("prices"))
    there = F.coalesce(F.trim("text") != "", F.lit(False))
    known = rows.select(there.alias("there"), own("gt").alias("gt"), *(F.when(F.col(c).isNotNull(), own(c)).alias(f"of_{i}") for i, c in enumerate(parsers.values())))
    f1 = lambda r: F.when(r.isNull(), 0.0).otherwise(set_f1(r["prices"], F.col("gt.prices"))["f1"])
    one = lambda name, r: F.struct(F.lit(name).alias("parser"), r.isNotNull().alias("answered"), (r.isNotNull() & (r["total"] == F.col("gt.total"))).alias("match"), F.when(F.col("there"), f1(r)).alias("f1"))
    each = known.select("there", (F.col("gt.total") != "").alias("has_total"), F.explode(F.array(*(one(n, F.col(f"of_{i}")) for i, n in enumerate(parsers)))).alias("p")).select("there", "has_total", "p.*")
    n = lambda name, *of: F.count_if(reduce(Column.__and__, map(F.col, ("there", *of)))).alias(name)
    sums = each.groupBy("parser").agg(F.count("*").alias("files"), n("texts"), n("answered", "answered"), n("totals", "has_total"), n("total_matches", "match"), n("m", "match", "has_total"), F.avg("f1").alias("menu_f1"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return sums.where("texts > 0").select("parser", "files", "texts", "answered", "totals", "total_matches", rate("total_matches", "files").alias("by_files"), rate("total_matches", "texts").alias("by_texts"), rate("m", "totals").alias("by_totals"), "menu_f1")


def sample_variants(images: DataFrame, variants: list[str], k: int, key: str, order: list[Column] | None = None, seed: int = 42) -> DataFrame:
    """k of the variants for each image, by a seeded hash or the given order. No shuffle: variants are ranked in an array."""
    if order is None:
        ranked = F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.col(key), F.lit(v)).alias("h"), F.lit(v).alias("degradation")) for v in variants)))
    else:
        ranked = F.array_sort(F.array(*(F.struct(o.alias("h"), F.lit(v).alias("degradation")) for v, o in zip(variants, order, strict=True))))
    return images.withColumn("degradation", F.explode(F.slice(ranked["degradation"], 1, k)))
