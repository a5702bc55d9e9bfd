"""URL filtering by rules and by path-template trees, in DataFrame operations.

A rule is a host and the start of a path; it fits that host and its subdomains, and the longest that fits decides. URLs
that a rule decides are the labelled examples of the method: for each host a tree of path templates is grown from their shapes. Segments with digits
are variable, a wildcard. A round extends each template by all segments that its paths share, so that levels without branches cost nothing, and then
branches it. A branch is compared with all its siblings together: by the shares of its URLs that are blocked, allowed and unlabelled, and of those that end there, go on
with a variable segment, or with another. If no share differs by more than chance would, the branch is merged into the wildcard.

A template is rejected if its purity, the share of blocked URLs among its labelled ones, reaches the threshold. It is smoothed towards the share of
blocked URLs among all of its parent's, that one towards the grandparent's, up to the host and the prior: so a template without labels is
rejected where most of what stands beside it is blocked, and a host with one bad branch keeps the others.

Counts are taken per host and shape before anything else, so a frequent host is a few rows. They and each round are written to the shared folder. There are as many
rounds as a path has branchings.

A null URL, or one without ://, has an empty host and path, no rule, and is judged as the template of the empty host.
Repeated rows are kept as they are. Very long paths are compared whole. Empty table: no rows. Extra columns are left out, whatever their names.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import written

#: Fixed values: (verdict, host, start of the path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url):
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host, path, rules):
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, prior: float = 0.1, weight: float = 4.0, errors: float = 2.0, least: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    prior, weight: the share of blocked URLs that smoothing assumes of a host, and what a prior weighs in URLs. errors: by how many standard errors a branch's share may differ from
    all its siblings' when it is merged. least: a template of fewer URLs isn't branched further.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("shape", F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s)))
    blocked, labelled = F.sum((F.col("fit.verdict") == "block").cast("long")), F.count("fit")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.coalesce(blocked, F.lit(0)).alias("blocked"), labelled.alias("labelled"))
    grown = written(shapes.select("*", F.array().cast("array<string>").alias("template"), F.lit(prior).alias("prior")), "shapes")
    closed = []
    while True:
        groups = grown.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"), F.min(rest()).alias("low"), F.max(rest()).alias("high"))
        # in their order, the least and the greatest share what all share
        same = F.zip_with(F.slice("low", 1, F.least(F.size("low"), F.size("high"))), F.slice("high", 1, F.least(F.size("low"), F.size("high"))), lambda a, b: a == b)
        groups = groups.withColumn("shared", F.coalesce(F.array_position(same, False) - 1, F.lit(-1))).withColumn("shared", F.when(F.col("shared") < 0, F.size(same)).otherwise(F.col("shared")).cast("int"))
        split = groups.where((F.col("low") != F.col("high")) & (F.col("all_n") >= least)).select("host", "template", "shared", "all_n", "all_blocked")
        split = written(split, "split")
        closed.append(grown.join(split, ["host", "template"], "left_anti"))
        if split.isEmpty():
            break
        grown = written(branched(grown.join(split, ["host", "template"]), weight, errors), "round")
    grown = written(reduce(DataFrame.unionByName, closed), "templates")
    purity = grown.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.max("prior").alias("prior"))
    rejected = purity.where((F.col("b") + F.col("prior") * weight) / (F.col("l") + weight) >= threshold).select("host", "template")
    decided = written(grown.join(rejected, ["host", "template"]).select("host", "shape", F.lit(True).alias("reject")), "rejected")
    # only what no rule decides asks for its template
    open_ = rows.where("fit is null").join(decided, ["host", "shape"], "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("reject"), "block").otherwise("allow").alias("verdict"))
    return rows.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict").unionByName(open_)


def rest():
    """What of a shape comes after its template."""
    return F.slice("shape", F.size("template") + 1, F.greatest(F.size("shape") - F.size("template"), F.lit(0)))


def branched(grown: DataFrame, weight: float, errors: float) -> DataFrame:
    """grown (host, shape, template, prior, counts, and of its template: shared, all_n, all_blocked) with each template longer by what it shares and by its branch, or by
    an empty segment where a path ends, and with the template's own smoothed share as the branch's prior."""
    at = F.size("template") + F.col("shared")
    grown = grown.select("*", F.coalesce(F.get("shape", at), F.lit("")).alias("segment"), F.get("shape", at + 1).alias("next"))
    n, unlabelled = F.col("n"), F.col("n") - F.col("labelled")
    counts = {"n": n, "blocked": F.col("blocked"), "allowed": F.col("labelled") - F.col("blocked"), "unlabelled": unlabelled, "end": F.when(F.col("next").isNull(), n).otherwise(0), "variable": F.when(F.col("next") == "*", n).otherwise(0)}
    children = grown.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(k) for k, c in counts.items()))
    siblings = children.where("segment <> ''").groupBy("host", "template").agg(*(F.sum(k).alias(f"pool_{k}") for k in counts))
    judged = children.join(siblings, ["host", "template"], "left")

    def alike(k: str):
        pooled = F.col(f"pool_{k}") / F.col("pool_n")
        return F.abs(F.col(k) / F.col("n") - pooled) <= errors * F.sqrt(pooled * (1 - pooled) / F.col("n")) + 1e-9

    merged = (F.col("segment") != "") & reduce(lambda a, b: a & b, [alike(k) for k in counts if k != "n"])
    branch = judged.select("host", "template", "segment", F.when(merged, F.lit("*")).otherwise(F.col("segment")).alias("branch"))
    longer = F.concat("template", F.slice("shape", F.size("template") + 1, F.col("shared")), F.array("branch"))
    prior = (F.col("all_blocked") + weight * F.col("prior")) / (F.col("all_n") + weight)
    return grown.join(branch, ["host", "template", "segment"]).select("host", "shape", "n", "blocked", "labelled", longer.alias("template"), prior.alias("prior"))
