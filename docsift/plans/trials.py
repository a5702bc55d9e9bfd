"""Samples and steps for the experiments, from orders as receipts: a receipt that is hard to read, and what makes it readable again. With SQL that gives the same values."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import receipts
from docsift.operators import registry
from docsift.plans.adapters import RECEIPTS_SQL
from docsift.plans.adapters import receipts as receipt_texts

#: A step: its expression, and the same in SQL.
PLAIN = {
    "detect": (lambda v: F.regexp_replace(v, "^~+ ", ""), lambda v: f"regexp_replace({v}, '^~+ ', '')"),
    "deskew": (lambda v: F.replace(v, F.lit("\n\t"), F.lit("\n")), lambda v: f"replace({v}, chr(10) || chr(9), chr(10))"),
    "bilateral": (lambda v: F.translate(v, "^", ""), lambda v: f"translate({v}, '^', '')"),
    "clahe": (lambda v: F.translate(v, "Ol", "01"), lambda v: f"translate({v}, 'Ol', '01')"),
    "blur": (lambda v: F.replace(v, F.lit(" x  "), F.lit(" x ")), lambda v: f"replace({v}, ' x  ', ' x ')"),
    "threshold": (lambda v: F.translate(v, "ai", "  "), lambda v: f"translate({v}, 'ai', '  ')"),
    "quarter": (lambda v: F.translate(v, "aeiou3", "ooooo8"), lambda v: f"translate({v}, 'aeiou3', 'ooooo8')"),
    "half": (lambda v: F.translate(v, "ae", "oc"), lambda v: f"translate({v}, 'ae', 'oc')"),
    "paddleocr": (lambda v: F.rtrim(v), lambda v: f"rtrim({v}, ' ')"),
    "tesseract": (lambda v: F.translate(v, "rt5", "fl6"), lambda v: f"translate({v}, 'rt5', 'fl6')"),
    "truth": (lambda v: F.col("gt"), lambda v: "text"),
}
ANSWERED = {"llm": 3, "llm_few_shot": 9}


def hard_to_read(text: Column) -> Column:
    """In a frame, slanted, with specks and misread digits. Every 50th sample has no image."""
    noisy = F.translate(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("\n\t")), "([aeu])", "$1^"), "01", "Ol")
    return F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit("~~~~ "), noisy))


HARD_SQL = "case when o_orderkey % 50 <> 0 then '~~~~ ' || translate(regexp_replace(replace(text, chr(10), chr(10) || chr(9)), '([aeu])', '\\1^', 'g'), '01', 'Ol') end"


def answer(receipt: Column, leaves_out: int) -> Column:
    """What a model says of a receipt: null (it failed) for one in five, no JSON for one in seven, else JSON with a trailing comma, of every leaves_out-th without its change and tax."""
    short = F.col("o_orderkey") % leaves_out == 0
    total = F.struct(receipt["total"]["total_price"].alias("total_price"), receipt["total"]["cashprice"].alias("cashprice"), F.when(~short, receipt["total"]["changeprice"]).alias("changeprice"))
    less = F.struct(receipt["menu"].alias("menu"), F.when(~short, receipt["sub_total"]).alias("sub_total"), total.alias("total"))
    text = F.regexp_replace(F.to_json(less), r"\}$", ",}")
    return F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, F.lit("I can't read this receipt")).otherwise(text)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = receipts.parse_receipt(F.col("text"))
    rows = receipt_texts(spark, sf_dir).select("o_orderkey", "text", r.alias("receipt"))
    p = (F.col("o_orderkey") % 10) / 10.0
    return rows.select(
        F.col("o_orderkey").alias("sample"), hard_to_read(F.col("text")).alias("value"), F.col("text").alias("gt"), receipts.fields(F.col("receipt")).alias("gt_fields"), p.alias("p"), (p > 0.5).alias("rejects"),
        *(answer(F.col("receipt"), k).alias(n) for n, k in ANSWERED.items()),
    )


def asked(n: str):
    return lambda _: F.when(receipts.is_object(F.col(n)), receipts.fields(receipts.from_model_json(F.col(n))))


STEPS: dict[str, registry.Step] = {n: f for n, (f, _) in PLAIN.items()} | {"regex": receipts.text_fields} | {n: asked(n) for n in ANSWERED}


# --- the same in SQL ------------------------------------------------------------------------------------------------


def sql(experiments: dict[str, registry.Experiment], parsed_sql: str, nls) -> str:
    """Every configuration's figures. parsed_sql: common tables prices and menu from receipts(o_orderkey, text); here they come from all texts that are parsed."""
    configs = [(e, n, c) for e, x in experiments.items() for n, c in x.configs.items()]
    parsers = ("regex", *ANSWERED)
    text_of = lambda path: path[:-1] if path[-1] in parsers else path
    texts = list(dict.fromkeys(text_of(c.path) for _, _, c in configs))
    fields = list(dict.fromkeys(c.path for _, _, c in configs if c.path[-1] in parsers))

    def expression(path: tuple[str, ...]) -> str:
        out = HARD_SQL
        for step in path:
            out = PLAIN[step][1](out)
        return out

    nodes = " union all ".join(f"select o_orderkey, {i} as node, {expression(p)} as pred, text as gt from receipts" for i, p in enumerate(texts))
    quoted = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    named = ", ".join(f"('{e}', '{n}', {texts.index(text_of(c.path))}, {fields.index(c.path) if c.path in fields else 'null'}, {quoted(c.gate)}, {quoted(c.threshold)}::double)" for e, n, c in configs)
    tokens = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda t: t <> '')"
    # tokens of one side alone match nothing, so they share a code; the others get one each
    coded = lambda own, alone: f"array_to_string(list_transform({own}, lambda t: case when list_contains(known, t) then chr(2 + list_position(known, t)::int) else chr({alone}) end), '')"
    out = f"""with {RECEIPTS_SQL}, named as (select * from (values {named}) t(exp, config, node, fields, gate, threshold)),
texts as materialized ({nodes}),
split as (select *, {tokens('pred')} as p, {tokens('gt')} as g from texts where pred is not null),
rated as materialized (
  select o_orderkey, node, levenshtein(pred, gt)::double / length(gt) as cer, levenshtein({coded('p', 1)}, {coded('g', 2)})::double / len(g) as wer from (select *, list_distinct(list_intersect(p, g)) as known from split)),
gated as (
  select exp, config, o_orderkey, gate, case when gate = 'penalty' then (o_orderkey % 10) / 10.0 > 0.5 when gate = 'below' then (o_orderkey % 10) / 10.0 >= threshold else false end as away, cer, wer from rated join named using (node)),
kept as (select exp, config, away, case when not away then cer when gate = 'penalty' then 1.0 end as cer, case when not away then wer when gate = 'penalty' then 1.0 end as wer from gated),
by_text as (select exp, config, count(*) as n, count(*) filter (away) as rejected, avg(cer) as cer_mean, median(cer) as cer_median, avg(wer) as wer_mean, median(wer) as wer_median from kept group by 1, 2),
skips as (select node, count(*) filter (pred is null) as skipped from texts group by 1)"""
    none = "null::double"
    if fields:
        regex = [(i, p) for i, p in enumerate(fields) if p[-1] == "regex"]
        variants = " union all ".join(f"select o_orderkey * 16 + {i} as o_orderkey, pred as text from texts where node = {texts.index(p[:-1])} and pred is not null" for i, p in regex) or "select null::bigint as o_orderkey, null::varchar as text where false"
        rest = parsed_sql[len(RECEIPTS_SQL) :].replace(" from receipts)", " from variants)")
        answers = " union all ".join(
            f"select o_orderkey * 16 + {i} as o_orderkey, field, value from truth join texts using (o_orderkey) where node = {texts.index(p[:-1])} and pred is not null and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and not (o_orderkey % {ANSWERED[p[-1]]} = 0 and (field = 'total.changeprice' or starts_with(field, 'sub_total.')))"
            for i, p in enumerate(fields) if p[-1] in ANSWERED
        ) or "select null::bigint as o_orderkey, null::varchar as field, null::varchar as value where false"
        everything = " union all ".join(f"select o_orderkey, {i} as fields, o_orderkey * 16 + {i} as id, {'false' if p[-1] == 'regex' else '(o_orderkey % 5 = 0 or o_orderkey % 7 = 0)'} as failed from texts where node = {texts.index(p[:-1])} and pred is not null" for i, p in enumerate(fields))
        pairs = lambda alias: " union all ".join([f"select o_orderkey, '{a}.{k}' as field, {k} as value from {alias}prices where {k} is not null" for a, ks in (("total", receipts.TOTAL), ("sub_total", receipts.SUB_TOTAL)) for k in ks] + [f"select o_orderkey, 'menu.' || i || '.{k}', {k} from {alias}menu where {k} is not null" for k in ("nm", "cnt", "price")])
        # the truth is parsed as variant 15
        out += f""", variants as materialized ({variants} union all select o_orderkey * 16 + 15, text from receipts){rest},
long as materialized (select * from ({pairs('')}) where value <> ''),
truth as materialized (select o_orderkey // 16 as o_orderkey, field, value from long where o_orderkey % 16 = 15),
pred as (select * from long where o_orderkey % 16 <> 15 union all {answers}),
wanted as materialized ({everything}),
goal as (select id, failed, field, value from wanted join truth using (o_orderkey)),
have as (select o_orderkey as id, field, value from pred),
joined as (select id, field, coalesce(trim(h.value), '') as p, coalesce(trim(g.value), '') as g from have h full join goal g using (id, field)),
valued as (select *, {nls('p', 'g')} as s from joined),
measured as (
  select id, count(*) filter (p <> '' and g <> '' and s >= 0.5) as tp, count(*) filter (p <> '') as np, count(*) filter (g <> '') as ng, avg(case when s >= 0.5 then s else 0 end) filter (g <> '') as anls,
    coalesce(bool_or(lower(p) = lower(g)) filter (field = 'total.total_price'), true) as em from valued group by 1),
figured as (
  select fields, failed, case when failed or np = 0 or ng = 0 or tp = 0 then 0 else 2 * (tp::double / np) * (tp::double / ng) / (tp::double / np + tp::double / ng) end as f1, case when failed then 0 else coalesce(anls, 0) end as anls, case when em and not failed then 1.0 else 0.0 end as em
  from wanted left join measured using (id)),
by_fields as (select fields, count(*) filter (failed) as failed, avg(f1) as f1_mean, avg(anls) as anls_mean, avg(em) as total_em from figured group by 1)"""
    else:
        out += f", by_fields as (select null::int as fields, 0::bigint as failed, {none} as f1_mean, {none} as anls_mean, {none} as total_em where false)"
    figures = ["cer_mean", "cer_median", "wer_mean", "wer_median"]
    empty = lambda c: f"coalesce({c}, case when gate = 'below' then 0.0 end)" if c.endswith("mean") else c
    return out + f""" select exp, config, coalesce(n, 0) as n, coalesce(skipped, 0) as skipped, coalesce(rejected, 0) as rejected, coalesce(failed, 0) as failed, {", ".join(f"round({empty(c)}, 6) as {c}" for c in figures)},
  round(f1_mean, 6) as f1_mean, round(anls_mean, 6) as anls_mean, round(total_em, 6) as total_em
from named left join by_text using (exp, config) left join by_fields using (fields) left join skips using (node)"""


# --- the comparison of parsers ---------------------------------------------------------------------------------------


def answered_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text, gt, rules, model): recognised texts, the true receipt, and what the rules and a model make of it. A model's failure is null."""
    true = receipts.parse_receipt(F.col("text"))
    r = receipt_texts(spark, sf_dir).select("o_orderkey", hard_to_read(F.col("text")).alias("value"), true.alias("gt"))
    text = F.col("value")
    for step in registry.FULL + registry.READ:
        text = STEPS[step](text)
    rows = r.select("o_orderkey", text.alias("text"), "gt", answer(F.col("gt"), ANSWERED["llm"]).alias("llm"))
    return rows.select("o_orderkey", "text", "gt", receipts.parse_receipt(F.col("text")).alias("rules"), F.when(receipts.is_object(F.col("llm")), receipts.from_model_json(F.col("llm"))).alias("model"))


def parsers_sql(parsed_sql: str) -> str:
    text = HARD_SQL
    for step in registry.FULL + registry.READ:
        text = PLAIN[step][1](text)
    rest = parsed_sql[len(RECEIPTS_SQL) :].replace(" from receipts)", " from variants)")
    # variant 0 is the truth, 1 what was recognised; the model has the truth, where it answers
    return f"""with {RECEIPTS_SQL}, recognised as materialized (select o_orderkey, {text} as pred from receipts),
variants as materialized (select o_orderkey * 2 as o_orderkey, text from receipts union all select o_orderkey * 2 + 1, pred from recognised where pred is not null){rest},
lists as (select o_orderkey, list(distinct trim(price)) filter (coalesce(trim(price), '') <> '') as s from menu group by 1),
found as materialized (select p.o_orderkey // 2 as o_orderkey, p.o_orderkey % 2 as v, translate(coalesce(total_price, ''), ',.', '') as total, coalesce(s, []) as s from prices p left join lists using (o_orderkey)),
truth as (select * from found where v = 0),
by_parser as (
  select t.o_orderkey, 'regex' as parser, true as answered, f.total as total, f.s as p, t.total as want, t.s as g from truth t join found f on f.o_orderkey = t.o_orderkey and f.v = 1
  union all select t.o_orderkey, 'llm', t.o_orderkey % 5 <> 0 and t.o_orderkey % 7 <> 0, t.total, t.s, t.total, t.s from truth t join found f on f.o_orderkey = t.o_orderkey and f.v = 1),
shared as (select *, len(list_intersect(p, g)) as b from by_parser),
scored as (
  select parser, answered, answered and total = want as match, want <> '' as has_total,
    case when not answered then 0.0 when len(p) = 0 and len(g) = 0 then 1.0 when b = 0 then 0.0 else 2.0 * b / (len(p) + len(g)) end::double as f1 from shared)
select parser, (select count(*) from receipts) as files, count(*) as texts, count(*) filter (answered) as answered, count(*) filter (has_total) as totals, count(*) filter (match) as total_matches,
  round(count(*) filter (match) / (select count(*) from receipts), 6) as by_files, round(count(*) filter (match) / count(*), 6) as by_texts, round(count(*) filter (match and has_total) / count(*) filter (has_total), 6) as by_totals, round(avg(f1), 6) as menu_f1
from scored group by 1"""
