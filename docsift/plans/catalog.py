"""The registered queries over the driver's tables and the SQL that gives the same rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import arrays, invoices, metrics, openjson, receipts, text
from docsift.operators import experiments, labelling, layout, quality, registry
from docsift.operators.images import DEGRADATION_TABLE
from docsift.plans import trials
from docsift.plans.adapters import BOXES_SQL, GATED_SQL, INVOICES_SQL, OPEN_SQL, PAIRS_SQL, RECEIPTS_SQL, gated, noised, noised_sql, open_invoices, open_receipts, page_boxes, pairs, table, word_boxes
from docsift.plans.adapters import receipts as receipt_texts
from docsift.session import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Outer generators below: for inner ones the optimizer adds filters that would parse every text again.


def r6(c):
    return F.round(c, 6)


# --- receipts -------------------------------------------------------------------------------------------------------

words = lambda ws: "[" + ", ".join("'" + w + "'" for w in ws) + "]"
any_of = lambda line, ws: f"len(list_filter({words(ws)}, lambda k: contains(lower({line}), k))) > 0"
price_of = lambda key: f"list_filter(lines, lambda x: {any_of('x', receipts.KEYWORDS[key])} and regexp_matches(x, '{receipts.PRICE}'))[1]"
last_price = lambda key: f"list_last(regexp_extract_all({price_of(key)}, '{receipts.PRICE}'))"
LINES_SQL = f"""{RECEIPTS_SQL},
lined as (select o_orderkey, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as lines from receipts)"""
ITEMS_SQL = f"""{LINES_SQL},
each as (select o_orderkey, unnest(lines) as line, generate_subscripts(lines, 1) as pos from lined),
matched as (
  select o_orderkey, pos, trim(regexp_extract(line, '(?i){receipts.ITEM}', 1)) as nm, regexp_extract(line, '(?i){receipts.ITEM}', 2) as n, regexp_extract(line, '(?i){receipts.ITEM}', 3) as price
  from each where not ({any_of("line", receipts.SKIP)}) and regexp_matches(line, '(?i){receipts.ITEM}')),
menu as (
  select o_orderkey, row_number() over (partition by o_orderkey order by pos) - 1 as i, nm, case when n <> '' then n || ' x' end as cnt, price
  from matched where length(nm) >= 2 and not regexp_matches(nm, '^[\\d.,\\s]+$'))"""
PRICES_SQL = f"{LINES_SQL}, prices as (select o_orderkey, " + ", ".join(f"{last_price(k)} as {k}" for k in receipts.KEYWORDS) + " from lined)"
PARSED_SQL = f"{ITEMS_SQL}, prices as (select o_orderkey, " + ", ".join(f"{last_price(k)} as {k}" for k in receipts.KEYWORDS) + " from lined)"


def parsed(spark, sf_dir) -> DataFrame:
    return receipt_texts(spark, sf_dir).select("o_orderkey", "text", receipts.parse_receipt(F.col("text")).alias("receipt"))


@query(f"""with {PARSED_SQL}, n as (select o_orderkey, count(*) as k from menu group by 1)
select o_orderkey, coalesce(k, 0)::int as n_items, subtotal_price, tax_price, total_price, cashprice, changeprice from prices left join n using (o_orderkey)""")
def q01_receipt_parse(spark, sf_dir):
    p = parsed(spark, sf_dir)
    r = F.col("receipt")
    return p.select("o_orderkey", F.size(r["menu"]).alias("n_items"), r["sub_total"]["subtotal_price"].alias("subtotal_price"), r["sub_total"]["tax_price"].alias("tax_price"), r["total"]["total_price"].alias("total_price"), r["total"]["cashprice"].alias("cashprice"), r["total"]["changeprice"].alias("changeprice"))


@query(f"with {ITEMS_SQL} select o_orderkey, i::int as i, nm, cnt, price from menu")
def q02_menu_items(spark, sf_dir):
    return parsed(spark, sf_dir).select("o_orderkey", F.posexplode_outer("receipt.menu").alias("i", "m")).where("i is not null").select("o_orderkey", "i", "m.nm", "m.cnt", "m.price")


@query(f"with {PRICES_SQL} select * from prices")
def q03_keyword_price(spark, sf_dir):
    r = F.col("receipt")
    found = [r["total" if k in receipts.TOTAL else "sub_total"][k].alias(k) for k in receipts.KEYWORDS]
    return parsed(spark, sf_dir).select("o_orderkey", *found)


FIX = lambda c: f"""array_to_string(list_transform(list_filter(regexp_split_to_array({c}, '[ \\n]+'), lambda t: t <> ''),
  lambda t: case when regexp_matches(t, '\\d') or regexp_matches(t, '^[.,{text.LOOKALIKES}]+$') then translate(t, '{text.LOOKALIKES}', '{text.DIGITS}') else t end), ' ')"""  # noqa: E731


@query(f"with {RECEIPTS_SQL} select o_orderkey, {FIX(noised_sql('text'))} as fixed from receipts")
def q04_numeric_fix(spark, sf_dir):
    return receipt_texts(spark, sf_dir).select("o_orderkey", text.correct_numeric(noised(F.col("text"))).alias("fixed"))


@query("""select page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10)),
  lambda x: regexp_replace(x, '^[\\s\\v]+|[\\s\\v]+$', '', 'g')), lambda x: x <> ''), chr(10)) as clean from pages""")
def q05_normalize_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_whitespace(F.regexp_replace("html", "<[^>]*>", "\n")).alias("clean"))


# --- layout ---------------------------------------------------------------------------------------------------------

MERGED_SQL = f"""{BOXES_SQL},
flagged as (select *, case when abs(y1 - lag(y1) over w) <= 10 then 0 else 1 end as new, row_number() over w as pos from boxes window w as (partition by doc_id order by y1, x1, seq)),
numbered as (select *, sum(new) over (partition by doc_id order by pos) as line_no from flagged),
merged as (
  select doc_id, line_no::int as line_no, string_agg(text, ' ' order by x1, pos) as text, round(avg(confidence), 6) as confidence, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2
  from numbered group by 1, 2)"""


@query(f"with {MERGED_SQL} select * from merged")
def q06_line_merge(spark, sf_dir):
    return layout.page_lines(page_boxes(spark, sf_dir)).select("doc_id", "line_no", "text", r6(F.col("confidence")).alias("confidence"), "bbox.*")


@query(f"with {BOXES_SQL} select doc_id, string_agg(text, chr(10) order by y1, seq) as text from boxes group by 1")
def q07_reading_order(spark, sf_dir):
    return layout.page_order(page_boxes(spark, sf_dir))


@query(f"with {BOXES_SQL} select doc_id, seq::int as seq, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area, (confidence * 100)::int / 100.0::double as conf from boxes")
def q08_bbox_props(spark, sf_dir):
    b = word_boxes(spark, sf_dir)
    return b.select("doc_id", "seq", arrays.box_size(F.col("bbox")).alias("s"), arrays.confidence(F.round(F.col("confidence") * 100)).alias("conf")).select("doc_id", "seq", "s.*", "conf")


# --- metrics --------------------------------------------------------------------------------------------------------

CODED = lambda own: f"array_to_string(list_transform({own}, lambda t: chr(33 + list_position(known, t)::int)), '')"
CER = lambda p, g: f"case when length({g}) = 0 then case when {p} = '' then 0.0 else 1.0 end else levenshtein({p}, {g})::double / length({g}) end"
NLS = lambda a, b: f"case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) end"


@query(f"with {PAIRS_SQL} select item_id, round({CER('pred', 'gt')}, 6) as cer from pairs")
def q09_cer(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", r6(metrics.cer(F.col("pred"), F.col("gt"))).alias("cer"))


@query(f"""with {PAIRS_SQL}, w as (select item_id, string_split(pred, ' ') as p, string_split(gt, ' ') as g from pairs), k as (select *, list_distinct(list_concat(p, g)) as known from w)
select item_id, round(levenshtein({CODED('p')}, {CODED('g')})::double / len(g), 6) as wer from k""")
def q10_wer(spark, sf_dir):
    return pairs(spark, sf_dir).select("item_id", r6(metrics.wer(F.col("pred"), F.col("gt"))).alias("wer"))


#: Whole turns; each distinct character of a pair becomes one byte, as DuckDB's levenshtein goes by bytes. Pairs have fewer than 127 of them.
CHARACTERS = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(list_position(known, x)::int)), '')"
TURNS_SQL = f"""
turns as (select conv_id, turn, coalesce(text, '') as a, coalesce(lag(text) over (partition by conv_id order by turn), '') as b from conversations),
known as (select *, list_distinct(list_concat(string_split(a, ''), string_split(b, ''))) as known from turns),
bytes as (select conv_id, turn, case when a = '' then '' else {CHARACTERS('a')} end as a, case when b = '' then '' else {CHARACTERS('b')} end as b from known)"""


@query(f"with {TURNS_SQL}, s as (select conv_id, turn, {NLS('a', 'b')} as nls from bytes) select conv_id, turn, round(nls, 6) as nls, round(case when nls >= 0.5 then nls else 0.0 end, 6) as anls from s")
def q11_nls_anls(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn")))
    t = t.select("conv_id", "turn", metrics.nls(F.col("a"), F.col("b")).alias("nls"))  # whole texts, so each distance is worked out once
    return t.select("conv_id", "turn", r6(F.col("nls")).alias("nls"), r6(metrics.at_least(F.col("nls"))).alias("anls"))


@query("""with p as (select c_nationkey, c_mktsegment as a, coalesce(lag(c_mktsegment) over (partition by c_nationkey order by c_custkey), '') as b from customer)
select c_nationkey, count(*) as n, count(*) filter (lower(trim(a)) = lower(trim(' ' || lower(b) || ' '))) as normal, count(*) filter (a = lower(b)) as lowered, count(*) filter (a = b) as plain from p group by 1""")
def q12_exact_match(spark, sf_dir):
    """Each customer's segment against that of the customer before in its nation, the latter in lower case and among blanks."""
    before = F.lag("c_mktsegment").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("a"), before.alias("b"))
    a, b = F.col("a"), F.col("b")
    other = F.concat(F.lit(" "), F.lower(F.coalesce(b, F.lit(""))), F.lit(" "))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(metrics.exact_match(a, other)).alias("normal"), F.count_if(metrics.exact_match(a, F.lower(b), normalize=False)).alias("lowered"), F.count_if(metrics.exact_match(a, b, normalize=False)).alias("plain"))


FIELDS_SQL = f"""{PARSED_SQL},
fields as ({" union all ".join(f"select o_orderkey, {n} as ord, '{p}.{k}' as field, {k} as value from prices" for n, (p, k) in enumerate([("total", k) for k in receipts.TOTAL] + [("sub_total", k) for k in receipts.SUB_TOTAL]))}
  union all {" union all ".join(f"select o_orderkey, 10 + 3 * i + {n}, 'menu.' || i || '.{k}', {k} from menu" for n, k in enumerate(("nm", "cnt", "price")))})"""


@query(f"with {FIELDS_SQL} select o_orderkey, (row_number() over (partition by o_orderkey order by ord) - 1)::int as ord, field, value from fields where coalesce(value, '') <> ''")
def q13_flatten_fields(spark, sf_dir):
    return parsed(spark, sf_dir).select("o_orderkey", F.posexplode_outer(receipts.field_entries(F.col("receipt"))).alias("ord", "e")).where("ord is not null").select("o_orderkey", "ord", "e.field", "e.value")


SHIFTED_SQL = f"""{FIELDS_SQL}, gt as (select o_orderkey, field, value from fields where coalesce(value, '') <> ''),
pred as (select o_orderkey, field, translate(value, '37', '73') as value from gt where field <> 'total.changeprice' union all select o_orderkey, 'total.extra', 'x' from prices),
joined as (select o_orderkey, field, coalesce(p.value, '') as p, coalesce(g.value, '') as g from pred p full join gt g using (o_orderkey, field)),
marked as (select *, case when p = '' and g = '' then 0 when g = '' then 2 when p = '' then 3 when {NLS('p', 'g')} >= 0.5 and {NLS('p', 'g')} > 0 then 1 else 4 end as code from joined),
counted as (select o_orderkey, count(*) filter (code = 1) as tp, count(*) filter (code in (2, 4)) as fp, count(*) filter (code in (3, 4)) as fn from marked group by 1)"""


def shifted(spark, sf_dir) -> DataFrame:
    """gt fields of a receipt, and a prediction that confuses 3 and 7, lacks one field and has another too many."""
    gt = parsed(spark, sf_dir).select("o_orderkey", receipts.fields(F.col("receipt")).alias("gt"))
    wrong = F.map_filter(F.transform_values("gt", lambda k, v: F.translate(v, "37", "73")), lambda k, v: k != "total.changeprice")
    return gt.select("o_orderkey", "gt", F.map_concat(wrong, F.create_map(F.lit("total.extra"), F.lit("x"))).alias("pred"))


@query(f"with {SHIFTED_SQL} select o_orderkey, tp::int as tp, fp::int as fp, fn::int as fn from counted")
def q14_field_join(spark, sf_dir):
    """The same counts as q15, from long tables of fields in a full outer join. Both come from one table of receipts that is parsed once."""
    both = kept(shifted(spark, sf_dir), "fields")
    long = lambda c: both.select("o_orderkey", F.explode_outer(c).alias("field", c)).where("field is not null")
    return metrics.joined_field_counts(long("pred"), long("gt"), "o_orderkey")


@query(f"""with {SHIFTED_SQL}, rates as (select *, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as r from counted),
  a as (select o_orderkey, avg(case when {NLS('p', 'g')} >= 0.5 then {NLS('p', 'g')} else 0 end) as anls, count(*) as n_gt from joined where g <> '' group by 1)
select o_orderkey, tp::int as tp, fp::int as fp, fn::int as fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1, round(anls, 6) as anls, n_gt::int as n_gt
from rates join a using (o_orderkey)""")
def q15_receipt_eval(spark, sf_dir):
    p = shifted(spark, sf_dir)
    f = metrics.field_f1(F.col("pred"), F.col("gt"))
    out = p.select("o_orderkey", f.alias("f"), metrics.mean_anls(F.col("pred"), F.col("gt")).alias("anls"), F.size("gt").alias("n_gt"))
    return out.select("o_orderkey", "f.tp", "f.fp", "f.fn", *(r6(F.col(f"f.{k}")).alias(k) for k in ("precision", "recall", "f1")), r6(F.col("anls")).alias("anls"), "n_gt")


@query("""with s as (select l_orderkey, list(distinct l_partkey % 7) filter (l_quantity < 40) as p, list(distinct l_partkey % 7) filter (l_quantity > 10) as g from lineitem group by 1),
  c as (select l_orderkey, coalesce(len(p), 0) as np, coalesce(len(g), 0) as ng, coalesce(len(list_intersect(p, g)), 0) as b from s),
  r as (select *, case when ng = 0 then case when np = 0 then 1.0 else 0.0 end when np = 0 then 1.0 else b::double / np end as precision, case when ng = 0 then 1.0 when np = 0 then 0.0 else b::double / ng end as recall from c)
select l_orderkey, round(precision, 6) as precision, round(recall, 6) as recall, round(case when np = 0 and ng = 0 then 1.0 when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from r""")
def q16_set_f1(spark, sf_dir):
    key = (F.col("l_partkey") % 7).cast("string")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") < 40, key)).alias("p"), F.collect_set(F.when(F.col("l_quantity") > 10, key)).alias("g"))
    return s.select("l_orderkey", metrics.set_f1(F.col("p"), F.col("g")).alias("f")).select("l_orderkey", *(r6(F.col(f"f.{k}")).alias(k) for k in ("precision", "recall", "f1")))


LABEL = "case when cer < 0.05 then 'ready' when cer > 0.20 then 'not_ready' else 'marginal' end"


@query(f"with {PAIRS_SQL}, c as (select item_id, {CER('pred', 'gt')} as cer from pairs), l as (select item_id, cer, {LABEL} as label from c) select label, count(*) as n, round(avg(cer), 6) as cer from l group by 1")
def q17_cer_label(spark, sf_dir):
    c = pairs(spark, sf_dir).select(metrics.cer(F.col("pred"), F.col("gt")).alias("cer"))
    return c.groupBy(quality.cer_label(F.col("cer")).alias("label")).agg(F.count("*").alias("n"), r6(F.avg("cer")).alias("cer"))


# --- gates and reports ----------------------------------------------------------------------------------------------


def scored(spark, sf_dir) -> DataFrame:
    s = gated(spark, sf_dir).withColumn("p", arrays.softmax(F.col("logits")))
    best = arrays.argmax(F.col("p"))
    return s.select("vec_id", "label", "p", best.alias("pred"), F.round(F.array_max("p"), 9).alias("score"), F.round(F.element_at("p", 3), 9).alias("p_not_ready"), ((F.col("vec_id") % 10) / 10.0).alias("cer"))


SCORED_SQL = f"{GATED_SQL}, scored as (select vec_id, label, p, (list_position(p, list_max(p)) - 1)::int as pred, round(list_max(p), 9) as score, round(p[3], 9) as p_not_ready, (vec_id % 10) / 10.0::double as cer from probs)"


@query(f"with {SCORED_SQL} select vec_id, pred = 2 and score > 0.5 as rejected, case when not (pred = 2 and score > 0.5) then cer end as cer from scored")
def q18_gate_pipeline(spark, sf_dir):
    s = scored(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, quality.LABELS)), F.col("pred") + 1)
    rejected = quality.gate_rejects(label, F.col("score"))
    return s.select("vec_id", rejected.alias("rejected"), F.when(~rejected, F.col("cer")).alias("cer"))


@query(f"with {SCORED_SQL} select count(*) as n, count(*) filter (pred = 2) as rejected, round(avg(case when pred = 2 then 1.0 else cer end), 6) as cer from scored")
def q19_gate_penalty(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == 2).alias("rejected"), r6(F.avg(quality.penalised(F.col("pred") == 2, F.col("cer")))).alias("cer"))


@query(f"""with {SCORED_SQL}, t as (select unnest([0.0::double, 0.3, 0.5, 0.7]) as threshold)
select threshold, count(*) filter (p_not_ready < threshold) as accepted, count(*) filter (p_not_ready >= threshold) as rejected, round(coalesce(avg(cer) filter (p_not_ready < threshold), 0.0), 6) as cer from scored, t group by 1""")
def q20_threshold_sweep(spark, sf_dir):
    return quality.threshold_sweep(scored(spark, sf_dir)).withColumn("cer", r6(F.col("cer")))


@query(f"with {SCORED_SQL} select vec_id, pred, round(p[1], 6) as p0, round(p[2], 6) as p1, round(p[3], 6) as p2 from scored")
def q21_argmax_softmax(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "pred", *(r6(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(3)))


@query(f"""with {SCORED_SQL}, c as (select unnest([0, 1, 2])::int as "true")
select c."true", count(*) filter (pred = 0) as pred_0, count(*) filter (pred = 1) as pred_1, count(*) filter (pred = 2) as pred_2 from c left join scored on label = c."true" group by 1""")
def q22_confusion(spark, sf_dir):
    return quality.confusion(scored(spark, sf_dir), "label", "pred")


@query(f"""with {SCORED_SQL}, c as (select unnest([0, 1, 2]) as c),
  k as (select c, count(*) filter (pred = c and label = c)::double as tp, count(*) filter (pred = c)::double as p, count(*) filter (label = c)::double as t from scored, c group by 1),
  s as (select c, case when p = 0 then 0 else tp / p end as precision, case when t = 0 then 0 else tp / t end as recall, case when p + t = 0 then 0 else 2 * tp / (p + t) end as f1, t from k),
  n as (select sum(t) as n, (select sum(tp) from k) as ok from s)
select c::varchar as class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, t::bigint as support from s
union all select 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(t)::bigint from s
union all select 'weighted', round(sum(precision * t) / sum(t), 6), round(sum(recall * t) / sum(t), 6), round(sum(f1 * t) / sum(t), 6), sum(t)::bigint from s
union all select 'accuracy', round(ok / n, 6), round(ok / n, 6), round(ok / n, 6), n::bigint from n""")
def q23_class_report(spark, sf_dir):
    r = quality.class_report(scored(spark, sf_dir), "label", "pred")
    return r.select("class", *(r6(F.col(k)).alias(k) for k in ("precision", "recall", "f1")), "support")


@query("select label, count(*) as n, round((select count(*) from embeddings) / (10.0 * count(*)), 6) as weight from embeddings group by 1")
def q24_class_weights(spark, sf_dir):
    return quality.class_weights(table(spark, sf_dir, "embeddings"), "label", 10).withColumn("weight", r6(F.col("weight")))


@query("""with j as (select quality = 1 as pos, n_chars as s from labels join documents using (doc_id)), g as (select s, count(*) filter (pos) as p, count(*) filter (not pos) as n from j group by 1),
  w as (select *, sum(p) over (order by s desc rows unbounded preceding) as above from g) select round(sum(n * (above - p / 2.0))::double / (sum(p)::double * sum(n)::double), 6) as auc from w""")
def q25_roc_auc(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return quality.roc_auc(j, F.col("quality") == 1, F.col("n_chars")).withColumn("auc", r6(F.col("auc")))


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rank, count(*) over (partition by lang) as n from documents)
select doc_id, lang, case when rank <= floor(n * 0.7) then 'train' when rank <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from r""")
def q26_stratified_split(spark, sf_dir):
    return quality.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


# --- experiments ----------------------------------------------------------------------------------------------------

#: Configurations: digits misread at different rates, by how many kinds of characters.
CONFIGS = [(0, "none", "", ""), (1, "one", "0", "O"), (2, "two", "01", "Ol"), (3, "three", "015", "OlS")]


def grid(spark, sf_dir) -> DataFrame:
    texts = receipt_texts(spark, sf_dir)
    configs = spark.createDataFrame([(i, n) for i, n, _, _ in CONFIGS], "stage int, config string")
    rows = experiments.with_configs(texts, configs)
    noisy = F.col("text")
    for i, _, a, b in CONFIGS[1:]:
        noisy = F.when(F.col("stage") == i, F.translate("text", a, b)).otherwise(noisy)
    return rows.withColumn("changed", noisy).select("o_orderkey", "stage", "config", ((F.length("changed") - F.length(F.translate("changed", "OlS", ""))) / F.length("text")).alias("rate"))


GRID_SQL = f"""{RECEIPTS_SQL}, configs as (select * from (values {", ".join(f"({i}, '{n}', '{a}', '{b}')" for i, n, a, b in CONFIGS)}) t(stage, config, a, b)),
grid as (select o_orderkey, stage, config, (length(translate(text, a, b)) - length(translate(translate(text, a, b), 'OlS', '')))::double / length(text) as rate from receipts, configs),
stats as (select stage::int as stage, config, count(*) as n, avg(rate) as rate_mean, median(rate) as rate_median from grid group by 1, 2)"""


@query(f"with {GRID_SQL} select stage, config, n, round(rate_mean, 6) as rate_mean, round(rate_median, 6) as rate_median from stats")
def q27_config_grid(spark, sf_dir):
    s = experiments.summarise(grid(spark, sf_dir), ["stage", "config"], ["rate"])
    return s.select("stage", "config", "n", r6(F.col("rate_mean")).alias("rate_mean"), r6(F.col("rate_median")).alias("rate_median"))


@query(f"""with {GRID_SQL} select stage, round(rate_mean - coalesce(lag(rate_mean) over (order by stage), 0), 6) as delta, round(rate_mean, 6) as total,
  round((rate_mean - lag(rate_mean) over (order by stage)) / lag(rate_mean) over (order by stage), 6) as relative from stats""")
def q28_ablation_deltas(spark, sf_dir):
    s = experiments.stage_deltas(experiments.summarise(grid(spark, sf_dir), ["stage", "config"], ["rate"]), "stage", "rate_mean")
    return s.select("stage", *(r6(F.col(c)).alias(c) for c in ("delta", "total", "relative")))


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id limit 50")
def q29_anti_resume(spark, sf_dir):
    return experiments.resume(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", 50)


@query("select doc_id, lang, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def q30_semi_exists(spark, sf_dir):
    return experiments.existing(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


STEM = r"([^/]+?)(?:\.[^./]*)?$"


@query(f"""with p as (select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '{STEM}', 1) as stem from pages)
select page_id, stem, d.doc_id, d.lang from p left join documents d on d.doc_id::varchar = p.stem""")
def q31_stem_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", text.stem(F.regexp_replace("url", "[?#].*$", "")).alias("stem"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return p.join(d, p["stem"] == d["doc_id"].cast("string"), "left")


@query(f"""with {PARSED_SQL}, n as (select count(*) as n from prices), m as (select count(*) as n from menu)
{" union all ".join(f"select '{p}.{k}' as field, (select count({k}) from prices)::bigint as present, (select n from n)::bigint as total" for p, ks in (("total", receipts.TOTAL), ("sub_total", receipts.SUB_TOTAL)) for k in ks)}
union all {" union all ".join(f"select 'menu.{k}', (select count({k}) from menu)::bigint, (select n from m)::bigint" for k in ("nm", "cnt", "price"))}""")
def q32_completeness(spark, sf_dir):
    return experiments.completeness(parsed(spark, sf_dir))


@query("""with e as (select min(n_chars) as low, max(n_chars) as high from documents),
  r as (select low - case when low = high then 0.5 else 0 end as low, (high - low + case when low = high then 1 else 0 end) / 30.0::double as width from e),
  b as (select least(floor((n_chars - low) / width), 29)::int as bin, width from documents, r where n_chars is not null), c as (select bin, width, count(*) as n from b group by 1, 2)
select bin, n, round(n / ((select sum(n) from c)::double * width), 9) as density from c""")
def q33_histogram(spark, sf_dir):
    return experiments.histogram(table(spark, sf_dir, "documents"), "n_chars").withColumn("density", F.round("density", 9))


@query("select lang, count(n_chars) as n, round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as std, min(n_chars) as min, median(n_chars)::double as median, max(n_chars) as max from documents group by 1")
def q34_statistics(spark, sf_dir):
    s = experiments.statistics(table(spark, sf_dir, "documents"), "n_chars", ["lang"])
    return s.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query("select event_type, json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by 1, 2")
def q35_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""with w as (select event_id, user_id, value, max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as b from events)
select event_id, user_id, greatest(b, value) as best, b is null or value > b as is_best from w""")
def q36_running_best(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return quality.running_best(e, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "best", "is_best")


@query("""with o as (select o_orderpriority as exp, 'old' as config, count(*) as n from orders group by 1), n as (select o_orderpriority as exp, 'new' as config, count(*) as n from orders where o_orderstatus = 'F' and o_orderpriority like '%H%' group by 1)
select * from o where exp not in (select exp from n) union all select * from n""")
def q37_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    count = lambda rows, name: rows.groupBy(F.col("o_orderpriority").alias("exp")).agg(F.count("*").alias("n")).select("exp", F.lit(name).alias("config"), "n")
    return experiments.upsert(count(o, "old"), count(o.where("o_orderstatus = 'F' and o_orderpriority like '%H%'"), "new"))


VARIANTS = [name for name, _, _ in DEGRADATION_TABLE]


@query(f"""with v as (select unnest({words(VARIANTS)}) as degradation, generate_subscripts({words(VARIANTS)}, 1) - 1 as i), r as (select doc_id, degradation, row_number() over (partition by doc_id order by (doc_id * 7 + i * 5) % 16, degradation) as k from documents, v)
select doc_id, degradation from r where k <= 5""")
def q38_degradation_sample(spark, sf_dir):
    order = [(F.col("doc_id") * 7 + i * 5) % 16 for i in range(len(VARIANTS))]
    return experiments.sample_variants(table(spark, sf_dir, "documents").select("doc_id"), VARIANTS, 5, "doc_id", order)


def polygons(spark, sf_dir) -> DataFrame:
    n = lambda c, m: (F.col(c) % m).cast("double")
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array(*(F.array(*xy) for xy in ((n("p_partkey", 13) + 0.5, n("p_size", 7) + 0.25), (n("p_size", 11) + 100.75, n("p_partkey", 5)), (n("p_partkey", 17) + 90, n("p_size", 3) + 80.5), (n("p_size", 19), n("p_partkey", 23) + 70.125)))).alias("polygon"))


POLYGONS_SQL = """polygons as (select p_partkey, [[p_partkey % 13 + 0.5::double, p_size % 7 + 0.25::double], [p_size % 11 + 100.75::double, (p_partkey % 5)::double], [p_partkey % 17 + 90::double, p_size % 3 + 80.5::double], [(p_size % 19)::double, p_partkey % 23 + 70.125::double]] as q from part)"""


@query(f"""with {POLYGONS_SQL}, b as (select p_partkey, [x[1] for x in q] as xs, [x[2] for x in q] as ys from polygons)
select p_partkey, trunc(list_min(xs))::int as x1, trunc(list_min(ys))::int as y1, trunc(list_max(xs))::int as x2, trunc(list_max(ys))::int as y2 from b""")
def q39_polygon_aabb(spark, sf_dir):
    return polygons(spark, sf_dir).select("p_partkey", arrays.polygon_box(F.col("polygon")).alias("b")).select("p_partkey", "b.*")


@query(f"""with {POLYGONS_SQL}, s as (select p_partkey, q, [x[1] + x[2] for x in q] as a, [x[2] - x[1] for x in q] as d from polygons)
select p_partkey, q[list_position(a, list_min(a))] as tl, q[list_position(d, list_min(d))] as tr, q[list_position(a, list_max(a))] as br, q[list_position(d, list_max(d))] as bl from s""")
def q40_order_points(spark, sf_dir):
    o = polygons(spark, sf_dir).select("p_partkey", arrays.order_points(F.col("polygon")).alias("o"))
    return o.select("p_partkey", *(F.element_at("o", i + 1).alias(n) for i, n in enumerate(("tl", "tr", "br", "bl"))))


@query(f"with {RECEIPTS_SQL} select o_orderkey, md5('Return the receipt below as JSON with menu, sub_total and total. Keep prices as they are printed.' || chr(10) || chr(10) || 'Receipt:' || chr(10) || text || chr(10) || 'JSON:') as prompt from receipts")
def q41_prompt_build(spark, sf_dir):
    return receipt_texts(spark, sf_dir).select("o_orderkey", F.md5(receipts.prompt(F.col("text"))).alias("prompt"))


CLEAN_SQL = f"""cleaned as (select doc_id, line_no, {FIX('text')} as text from merged)"""


@query(f"with {MERGED_SQL}, {CLEAN_SQL} select doc_id, string_agg(text, chr(10) order by line_no) as text from cleaned where text <> '' group by 1")
def q42_recognised_text(spark, sf_dir):
    """Boxes of words, merged into lines, cleaned and joined."""
    return layout.page_text(page_boxes(spark, sf_dir))


# --- the whole evaluation of a receipt, and what has no query above ------------------------------------------------

WORDS = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


@query(f"""with {SHIFTED_SQL}, g as (select o_orderkey, string_agg(value, ' ' order by ord) as gt, max(value) filter (field = 'total.total_price') as gt_total, count(*) as n_gt from fields where coalesce(value, '') <> '' group by 1),
  p as (select o_orderkey, string_agg(translate(value, '37', '73'), ' ' order by ord) || ' x' as pred, translate(max(value) filter (field = 'total.total_price'), '37', '73') as pred_total, count(*) + 1 as n_pred from fields where coalesce(value, '') <> '' and field <> 'total.changeprice' group by 1),
  w as (select *, {WORDS('pred')} as pw, {WORDS('gt')} as gw from p join g using (o_orderkey)), k as (select *, list_distinct(list_concat(pw, gw)) as known from w)
select o_orderkey, round({CER('pred', 'gt')}, 6) as cer, round(levenshtein({CODED('pw')}, {CODED('gw')})::double / len(gw), 6) as wer, pred_total = gt_total as total_exact_match, n_pred::int as n_pred, n_gt::int as n_gt from k""")
def q43_receipt_report(spark, sf_dir):
    """With q15 the whole evaluation: error rates of all values joined by blanks, the total's exact match, how many fields there are."""
    return shifted(spark, sf_dir).select("o_orderkey", metrics.receipt_report(F.col("pred"), F.col("gt")).alias("r")).select("o_orderkey", r6(F.col("r.cer")).alias("cer"), r6(F.col("r.wer")).alias("wer"), "r.total_exact_match", "r.n_pred", "r.n_gt")


@query(f"""with {SHIFTED_SQL} select field, count(*) as n, count(*) filter (code = 1) as matched, round(avg(case when code = 1 then {NLS('p', 'g')} else 0 end), 6) as score
from marked where code > 0 group by 1""")
def q44_per_field(spark, sf_dir):
    """How each field fares over all receipts."""
    each = shifted(spark, sf_dir).select(F.explode_outer(metrics.per_field(F.col("pred"), F.col("gt"))).alias("f")).where("f is not null")
    return each.groupBy("f.field").agg(F.count("*").alias("n"), F.count_if("f.matched").alias("matched"), r6(F.avg(F.when(F.col("f.matched"), F.col("f.score")).otherwise(0.0))).alias("score"))


@query(f"""with {ITEMS_SQL} select o_orderkey, i::int as i, lower(trim(nm)) as nm, trim(price) as price, replace(replace(price, ',', ''), '.', '') as price_key from menu""")
def q45_simple_items(spark, sf_dir):
    items = parsed(spark, sf_dir).select("o_orderkey", F.posexplode_outer(receipts.simple_items(F.col("receipt"))).alias("i", "m")).where("i is not null")
    return items.select("o_orderkey", "i", "m.nm", "m.price", text.price_key(F.col("m.price")).alias("price_key"))


@query("select conv_id, list(length(text)::int order by turn) as scores from conversations group by 1")
def q46_score_arrays(spark, sf_dir):
    return experiments.ordered_scores(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("score")), ["conv_id"], "turn", "score")


@query("""with s as (select conv_id, role, length(text) as n, row_number() over (partition by conv_id, role = 'user' order by turn) - 1 as pos from conversations)
select a.conv_id, a.pos::int as pos, a.n::int as first, b.n::int as second from s a join s b on a.conv_id = b.conv_id and a.pos = b.pos where a.role = 'user' and b.role <> 'user'""")
def q47_positional_zip(spark, sf_dir):
    """User turns beside the other turns, by position, as many as the shorter list has."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    lists = c.groupBy("conv_id").agg(*(F.array_sort(F.collect_list(F.when(own, F.struct("turn", "n"))))["n"].alias(name) for name, own in (("first", F.col("role") == "user"), ("second", F.col("role") != "user"))))
    return lists.select("conv_id", F.posexplode_outer(arrays.zipped(F.col("first"), F.col("second"))).alias("pos", "z")).where("pos is not null").select("conv_id", "pos", F.col("z.a").alias("first"), F.col("z.b").alias("second"))


@query(f"""with {SCORED_SQL}, c as (select unnest([0, 1, 2])::int as "true"), n as (select c."true", count(label) as n, {", ".join(f"count(*) filter (pred = {k} and label is not null) as p{k}" for k in range(3))} from c left join scored on label = c."true" group by 1)
select "true", {", ".join(f"round(case when n = 0 then 0 else p{k}::double / n end, 6) as pred_{k}" for k in range(3))} from n""")
def q48_confusion_shares(spark, sf_dir):
    return quality.confusion_shares(scored(spark, sf_dir), "label", "pred").select("true", *(r6(F.col(f"pred_{k}")).alias(f"pred_{k}") for k in range(3)))


@query("select l_returnflag as epoch, round(sum(l_discount * l_quantity)::double / sum(l_quantity)::double, 6) as loss, round(sum(l_tax * l_quantity)::double / sum(l_quantity)::double, 6) as accuracy from lineitem group by 1")
def q49_weighted_means(spark, sf_dir):
    """Batch losses and accuracies, weighted by how many samples a batch has."""
    b = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "epoch")
    return quality.weighted_means(b, ["epoch"], "l_quantity", {"loss": "l_discount", "accuracy": "l_tax"}).withColumn("loss", r6(F.col("loss"))).withColumn("accuracy", r6(F.col("accuracy")))


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) as rank, count(*) over (partition by lang) as n from documents),
  s as (select doc_id, case when rank <= floor(n * 0.7) then 'train' when rank <= floor(n * 0.7) + floor(n * 0.15) then 'val' else 'test' end as split from r)
select split, count(*) as images, count(l.doc_id) as annotations from s left join (select distinct doc_id from labels) l using (doc_id) group by 1""")
def q50_split_counts(spark, sf_dir):
    split = quality.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"])
    return experiments.split_counts(split, table(spark, sf_dir, "labels"), "doc_id")


@query(f"""with {POLYGONS_SQL}, a as (select p_partkey, degrees(atan2(q[2][2] - q[1][2], q[2][1] - q[1][1])) as angle from polygons)
select p_partkey, round(angle, 6) as angle from a where abs(angle) < 45""")
def q51_flat_angles(spark, sf_dir):
    p = polygons(spark, sf_dir).select("p_partkey", arrays.angle(F.col("polygon")[0], F.col("polygon")[1]).alias("angle"))
    return p.where(arrays.nearly_level(F.col("angle"))).withColumn("angle", r6(F.col("angle")))


@query("with n as (select case quality when 1 then 'ready' else 'not_ready' end as label, count(*) as n from labels group by 1) select label, n, round(n / (select sum(n) from n)::double, 6) as share from n")
def q52_label_shares(spark, sf_dir):
    return labelling.distribution(table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "ready").otherwise("not_ready").alias("label"))).withColumn("share", r6(F.col("share")))


@query("""select doc_id::varchar || '.png' as image_path, lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') as stem, 'original' as degradation from documents
union all select doc_id::varchar || '_blur.png', lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0'), 'blur_light' from documents where lang = 'en'""")
def q53_labelling_tasks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("stem", text.zero_padded(F.col("doc_id")))
    original, blurred = (d.withColumn("image_path", F.concat(F.col("doc_id").cast("string"), F.lit(end))).withColumn("degradation", F.lit("blur_light")) for end in (".png", "_blur.png"))
    return labelling.tasks(original, blurred.where("lang = 'en'"))


@query(f"""with {BOXES_SQL} select doc_id, seq::int as seq, x1::int as x1, y1::int as y1, (x1 + 30)::int as x2, (y1 + 12)::int as y2, [(seq % 3 = 0)::int, (seq % 3 = 1)::int, (seq % 3 = 2)::int] as one_hot
from boxes where confidence - 0.35 >= 0""")
def q54_usable_tokens(spark, sf_dir):
    """Boxes given by left, top, width and height; words of negative confidence go."""
    b = word_boxes(spark, sf_dir).withColumn("confidence", F.col("confidence") - 0.35)
    b = layout.usable_tokens(b).withColumn("box", arrays.edge_box(F.col("bbox.x1"), F.col("bbox.y1"), F.lit(30), F.lit(12)))
    return b.select("doc_id", "seq", "box.*", arrays.one_hot(F.col("seq") % 3, 3).alias("one_hot"))


# --- the registry of experiments ------------------------------------------------------------------------------------

ABLATION = registry.chosen("5")
FIGURES = ("cer_mean", "cer_median", "wer_mean", "wer_median", "f1_mean", "anls_mean", "total_em")


def figures(spark, sf_dir, experiments) -> DataFrame:
    out = registry.results(trials.samples(spark, sf_dir), trials.STEPS, experiments)
    return out.select(*(r6(F.col(c)).alias(c) if c in FIGURES else c for c in out.columns))


@query(trials.sql(ABLATION, PARSED_SQL, NLS))
def q55_ablation(spark, sf_dir):
    """Five configurations that share their first steps, each step worked out once."""
    return figures(spark, sf_dir, ABLATION)


@query(trials.sql(registry.catalogue(), PARSED_SQL, NLS))
def q56_experiments(spark, sf_dir):
    """All thirteen experiments in one call: error rates, gates, parsers with their failures, sources of text, scales."""
    return figures(spark, sf_dir, registry.catalogue())


# --- parsers and open JSON ------------------------------------------------------------------------------------------


@query(trials.parsers_sql(PARSED_SQL))
def q57_parser_comparison(spark, sf_dir):
    """Both parsers on recognised texts, with every way of counting: failures, blank texts, missing totals."""
    rows = trials.answered_receipts(spark, sf_dir)
    out = experiments.compare_parsers(rows, {"regex": "rules", "llm": "model"})
    return out.select(*(r6(F.col(c)).alias(c) if kind == "double" else c for c, kind in out.dtypes))


@query(f"""with {OPEN_SQL}, e as (select x from entries where json_type(x) = 'OBJECT'), n as (select count(*) as n from valid), m as (select count(*) as n from e)
{" union all ".join(f"select '{f}' as field, count(json_type(j, '$.{f}')) as present, count(*) filter (json_type(j, '$.{f}') = 'NULL') as nulls, (select n from n) as total from valid" if not f.startswith("menu.") else f"select '{f}', count(json_type(x, '$.{f[5:]}')), count(*) filter (json_type(x, '$.{f[5:]}') = 'NULL'), (select n from m) from e" for f in openjson.FIELDS)}""")
def q58_key_completeness(spark, sf_dir):
    """Thirteen fields by whether their key is there, and how often it is null; fields of items count items."""
    return experiments.key_completeness(open_receipts(spark, sf_dir), F.col("json"))


@query(f"""with {OPEN_SQL}, c as (select o_orderkey % 4 as part, len(menu) as items from menus)
select part, count(items) as n, round(avg(items), 6) as mean, round(stddev_pop(items), 6) as std, min(items)::int as min, median(items)::double as median, max(items)::int as max from c group by 1""")
def q59_items_per_receipt(spark, sf_dir):
    rows = open_receipts(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 4)
    return experiments.items_per_receipt(rows, F.col("json"), ["part"]).withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


SCALAR = lambda j, p: f"case json_type({j}, '{p}') when 'BOOLEAN' then case {j}->>'{p}' when 'true' then 'True' else 'False' end when 'OBJECT' then null when 'ARRAY' then null else {j}->>'{p}' end"


@query(f"""with {OPEN_SQL},
wrong as (
  select o_orderkey, 0 as a, i as b, 'menu[' || i || ']: object expected' as error from entries where json_type(x) is distinct from 'OBJECT'
  union all select o_orderkey, 0, i, 'menu[' || i || '].unitprice: text expected' from entries where json_type(x, '$.unitprice') in ('ARRAY', 'OBJECT')
  union all select o_orderkey, 0, 0, 'menu: null' from valid where json_type(j, '$.menu') = 'NULL'
  union all select o_orderkey, 1, 0, 'sub_total: object expected' from valid where json_type(j, '$.sub_total') not in ('OBJECT', 'NULL')
  union all select o_orderkey, 2, 0, 'total: missing' from valid where j is not null and coalesce(json_type(j, '$.total'), 'NULL') = 'NULL'
  union all select o_orderkey, 3, 0, 'answer: JSON expected' from valid where j is null),
listed as (select o_orderkey, string_agg(error, '; ' order by a, b) as errors from wrong group by 1),
prices as (select o_orderkey, string_agg({SCALAR("x", "$.price")}, ' ' order by i) filter (json_type(x) = 'OBJECT') as prices from entries group by 1)
select o_orderkey, coalesce(errors, '') as errors, case when j is not null and coalesce(json_type(j, '$.menu'), 'ARRAY') in ('ARRAY', 'OBJECT') then coalesce(prices, '') end as prices, {SCALAR("j", "$.sub_total.subtotal_price")} as subtotal_price, {SCALAR("j", "$.sub_total.tax_price")} as tax_price, {SCALAR("j", "$.total.total_price")} as total_price, {SCALAR("j", "$.total.changeprice")} as changeprice
from valid left join listed using (o_orderkey) left join prices using (o_orderkey)""")
def q60_validated_answers(spark, sf_dir):
    """Answers as receipts whose values are all text, with an error for each path that doesn't fit."""
    v = open_receipts(spark, sf_dir).select("o_orderkey", openjson.validated(F.col("json")).alias("v"))
    r = F.col("v.value")
    return v.select("o_orderkey", F.array_join("v.errors", "; ").alias("errors"), F.array_join(r["menu"]["price"], " ").alias("prices"), r["sub_total"]["subtotal_price"].alias("subtotal_price"), r["sub_total"]["tax_price"].alias("tax_price"), r["total"]["total_price"].alias("total_price"), r["total"]["changeprice"].alias("changeprice"))


@query(f"""with {INVOICES_SQL},
wrong as (
  select o_orderkey, 0 as a, 'itens: null' as error from read where json_type(j, '$.itens') = 'NULL'
  union all select o_orderkey, 1, 'troco: text expected' from read where json_type(j, '$.troco') in ('ARRAY', 'OBJECT')
  union all select o_orderkey, 2, 'impostos: object expected' from read where json_type(j, '$.impostos') not in ('OBJECT', 'NULL')
  union all select o_orderkey, 3, 'answer: JSON expected' from read where j is null),
listed as (select o_orderkey, string_agg(error, '; ' order by a) as errors from wrong group by 1)
select o_orderkey, coalesce(errors, '') as errors, {SCALAR("j", "$.cnpj")} as cnpj, {SCALAR("j", "$.valor_total")} as valor_total, {SCALAR("j", "$.troco")} as troco, {SCALAR("j", "$.impostos.icms")} as icms,
  case when j is not null and json_type(j, '$.itens') is distinct from 'NULL' then coalesce(json_array_length(j, '$.itens'), 0) else -1 end::int as n_items, {SCALAR("j", "$.itens[0].quantidade")} as quantidade
from read left join listed using (o_orderkey)""")
def q61_invoices(spark, sf_dir):
    """Answers as Brazilian invoices: numbers and booleans as texts, an error for each path that doesn't fit."""
    v = open_invoices(spark, sf_dir).select("o_orderkey", invoices.parse_invoice(F.col("json")).alias("v"))
    r = F.col("v.value")
    return v.select("o_orderkey", F.array_join("v.errors", "; ").alias("errors"), r["cnpj"].alias("cnpj"), r["valor_total"].alias("valor_total"), r["troco"].alias("troco"), r["impostos"]["icms"].alias("icms"), F.coalesce(F.size(r["itens"]), F.lit(-1)).alias("n_items"), F.get(r["itens"], F.lit(0))["quantidade"].alias("quantidade"))
