"""Tables of this domain made from the driver's tables, as DataFrames and as SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents):
    return F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, text): one order is one receipt: its items, Sub Total, Tax, TOTAL, Cash and Change."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = F.concat("p_name", F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit(" x  "), money(cents))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", line.alias("line"))
    sums = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum(cents).alias("sub"))
    tax = (F.col("sub") / 10).cast("long")
    sums = sums.withColumn("tax", tax).withColumn("total", F.col("sub") + F.col("tax"))
    sums = sums.withColumn("cash", ((F.col("total") / 10000).cast("long") + 1) * 10000)
    lines = F.concat(
        F.col("rows.line"),
        F.array(F.concat(F.lit("Sub Total  "), money(F.col("sub"))), F.concat(F.lit("Tax 10%  "), money(F.col("tax"))), F.concat(F.lit("TOTAL  "), money(F.col("total"))), F.concat(F.lit("Cash  "), money(F.col("cash"))), F.concat(F.lit("Change  "), money(F.col("cash") - F.col("total")))),
    )
    return sums.select("o_orderkey", F.array_join(lines, "\n").alias("text"))


MONEY = "({0} // 100)::varchar || '.' || lpad(({0} % 100)::varchar, 2, '0')"
RECEIPTS_SQL = f"""
items as (
  select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, round(l_extendedprice * 100)::bigint as cents,
    p_name || '  ' || l_quantity::int::varchar || ' x  ' || {MONEY.format("round(l_extendedprice * 100)::bigint")} as line
  from lineitem join part on l_partkey = p_partkey),
sums as (
  select o_orderkey, string_agg(line, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, line) as body, sum(cents)::bigint as sub from items group by 1),
taxed as (select *, sub // 10 as tax, sub + sub // 10 as total from sums),
paid as (select *, (total // 10000 + 1) * 10000 as cash from taxed),
receipts as (
  select o_orderkey, body || chr(10) || 'Sub Total  ' || {MONEY.format("sub")} || chr(10) || 'Tax 10%  ' || {MONEY.format("tax")} || chr(10) || 'TOTAL  ' || {MONEY.format("total")}
    || chr(10) || 'Cash  ' || {MONEY.format("cash")} || chr(10) || 'Change  ' || {MONEY.format("(cash - total)")} as text
  from paid)"""


def noised(c):
    """Digits read as letters."""
    return F.translate(c, "015", "OlS")


def noised_sql(c: str) -> str:
    return f"translate({c}, '015', 'OlS')"


def ascii_only(c):
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "?")


def ascii_sql(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '?', 'g')"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, pred, gt) of benchmark texts: pred lacks each seventh word and has digits and some letters misread."""
    words = F.filter(F.split(ascii_only(F.col("text")), "[ \n]+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: i % 7 != 6)
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate(F.array_join(kept, " "), "os", "05").alias("pred"), F.array_join(words, " ").alias("gt"))


PAIRS_SQL = f"""
split as (select item_id, list_filter(regexp_split_to_array({ascii_sql("text")}, '[ \\n]+'), lambda w: w <> '') as words from benchmark),
pairs as (
  select item_id, translate(array_to_string([words[i] for i in range(1, len(words) + 1) if (i - 1) % 7 <> 6], ' '), 'os', '05') as pred, array_to_string(words, ' ') as gt from split)"""


def turn_id():
    return (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")


def words_of(c):
    return F.filter(F.split(c, "[ \n]+"), lambda w: w != "")


def placed(seq) -> list:
    """confidence and bbox of a turn's word."""
    x1, y1 = (seq % 10) * 40, (seq / 10).cast("int") * 20 + (seq * 7) % 15
    box = F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 30).cast("int").alias("x2"), (y1 + 12).cast("int").alias("y2"))
    return [((seq % 10 + 1) / 10.0).alias("confidence"), box.alias("bbox")]


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words of conversation turns: ten words a line, lines 20 pixels apart, words up to 14 pixels off their line."""
    words = table(spark, sf_dir, "conversations").select(turn_id(), F.posexplode(words_of("text")).alias("seq", "text"))
    return words.select("doc_id", "seq", "text", *placed(F.col("seq")))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, boxes): the same boxes, in an array for each document. Turns meet as texts, before they are boxes; they are dealt to all
    shuffle partitions, since Spark would join these by the texts' size, while the work goes by the boxes'."""
    turns = table(spark, sf_dir, "conversations").select(turn_id(), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    pages = turns.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    boxes = F.transform("texts", lambda t: F.transform(words_of(t), lambda w, i: F.struct(i.alias("seq"), w.alias("text"), *placed(i))))
    return pages.select("doc_id", F.flatten(boxes).alias("boxes"))


BOXES_SQL = """
tokens as (
  select conv_id * 1000 + turn as doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) as text,
    generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''), 1) - 1 as seq from conversations),
boxes as (
  select doc_id, seq, text, (seq % 10 + 1) / 10.0::double as confidence, ((seq % 10) * 40)::int as x1, ((seq // 10) * 20 + (seq * 7) % 15)::int as y1,
    ((seq % 10) * 40 + 30)::int as x2, ((seq // 10) * 20 + (seq * 7) % 15 + 12)::int as y2 from tokens)"""


def third_sum(k: int):
    return F.aggregate(F.filter("embedding", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x.cast("double"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logits) of three classes: each the sum of every third component of an embedding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"), F.array(*map(third_sum, range(3))).alias("logits"))


GATED_SQL = """
logits as (select vec_id, label % 3 as label, [list_sum([embedding[i]::double for i in range(1, 65) if (i - 1) % 3 = k]) for k in range(3)] as l from embeddings),
powers as (select *, [exp(x - list_max(l)) for x in l] as e from logits),
probs as (select vec_id, label, [x / list_sum(e) for x in e] as p from powers)"""


def open_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, json): receipts as models write them: keys that are missing or null, numbers and booleans for texts, a single item without a list, other things in lists, trailing commas."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    n = F.col("l_linenumber")
    price = F.when(n % 2 == 0, F.concat(F.lit(',"price":"'), money(cents), F.lit('"'))).otherwise(F.concat(F.lit(',"price":'), cents.cast("string")))
    item = F.concat(F.lit('{"nm":"'), "p_name", F.lit('","cnt":'), F.col("l_quantity").cast("int").cast("string"), price, F.when(n % 3 == 0, ',"unitprice":null').when(n % 5 == 0, ',"unitprice":[1]').otherwise(""), F.lit("}"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", item.alias("item"))
    own = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row))["item"].alias("items"), F.sum(cents).alias("sub"))
    k = F.col("o_orderkey")
    menu = F.when(F.size("items") == 1, F.col("items")[0]).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.when(k % 19 == 0, ',"x",null').otherwise(""), F.lit("]")))
    parts = [
        F.when(k % 13 != 0, F.concat(F.lit('"menu":'), F.when(k % 17 == 0, "null").otherwise(menu))),
        F.when(k % 3 != 0, F.when(k % 7 == 0, '"sub_total":"none"').otherwise(F.concat(F.lit('"sub_total":{"subtotal_price":'), F.col("sub").cast("string"), F.lit(',"tax_price":'), F.when(k % 2 == 0, "true").otherwise("12.5"), F.lit("}")))),
        F.when(k % 23 != 0, F.when(k % 5 == 0, '"total":{}').otherwise(F.concat(F.lit('"total":{"total_price":"'), money(F.col("sub")), F.lit('","cashprice":null'), F.when(k % 2 == 0, ',"changeprice":false').otherwise(""), F.lit("}")))),
    ]
    return own.select("o_orderkey", F.when(k % 29 == 0, "no receipt").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when((k % 11 == 0) & (k % 3 != 0), ",}").otherwise("}"))).alias("json"))


OPEN_SQL = f"""
pieces as (
  select l_orderkey as o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, round(l_extendedprice * 100)::bigint as cents,
    '{{"nm":"' || p_name || '","cnt":' || l_quantity::int::varchar || case when l_linenumber % 2 = 0 then ',"price":"' || {MONEY.format("round(l_extendedprice * 100)::bigint")} || '"' else ',"price":' || round(l_extendedprice * 100)::bigint::varchar end
    || case when l_linenumber % 3 = 0 then ',"unitprice":null' when l_linenumber % 5 = 0 then ',"unitprice":[1]' else '' end || '}}' as item
  from lineitem join part on l_partkey = p_partkey),
grouped as (
  select o_orderkey, string_agg(item, ',' order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, item) as items, count(*) as n, sum(cents)::bigint as sub from pieces group by 1),
open_receipts as materialized (
  select o_orderkey, case when o_orderkey % 29 = 0 then 'no receipt' else '{{' || concat_ws(',',
    case when o_orderkey % 13 <> 0 then '"menu":' || case when o_orderkey % 17 = 0 then 'null' when n = 1 then items else '[' || items || case when o_orderkey % 19 = 0 then ',"x",null' else '' end || ']' end end,
    case when o_orderkey % 3 <> 0 then case when o_orderkey % 7 = 0 then '"sub_total":"none"' else '"sub_total":{{"subtotal_price":' || sub::varchar || ',"tax_price":' || case when o_orderkey % 2 = 0 then 'true' else '12.5' end || '}}' end end,
    case when o_orderkey % 23 <> 0 then case when o_orderkey % 5 = 0 then '"total":{{}}' else '"total":{{"total_price":"' || {MONEY.format("sub")} || '","cashprice":null' || case when o_orderkey % 2 = 0 then ',"changeprice":false' else '' end || '}}' end end)
    || case when o_orderkey % 11 = 0 and o_orderkey % 3 <> 0 then ',}}' else '}}' end end as json from grouped),
valid as materialized (select o_orderkey, case when json_valid(regexp_replace(json, ',\\s*([}}\\]])', '\\1', 'g')) then regexp_replace(json, ',\\s*([}}\\]])', '\\1', 'g')::json end as j from open_receipts),
menus as materialized (select o_orderkey, j, case json_type(j, '$.menu') when 'ARRAY' then from_json(json_extract(j, '$.menu'), '["json"]') when 'OBJECT' then [json_extract(j, '$.menu')] else [] end as menu from valid),
entries as materialized (select o_orderkey, unnest(menu) as x, generate_subscripts(menu, 1) - 1 as i from menus)"""


def open_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, json): an order as a model writes a Brazilian invoice."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("int")).alias("quantity"))
    item = F.concat(F.lit('{"descricao":"produto","quantidade":'), F.when(k % 2 == 0, F.col("quantity").cast("string")).otherwise(F.concat(F.lit('"'), F.col("quantity").cast("string"), F.lit(' UN"'))), F.lit("}"))
    parts = [
        F.concat(F.lit('"cnpj":'), F.when(k % 4 == 0, (k + 12345678000190).cast("string")).otherwise(F.concat(F.lit('"'), (k + 12345678000190).cast("string"), F.lit('"')))),
        F.when(k % 13 != 0, F.concat(F.lit('"itens":'), F.when(k % 17 == 0, "null").otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(item, F.col("n").cast("int")), ","), F.lit("]"))))),
        F.concat(F.lit('"valor_total":'), F.floor("o_totalprice").cast("string"), F.lit(".5")),
        F.concat(F.lit('"troco":'), F.when(k % 19 == 0, "[]").when(k % 3 == 0, "false").otherwise("null")),
        F.when(k % 5 != 0, F.concat(F.lit('"impostos":'), F.when(k % 7 == 0, "3").otherwise('{"icms":7}'))),
    ]
    return o.join(items, "o_orderkey").select("o_orderkey", F.when(k % 29 == 0, F.lit('{"cnpj":')).otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(k % 11 == 0, ", }").otherwise("}"))).alias("json"))


INVOICES_SQL = """
counted as (select l_orderkey as o_orderkey, count(*) as n, sum(l_quantity::int) as quantity from lineitem group by 1),
invoices as materialized (
  select o_orderkey, case when o_orderkey % 29 = 0 then '{"cnpj":' else '{' || concat_ws(',',
    '"cnpj":' || case when o_orderkey % 4 = 0 then (o_orderkey + 12345678000190)::varchar else '"' || (o_orderkey + 12345678000190)::varchar || '"' end,
    case when o_orderkey % 13 <> 0 then '"itens":' || case when o_orderkey % 17 = 0 then 'null' else '[' || rtrim(repeat('{"descricao":"produto","quantidade":' || case when o_orderkey % 2 = 0 then quantity::varchar else '"' || quantity::varchar || ' UN"' end || '},', n::int), ',') || ']' end end,
    '"valor_total":' || floor(o_totalprice)::bigint::varchar || '.5',
    '"troco":' || case when o_orderkey % 19 = 0 then '[]' when o_orderkey % 3 = 0 then 'false' else 'null' end,
    case when o_orderkey % 5 <> 0 then '"impostos":' || case when o_orderkey % 7 = 0 then '3' else '{"icms":7}' end end) || case when o_orderkey % 11 = 0 then ', }' else '}' end end as json
  from orders join counted using (o_orderkey)),
read as materialized (select o_orderkey, case when json_valid(regexp_replace(json, ',\\s*([}\\]])', '\\1', 'g')) then regexp_replace(json, ',\\s*([}\\]])', '\\1', 'g')::json end as j from invoices)"""
