"""Receipts are parsed in batches and read once; fields are compared once."""

from pyspark.sql import functions as F

from docsift.functions import metrics, receipts
from docsift.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parsers_are_compared_in_one_pass(spark):
    p = plan(catalog.q57_parser_comparison(spark, SF))
    assert p.count("l_extendedprice#") and p.count(".parquet") + p.count("Relation [") == 2  # lineitem and part, each once
    assert p.count("parsed(") == 2  # the truth and what was recognised


def test_odd_lines(spark):
    texts = ["Sub Total 5 1.50\n Tea  2 X 3,00 　\nTAX 7\nTax ٣٤ x1.\nCASH .5,\nTotal 1..2.,9", "", None, "Café 1\n12 3\nb 4\nDate 1.2.2020 55\n\U0001d7cf\U0001d7d0 cash \U0001d7cf\U0001d7d0\U0001d7d1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", receipts.parse_receipt(F.col("t")).alias("r")).orderBy("i").collect()
    got = [([(m["nm"], m["cnt"], m["price"]) for m in r["r"]["menu"]], r["r"]["sub_total"] and (r["r"]["sub_total"]["subtotal_price"], r["r"]["sub_total"]["tax_price"]), r["r"]["total"]["total_price"], r["r"]["total"]["cashprice"]) for r in rows]
    assert got[0] == ([("Tea", "2 x", "3,00")], ("1.50", "٣٤"), "1.50", None)
    assert got[1] == got[2] == ([], None, None, None)
    assert got[3] == ([("Café", None, "1")], None, None, "\U0001d7cf\U0001d7d0\U0001d7d1")


def test_fields_are_compared_once(spark):
    p = plan(catalog.q15_receipt_eval(spark, SF))
    assert p.count("batch(") == 1 and "levenshtein" not in p


def test_maps_in_batches(spark):
    rows = [({"a": " x ", "b": "abcd", "only": "1"}, {"b": "abcf", "a": "x", "gone": "2", "none": None}), ({}, {}), (None, {"a": "1"}), ({"a": "1"}, None), ({"a": ""}, {"a": ""})]
    df = spark.createDataFrame(rows, "p map<string,string>, g map<string,string>").coalesce(1)
    p, g = F.col("p"), F.col("g")
    got = df.select(metrics.field_counts(p, g).alias("c"), metrics.mean_anls(p, g).alias("a"), metrics.per_field(p, g).alias("each")).collect()
    assert [tuple(r["c"]) for r in got] == [(2, 1, 1), (0, 0, 0), (None,) * 3, (None,) * 3, (0, 0, 0)]
    assert [round(r["a"], 6) for r in got] == [round((0.75 + 0 + 1 + 0) / 4, 6), 0, 0, 0, 1]
    assert sorted(tuple(f) for f in got[0]["each"]) == [("a", "x", "x", 1.0, True), ("b", "abcd", "abcf", 0.75, True), ("gone", "", "2", 0.0, False), ("only", "1", "", 0.0, False)]
    assert [r["each"] for r in got[1:]] == [[], None, None, []]


def test_fields_of_texts_and_of_parsed_receipts_are_the_same(spark):
    texts = ["Sub Total 5 1.50\n Tea  2 X 3,00 　\nCafé 4\nTAX 7\nTax ٣٤ x1.\nCASH .5,\nTotal 1..2.,9", "", None, "red bolt  3 x  10.00\n\nnew ring  12 x  7.50\nTOTAL  17.50", "Change 1.00\nDISC 20 30"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for r in rows.select("t", receipts.text_fields(F.col("t")).alias("own"), receipts.fields(receipts.parse_receipt(F.col("t"))).alias("want")).collect():
        assert (r["own"] is None) if r["t"] is None else (list(r["own"].items()) == list(r["want"].items()))
    assert rows.where("t is null").select(receipts.text_fields(F.col("t"))).first()[0] is None
    assert rows.where("i > 100").select(receipts.text_fields(F.col("t"))).count() == 0


def test_field_scores_are_those_of_the_columns(spark):
    total = "total.total_price"
    rows = [({total: " 1.0A", "a": "x"}, {total: "1.0a ", "b": None}), ({}, {}), (None, {total: "1"}), ({total: "1"}, None), (None, None), ({"a": "abcd"}, {"a": "abce", total: ""}), ({total: None}, {"c": "q"})]
    df = spark.createDataFrame(rows, "p map<string,string>, g map<string,string>").coalesce(1)
    p, g = F.col("p"), F.col("g")
    of = lambda m: F.coalesce(F.try_element_at(m, F.lit(total)), F.lit(""))
    zero = lambda c: F.when(p.isNull(), 0.0).otherwise(c)
    want = [p.isNull(), zero(metrics.field_f1(p, g)["f1"]), zero(metrics.mean_anls(p, g)), zero(F.when(metrics.exact_match(of(p), of(g)), 1.0).otherwise(0.0))]
    for r in df.select(metrics.field_scores(p, g).alias("own"), F.struct(*want).alias("want")).collect():
        assert tuple(r["own"]) == tuple(r["want"])


def test_fields_of_experiments_are_worked_out_once(spark):
    from docsift.operators import registry
    from docsift.plans import trials

    p = plan(registry.scores(trials.samples(spark, SF), trials.STEPS, registry.catalogue()))
    assert p.count("batch(") == 5 and p.count("parsed(") == 1 and p.count("parsed_fields(") == 3
    assert p.count("from_json(") == 6  # three for each of two answers
