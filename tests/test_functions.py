"""Text, receipts, metrics and arrays on the fixtures' cases."""

import random

import pytest
from pyspark.sql import functions as F

from docsift.functions import arrays, metrics, receipts, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("1O,OOO", "10,000"), ("Hello World", "Hello World"), ("Solo", "5010"), ("IS", "15"), ("B2B", "828"), ("2xIced", "2x1ced"), ("lol", "101"), ("Oil", "Oil"), ("..", ".."), ("Sub-Total1", "5ub-T0ta11"), ("", "")],
)
def test_numeric_correction(spark, given, want):
    assert one(spark, text.correct_numeric(F.col("t")), t=given) == want


def test_white_space(spark):
    assert one(spark, text.normalize_whitespace(F.col("t")), t="  Hello   World  ") == "Hello World"
    assert one(spark, text.normalize_whitespace(F.col("t")), t=" a \t b\r\n\n  \nc") == "a b\nc"
    assert one(spark, text.normalize_whitespace(F.col("t")), t="") == ""
    assert one(spark, text.clean_box(F.col("t")), t=" 1O \n x") == "10 x"


def test_stem_and_padding(spark):
    assert one(spark, text.stem(F.col("t")), t="a/b/0001.png") == "0001"
    assert one(spark, text.zero_padded(F.lit(12345)), t="") == "12345"
    assert one(spark, text.zero_padded(F.lit(7)), t="") == "0007"
    assert one(spark, text.price_key(F.col("t")), t="75,000.5") == "750005"


def parsed(spark, lines):
    r = one(spark, receipts.parse_receipt(F.col("t")), t=lines)
    return [(m["nm"], m["cnt"], m["price"]) for m in r["menu"]], r["sub_total"] and tuple(r["sub_total"][:4]), tuple(r["total"][:3])


B1 = "Nasi Goreng  2 x  70,000\nIce Tea  1 x  18,000\nSub Total  88,000\nTax 10%  8,800\nTOTAL  96,800"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (B1, ([("Nasi Goreng", "2 x", "70,000"), ("Ice Tea", "1 x", "18,000")], ("88,000", "8,800", None, None), ("88,000", None, None))),
        (B1 + "\nCash  100,000\nChange  3,200", ([("Nasi Goreng", "2 x", "70,000"), ("Ice Tea", "1 x", "18,000")], ("88,000", "8,800", None, None), ("88,000", "100,000", "3,200"))),
        ("TOTAL  150,000", ([], None, ("150,000", None, None))),
        ("Item  10,000\nSub Total  10,000\nTax  1,000\nTOTAL  11,000", ([("Item", None, "10,000")], ("10,000", "1,000", None, None), ("10,000", None, None))),
        ("", ([], None, (None, None, None))),
        ("Thank you for visiting\nDate: 2024-01-01\nCashier: John\nNasi Goreng  50,000\nTOTAL  50,000", ([("Nasi Goreng", None, "50,000")], None, ("50,000", None, None))),
        ("Nasi Goreng  50,000", ([("Nasi Goreng", None, "50,000")], None, (None, None, None))),
        (
            "Pistachio 12,000\nCoca Cola 2x @5,000 10,000\nBread 3 10,000\nA 1,000\n12 34 56\nTotal 5\nTaxa de servico 1,50\nDesconto 2,00\nVALOR TOTAL 9,99",
            ([("Coca Cola", "2 x", "10,000"), ("Bread", None, "10,000"), ("Desconto", None, "2,00")], (None, "1,50", "1,50", "2,00"), ("9,99", None, None)),
        ),
    ],
)
def test_receipts(spark, lines, want):
    assert parsed(spark, lines) == want


def test_null_receipt(spark):
    assert parsed(spark, None) == ([], None, (None, None, None))


def test_model_json(spark):
    r = one(spark, receipts.from_model_json(F.col("t")), t='{"menu": {"nm": "Tea", "price": 5,}, }')
    assert r["menu"][0]["nm"] == "Tea" and r["menu"][0]["price"] == "5" and r["total"]["total_price"] is None
    r = one(spark, receipts.from_model_json(F.col("t")), t='{"menu": [{"nm": "a"}, {"nm": "b"}], "total": {"total_price": "9"}}')
    assert [m["nm"] for m in r["menu"]] == ["a", "b"] and r["total"]["total_price"] == "9"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    rate = lambda f, p, g: one(spark, f(F.col("p"), F.col("g")), p=p, g=g)
    assert rate(metrics.cer, "kitten", "sitting") == pytest.approx(3 / 7)
    assert rate(metrics.nls, "kitten", "sitting") == pytest.approx(4 / 7)
    assert [rate(metrics.cer, *x) for x in (("", ""), ("x", ""), ("", "x"), (None, None))] == [0, 1, 1, 0]
    assert [rate(metrics.wer, *x) for x in (("", ""), ("x", ""), ("", "x"))] == [0, 1, 1]
    assert [rate(metrics.nls, *x) for x in (("", ""), ("x", ""), ("", "x"))] == [1, 0, 0]
    assert rate(metrics.cer, "abcdef", "ab") == 2.0
    assert rate(metrics.wer, "a b c d é f", "a x c é f g") == 0.5
    assert rate(metrics.anls, "88,000", "96,800") == 0.5
    assert rate(metrics.anls, "abc", "xyz") == 0.0
    assert rate(metrics.cer, "é", "e") == 1.0
    assert rate(metrics.exact_match, " Ab ", "aB") is True
    assert rate(lambda a, b: metrics.exact_match(a, b, normalize=False), " Ab ", "aB") is False


def test_word_distance_equals_dynamic_programming(spark):
    r = random.Random(3)
    pairs = [(" ".join(r.choice("abcde") for _ in range(r.randint(0, 12))), " ".join(r.choice("abcde") for _ in range(r.randint(1, 12)))) for _ in range(60)]
    got = spark.createDataFrame(pairs, "p string, g string").select("p", "g", metrics.wer(F.col("p"), F.col("g")).alias("w")).collect()
    for row in got:
        assert row["w"] == pytest.approx(distance(row["p"].split(), row["g"].split()) / len(row["g"].split()))


def test_field_scores(spark):
    rows = spark.createDataFrame([({"a": "x", "b": "hello", "d": "only", "e": ""}, {"a": "x", "b": "qqqqq", "c": "only", "e": " "})], "p map<string,string>, g map<string,string>")
    f = rows.select(metrics.field_f1(F.col("p"), F.col("g")).alias("f"), metrics.mean_anls(F.col("p"), F.col("g")).alias("a")).first()
    assert tuple(f["f"][:3]) == (1, 2, 2)
    assert f["f"]["f1"] == pytest.approx(1 / 3)
    assert f["a"] == pytest.approx(0.25)  # of four fields only a matches; blanks are compared as they are
    long = lambda c: rows.select(F.lit(1).alias("id"), F.explode(c).alias("field", {"p": "pred", "g": "gt"}[c]))
    assert tuple(metrics.joined_field_counts(long("p"), long("g"), "id").first())[1:] == (1, 2, 2)


def test_canonical_receipt_scores_full_marks_although_its_total_is_wrong(spark):
    rows = spark.createDataFrame([(B1 + "\nCash  100,000\nChange  3,200",)], "t string").select(receipts.fields(receipts.parse_receipt(F.col("t"))).alias("p"))
    gt = F.map_concat(F.map_filter("p", lambda k, v: k != "total.total_price"), F.create_map(F.lit("total.total_price"), F.lit("96,800")))
    f = rows.select(metrics.field_f1(F.col("p"), gt).alias("f"), metrics.mean_anls(F.col("p"), gt).alias("a"), F.size("p").alias("n")).first()
    assert (f["n"], f["f"]["tp"], f["f"]["f1"]) == (11, 11, 1.0)
    assert f["a"] == pytest.approx(0.954545, abs=1e-6)


@pytest.mark.parametrize(("p", "g", "want"), [([], [], (1, 1, 1)), (["a"], [], (0, 1, 0)), ([], ["a"], (1, 0, 0)), (["a", "b", ""], ["a", None], (0.5, 1, 2 / 3))])
def test_set_scores(spark, p, g, want):
    rows = spark.createDataFrame([(p, g)], "p array<string>, g array<string>")
    assert tuple(rows.select(metrics.set_f1(F.col("p"), F.col("g")).alias("f")).first()["f"]) == pytest.approx(want)


def test_arrays(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 3.0], [[9.7, 1.2], [0.5, 0.4], [10.9, 8.0], [1.0, 9.9]])], "l array<double>, q array<array<double>>")
    r = rows.select(arrays.argmax(F.col("l")).alias("i"), arrays.softmax(F.col("l")).alias("p"), arrays.polygon_box(F.col("q")).alias("b"), arrays.order_points(F.col("q")).alias("o"), arrays.one_hot(F.lit(1), 3).alias("h")).first()
    assert r["i"] == 1 and sum(r["p"]) == pytest.approx(1)
    assert tuple(r["b"]) == (0, 0, 10, 9)
    assert r["o"] == [[0.5, 0.4], [9.7, 1.2], [10.9, 8.0], [1.0, 9.9]] and r["h"] == [0, 1, 0]
