"""Open JSON: presence, typed values, errors by path."""

import pytest
from pyspark.sql import functions as F

from docsift.functions import invoices, openjson
from docsift.operators import experiments


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "j string").select(column(F.col("j")).alias("x")).first()["x"]


@pytest.mark.parametrize(("json", "want"), [("12.0", "12.0"), ("12", "12"), ("94.510", "94.51"), ("true", "True"), ("false", "False"), ('"7"', "7"), ("null", None), ("[1]", None), ("{}", None), ("1e5", "100000.0"), ("12345678.5", "12345678.5"), ("123456789012345678901234", "123456789012345678901234"), ("-3", "-3"), ("0.5", "0.5")])
def test_scalars_as_text(spark, json, want):
    assert one(spark, json, lambda c: openjson.text_of(openjson.parsed(c))) == want


def test_presence_tells_null_from_absent(spark):
    rows = ['{"menu": [{"nm": "a", "cnt": null}, {"nm": null, "price": 1}, "x", null], "total": {"total_price": null}}', '{"menu": {"nm": "b"}, "sub_total": "none", "total": null}', '{"menu": null}', "{}", "no", "", None, '{"menu": [],}']
    got = {r["field"]: (r["present"], r["nulls"], r["total"]) for r in experiments.key_completeness(spark.createDataFrame([(r,) for r in rows], "j string"), F.col("j")).collect()}
    assert got["menu"] == (4, 1, 8) and got["total"] == (2, 1, 8) and got["sub_total"] == (1, 0, 8)
    assert got["menu.nm"] == (3, 1, 3) and got["menu.cnt"] == (1, 1, 3) and got["menu.price"] == (1, 0, 3) and got["menu.unitprice"] == (0, 0, 3)
    assert got["total.total_price"] == (1, 1, 8) and got["sub_total.tax_price"] == (0, 0, 8) and len(got) == 13
    none = {r["field"]: r["total"] for r in experiments.key_completeness(spark.createDataFrame([], "j string"), F.col("j")).collect()}
    assert set(none.values()) == {0} and len(none) == 13
    sizes = experiments.items_per_receipt(spark.createDataFrame([(r,) for r in rows], "j string"), F.col("j")).first()
    assert (sizes["n"], sizes["min"], sizes["max"]) == (8, 0, 4)


@pytest.mark.parametrize(
    ("answer", "errors"),
    [
        ('{"menu": {"nm": "Tea", "price": 1.5}, "total": {"total_price": true}}', []),
        ('{"menu": [], "total": {},}', []),
        ("{}", ["total: missing"]),
        ('{"menu": null, "total": null}', ["menu: null", "total: missing"]),
        ('{"menu": 3, "sub_total": [], "total": {"total_price": {}}}', ["menu: list expected", "sub_total: object expected", "total.total_price: text expected"]),
        ('{"menu": [{"nm": ["a"]}, 5, null], "total": {}}', ["menu[0].nm: text expected", "menu[1]: object expected", "menu[2]: object expected"]),
        ("[1]", ["answer: object expected"]),
        ("sorry", ["answer: JSON expected"]),
        (None, ["answer: JSON expected"]),
    ],
)
def test_errors_by_path(spark, answer, errors):
    got = one(spark, answer, openjson.validated)
    assert got["errors"] == errors
    if not errors:
        assert got["value"]["total"] is not None and isinstance(got["value"]["menu"], list)


def test_invoices(spark):
    got = one(spark, '{"cnpj": 12, "itens": [{"descricao": "x", "quantidade": 2.0, "valor_total": false}], "impostos": {"icms": 1}, "unknown": [1],}', invoices.parse_invoice)
    assert got["errors"] == [] and got["value"]["cnpj"] == "12" and got["value"]["impostos"]["icms"] == "1"
    assert tuple(got["value"]["itens"][0]) == ("x", "2.0", None, None, "False")
    assert one(spark, '{"itens": null}', invoices.parse_invoice)["errors"] == ["itens: null"]
    assert one(spark, "{}", invoices.parse_invoice)["value"]["itens"] == []
    text = one(spark, "CUPOM", invoices.invoice_prompt)
    assert "CUPOM" in text and "itens (descricao, quantidade" in text and "chave_acesso" in text and one(spark, None, invoices.invoice_prompt)


def test_degraded_set(spark, tmp_path):
    import numpy as np

    from docsift.operators import degrade

    x = np.full((24, 30, 3), 200, np.uint8)
    rows = [(f"{i:04d}", 24, 30, 3, bytearray(x.tobytes())) for i in range(4)] + [("gray", 5, 6, 1, bytearray(30)), ("broken", 9, 9, 3, bytearray(b"x"))]
    images = spark.createDataFrame(rows, "stem string, height int, width int, channels int, data binary").repartition(2)
    meta = degrade.generate(images, str(tmp_path / "set"), 5)
    by = {}
    for r in meta.collect():
        by.setdefault(r["original"], set()).add(r["degradation"])
        assert (tmp_path / "set" / r["output"]).read_bytes()[:2] in (b"P5", b"P6")
    assert {k: len(v) for k, v in by.items()} == {**{f"{i:04d}.pnm": 6 for i in range(4)}, "gray.pnm": 6, "broken.pnm": 1} and all("original" in v for v in by.values())
    again = degrade.degraded(images, 5).where("stem = '0001'")
    first = {r["degradation"]: bytes(r["data"]) for r in again.collect()}
    assert first == {r["degradation"]: bytes(r["data"]) for r in degrade.degraded(images.repartition(1), 5).where("stem = '0001'").collect()}
    failed = degrade.degraded(images, 5).where("error is not null").collect()
    assert {r["stem"] for r in failed} == {"broken"} and len(failed) == 5


def test_values_are_taken_out_of_an_answer_once(spark):
    """A nested value isn't looked up again for each thing that is asked of it, so the plan stays small."""
    plan = spark.range(1).select(openjson.validated(F.lit("{}")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get(") < 400
