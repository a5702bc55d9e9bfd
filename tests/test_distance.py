"""Distances of whole texts in batches, against brute force and against the rates of the JVM's levenshtein."""

import random

import pytest
from pyspark.sql import functions as F

from docsift.functions import distance, metrics


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs():
    r = random.Random(5)
    out = [("", ""), ("x", ""), ("", "x"), ("a \x1c b　c", "a b c")]
    for n in [1, 2, 5, 63, 64, 65, 127, 128, 129, 200, 300, 520, 600]:
        a = "".join(r.choice("abcé😀 ") for _ in range(n))
        b = list(a)
        for _ in range(n // 5):
            b.insert(r.randint(0, len(b)), r.choice("abxy "))
            b.pop(r.randrange(len(b)))
        out += [(a, "".join(b)), ("".join(b)[: n // 2], a)]
    return out


def test_distances_against_brute_force(monkeypatch):
    a, b = map(list, zip(*pairs(), strict=True))
    want = [brute(*x) for x in pairs()]
    assert distance.by_characters(a, b).tolist() == want
    monkeypatch.setattr(distance, "BYTES", 1)  # a row a batch
    assert distance.by_characters(a, b).tolist() == want
    assert distance.by_words([x.split(" ") for x in a], [x.split(" ") for x in b]).tolist() == [brute(x.split(" "), y.split(" ")) for x, y in pairs()]


def test_rates_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([*pairs(), (None, None), (None, "x"), ("x", None)], "p string, g string")
    p, g = F.col("p"), F.col("g")
    for r in rows.select(distance.text_rates(p, g).alias("r"), metrics.cer(p, g).alias("cer"), metrics.wer(p, g).alias("wer")).collect():
        assert tuple(r["r"]) == pytest.approx((r["cer"], r["wer"]))


@pytest.mark.parametrize("name", ["q43_receipt_report", "q55_ablation", "q56_experiments"])
def test_whole_texts_are_compared_in_batches(spark, name, monkeypatch):
    """Not by the JVM's levenshtein, whose time is the product of both lengths."""
    from docsift.operators import registry
    from docsift.plans import catalog, trials

    if name.startswith("q43"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    else:
        plan = registry.scores(trials.samples(spark, "/root/testdata/sf0.001"), trials.STEPS, catalog.ABLATION if name.startswith("q55") else registry.catalogue())
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "counted(" in text and ("levenshtein(" not in text or name == "q56_experiments")  # fields of q56 are short values


def test_distances_near_and_beyond_the_bands():
    """Pairs whose distance or difference in size is about what a band of 64 or 128 diagonals holds."""
    r = random.Random(9)
    a, b = [], []
    for size in (66, 130, 131, 200, 270):
        for changes in (0, 1, 30, 62, 64, 65, 66, 90, 127, 129):
            for cut in (0, 1, 62, 63, 64, 65, 127, 128):
                x = "".join(r.choice("abcdefgh") for _ in range(size))
                y = list(x[min(cut, size - 1) :])
                for _ in range(changes):
                    y.insert(r.randint(0, len(y)), r.choice("abz"))
                a.append(x)
                b.append("".join(y[: r.choice((size, len(y)))]))
    assert distance.by_characters(a, b).tolist() == [brute(*p) for p in zip(a, b, strict=True)]
    shifted = ["".join(r.choice("xyz") for _ in range(k)) + x[: len(x) - k] for k in (31, 32, 33, 63, 64, 65) for x in a[:80:8]]
    whole = [x for _ in range(6) for x in a[:80:8]]
    assert distance.by_characters(whole, shifted).tolist() == [brute(*p) for p in zip(whole, shifted, strict=True)]


def test_words_are_split_as_the_columns_split_them(spark):
    odd = ["a\x1cb c", "\x1f", " a\x85b\xa0c d　 ", "", "x​y", "\x0b\x0ca\rb"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(metrics.tokens("t").alias("w")).collect()
    assert distance.words(odd) == [r["w"] for r in rows]


@pytest.mark.parametrize("name", ["q55", "q56"])
def test_samples_texts_are_compared_in_one_call(spark, name):
    """Not a call for each text, and not all of them twice: an explode has Spark filter on the size of its array, below the step that makes it."""
    from docsift.operators import registry
    from docsift.plans import catalog, trials

    plan = registry.scores(trials.samples(spark, "/root/testdata/sf0.001"), trials.STEPS, catalog.ABLATION if name == "q55" else registry.catalogue())
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("counted(") == 1
