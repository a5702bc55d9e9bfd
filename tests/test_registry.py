"""The experiment registry: shared steps, table steps, failures, gates."""

import json

import pytest
from pyspark.sql import functions as F

from docsift.operators import registry
from docsift.operators.registry import Config, Experiment, Table

SAMPLES = "sample long, value string, gt string, gt_fields map<string,string>, p double, rejects boolean"
ROWS = [
    (1, "aB", "ab", {"total.total_price": "10"}, 0.1, False),
    (2, "xy", "ab", {"total.total_price": "20", "menu.0.nm": "tea"}, 0.6, True),
    (3, None, "ab", {}, 0.2, False),
    (4, "", "", {}, None, None),
]


def marked(name):
    """A step that leaves its name in the plan."""
    return lambda v: F.when(F.lit(f"mark-{name}") != "", F.lower(v))


def rows(df):
    return {(r["exp"], r["config"]): r for r in df.collect()}


def test_shared_steps_stand_once_in_the_plan(spark):
    steps = {n: marked(n) for n in ("one", "two", "three", "four")}
    experiments = {"a": Experiment("", {"short": Config(("one", "two")), "long": Config(("one", "two", "three"))}), "b": Experiment("", {"other": Config(("one", "two", "four")), "again": Config(("one", "two", "three"))})}
    found = registry.scores(spark.createDataFrame(ROWS, SAMPLES), steps, experiments)
    assert {tuple(n.path) for n in registry.tree(experiments).nodes() if n.ends} == {("one", "two"), ("one", "two", "three"), ("one", "two", "four")}
    seen = []
    counted = {n: (lambda v, n=n: (seen.append(n), steps[n](v))[1]) for n in steps}
    registry.scores(spark.createDataFrame(ROWS, SAMPLES), counted, experiments)
    assert sorted(seen) == ["four", "one", "three", "two"]  # each step is put into the plan once, whatever configurations hold it
    assert found.count() == 3 * len(ROWS)


def test_a_full_catalogue_shares_what_it_can():
    nodes = list(registry.tree(registry.catalogue()).nodes())
    configs = [c for e in registry.catalogue().values() for c in e.configs.values()]
    assert len(registry.catalogue()) == 13 and len(configs) == 32
    assert sum(len(c.path) for c in configs) > 3 * len(nodes)
    assert registry.FULL == ("detect", "deskew", "bilateral", "clahe", "blur")
    assert list(registry.chosen("1,13")) == ["exp1", "exp13"]
    with pytest.raises(ValueError, match="exp14"):
        registry.chosen("14")


def test_gates_failures_and_skipped_samples(spark):
    steps = {"read": lambda v: v, "rules": lambda v: F.when(v == "aB", F.create_map(F.lit("total.total_price"), F.lit("10")))}
    experiments = {"e": Experiment("", {"plain": Config(("read",)), "penalty": Config(("read",), "penalty"), "none": Config(("read",), "below", 0.0), "half": Config(("read",), "below", 0.5), "parsed": Config(("read", "rules"))})}
    got = rows(registry.results(spark.createDataFrame(ROWS, SAMPLES), steps, experiments, arrays=True))
    plain = got["e", "plain"]
    assert (plain["n"], plain["skipped"], plain["rejected"], plain["failed"]) == (3, 1, 0, 0)
    assert plain["cer_mean"] == pytest.approx(0.5) and plain["cer_median"] == 0.5 and plain["cer_scores"] == [0.5, 1.0, 0.0]
    assert (got["e", "penalty"]["rejected"], got["e", "penalty"]["cer_mean"]) == (1, pytest.approx(0.5))
    assert (got["e", "none"]["rejected"], got["e", "none"]["cer_mean"], got["e", "none"]["cer_median"]) == (3, 0.0, None)
    assert (got["e", "half"]["rejected"], got["e", "half"]["cer_mean"]) == (2, 0.5)  # an unknown p isn't below a threshold
    parsed = got["e", "parsed"]
    assert (parsed["n"], parsed["failed"], parsed["f1_mean"], parsed["total_em"]) == (3, 2, pytest.approx(1 / 3), pytest.approx(1 / 3)) and parsed["f1_scores"] == [1.0, 0.0, 0.0]


def test_table_steps_are_written_once_and_may_leave_samples_out(spark, tmp_path):
    ran = []

    def recognise(rows):
        ran.append(rows.columns)
        return rows.where("sample <> 2").select("sample", F.upper("value").alias("value"))

    steps = {"prepare": lambda v: F.concat(v, F.lit("!")), "engine": Table(recognise), "lower": lambda v: F.lower(v), "rules": lambda v: F.when(v.isNotNull(), F.create_map(F.lit("total.total_price"), F.lit("10")))}
    experiments = {"e": Experiment("", {"raw": Config(("prepare", "engine")), "low": Config(("prepare", "engine", "lower")), "parsed": Config(("prepare", "engine", "rules"))})}
    got = rows(registry.results(spark.createDataFrame(ROWS, SAMPLES), steps, experiments, folder=str(tmp_path)))
    assert ran == [["sample", "value"]]
    assert got["e", "raw"]["n"] == 2 and got["e", "raw"]["skipped"] == 2
    assert got["e", "low"]["cer_mean"] == pytest.approx((0.5 + 1.0) / 2)  # "ab!" for "ab", "!" for ""
    assert got["e", "parsed"]["n"] == 2 and got["e", "parsed"]["failed"] == 0
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir()) == ["scores", "step"]


def test_nested_results(spark, tmp_path):
    steps = {"read": lambda v: v}
    out = registry.nested(registry.results(spark.createDataFrame(ROWS, SAMPLES), steps, {"e": Experiment("", {"x": Config(("read",)), "y": Config(("read",), "penalty")})}, arrays=True))
    out.coalesce(1).write.json(str(tmp_path / "results"))
    text = next((tmp_path / "results").glob("part-*")).read_text()
    found = json.loads(text)
    assert found["exp"] == "e" and set(found["configs"]) == {"x", "y"} and found["configs"]["x"]["cer_scores"] == [0.5, 1.0, 0.0]


def test_unknown_steps_and_no_samples(spark):
    none = spark.createDataFrame([], SAMPLES)
    with pytest.raises(ValueError, match="other"):
        registry.results(none, {"read": lambda v: v}, {"e": Experiment("", {"x": Config(("other",))})})
    got = registry.results(none, {"read": lambda v: v}, {"e": Experiment("", {"x": Config(("read",)), "y": Config(("read",), "below", 0.5)})}).orderBy("config").collect()
    assert [(r["n"], r["cer_mean"]) for r in got] == [(0, None), (0, 0.0)]
