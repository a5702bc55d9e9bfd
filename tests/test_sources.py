"""Sources and sinks that no query goes through."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.functions import receipts
from docsift.operators import labelling, preprocess, registry, seams
from docsift.operators.registry import Config, Experiment
from docsift.sources import annotations, sinks


def test_shards_are_numbered_through(spark, tmp_path):
    paths = []
    for k, n in enumerate((3, 0, 4)):
        paths.append(str(tmp_path / f"shard-{2 - k}.parquet"))
        spark.createDataFrame([((bytearray([k, i]),), f"gt {k} {i}") for i in range(n)], "image struct<bytes:binary>, ground_truth string").coalesce(1).write.parquet(paths[-1] + ".d")
        next((tmp_path / f"shard-{2 - k}.parquet.d").glob("part-*")).rename(paths[-1])
    got = annotations.dataset_rows(spark, paths, "train").orderBy("idx").collect()
    assert [(r["idx"], bytes(r["image"]), r["ground_truth"]) for r in got] == [(i, bytes(b), f"gt {b[0]} {b[1]}") for i, b in enumerate([(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (2, 2), (2, 3)])]
    assert {r["split"] for r in got} == {"train"}


def test_nested_results_are_read_as_they_are_written(spark, tmp_path):
    body = {"exp1": {"None": {"cer_mean": 0.5, "cer_scores": [0.1, 0.9], "config": "None"}, "Full": {"cer_mean": 0.25, "cer_scores": []}}, "exp2": {"x": {"rejected": 3}}}
    (tmp_path / "results.json").write_text(json.dumps(body))
    got = {(r["exp"], r["config"], r["metric"], r["ord"]): r["value"] for r in annotations.experiment_results(spark, str(tmp_path / "results.json")).collect()}
    assert got == {("exp1", "None", "cer_mean", 0): 0.5, ("exp1", "None", "cer_scores", 0): 0.1, ("exp1", "None", "cer_scores", 1): 0.9, ("exp1", "None", "config", 0): None, ("exp1", "Full", "cer_mean", 0): 0.25, ("exp2", "x", "rejected", 0): 3.0}


def test_results_of_the_registry_go_to_a_store_and_back(spark, tmp_path):
    samples = spark.createDataFrame([(1, "ab", "ab", {}, 0.1, False), (2, "ac", "ab", {}, 0.9, True)], "sample long, value string, gt string, gt_fields map<string,string>, p double, rejects boolean")
    experiments = {f"exp{k}": Experiment("", {"plain": Config(("read",)), "gate": Config(("read",), "penalty")}) for k in (1, 2)}
    for own in (experiments, {"exp2": Experiment("", {"other": Config(("read",))})}):
        out = sinks.merge_results(spark, str(tmp_path / "r"), registry.results(samples, {"read": lambda v: v}, own))
    assert sorted((r["exp"], r["config"], r["rejected"], r["cer_mean"]) for r in out.collect()) == [("exp1", "gate", 1, 0.5), ("exp1", "plain", 0, 0.25), ("exp2", "other", 0, 0.25)]


def test_metadata_and_labels(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps([{"original": "1.jpg", "degradation": "blur_light", "output": "blur_light/1.jpg", "more": 1}, {"original": "2.jpg"}]))
    assert sorted(map(tuple, annotations.metadata(spark, str(tmp_path / "metadata.json")).collect())) == [("1.jpg", "blur_light", "blur_light/1.jpg"), ("2.jpg", None, None)]
    rows = [{"image_path": "a.png", "degradation": "original", "cer": 0.25, "label": "not_ready"}, {"image_path": "b.png", "degradation": "original", "cer": 0.75, "label": "not_ready"}, {"image_path": "c.png", "degradation": "blur", "cer": 0.0, "label": "ready"}]
    (tmp_path / "labels.json").write_text(json.dumps(rows))
    labels = annotations.labels(spark, str(tmp_path / "labels.json"))
    got = {r["degradation"]: (r["n"], r["mean"], r["std"], r["min"], r["median"], r["max"]) for r in labelling.error_statistics(labels).collect()}
    assert got == {"original": (2, 0.5, 0.25, 0.25, 0.5, 0.75), "blur": (1, 0.0, 0.0, 0.0, 0.0, 0.0)}


def test_uploads(spark):
    row = annotations.upload(spark, b"\x89PNG", "a.b.PNG").first()
    assert (row["doc_id"], bytes(row["image"])) == ("a.b.PNG", b"\x89PNG")
    for name in ("a.gif", "noextension"):
        with pytest.raises(ValueError, match="unsupported"):
            annotations.upload(spark, b"", name)


def test_receipts_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("Tea  1 x  5,000\nTOTAL 5,000",), ("",)], "text string").select(receipts.parse_receipt(F.col("text")).alias("r"))
    texts = [r[0] for r in rows.select(sinks.receipt_json(F.col("r"))).collect()]
    first, blank = map(json.loads, texts)
    assert first["menu"][0]["nm"] == "Tea" and first["menu"][0]["sub"] is None and first["total"]["total_price"] == "5,000" and "\n" in texts[0]
    assert blank["menu"] == [] and blank["sub_total"] is None and blank["total"]["total_price"] is None
    sinks.write_json(rows, str(tmp_path / "out"))
    sinks.write_json(rows.limit(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_images_by_degradation(spark, tmp_path):
    rows = spark.createDataFrame([("1", "blur", bytearray(b"x")), ("2", "noise", bytearray(b"y"))], "stem string, degradation string, content binary")
    sinks.write_images(rows, str(tmp_path / "set"))
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if p.is_dir()) == ["degradation=blur", "degradation=noise"]
    assert spark.read.parquet(str(tmp_path / "set")).where("degradation = 'noise'").first()["stem"] == "2"


def test_classifier_seam(spark):
    def model():
        return lambda x: np.stack([x[:, 0], x[:, 1], np.zeros(len(x))], 1)

    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, -5.0])], "doc_id long, features array<double>")
    got = {r["doc_id"]: r["p"] for r in seams.classified(rows, model).collect()}
    assert got[1] == pytest.approx([1 / 3] * 3) and got[2][0] > 0.99 and sum(got[2]) == pytest.approx(1)


def test_preprocessed_rows(spark):
    page = np.full((40, 60, 3), 255, np.uint8)
    page[10:12, 5:55] = 0
    rows = spark.createDataFrame([(1, 40, 60, 3, bytearray(page.tobytes())), (2, 3, 3, 1, bytearray(b"short"))], "doc_id long, height int, width int, channels int, data binary")
    got = {r["doc_id"]: r for r in preprocess.preprocessed(rows).collect()}
    assert (got[1]["channels"], got[1]["error"]) == (1, None) and len(got[1]["data"]) == got[1]["height"] * got[1]["width"] and got[2]["error"] and got[2]["data"] is None
