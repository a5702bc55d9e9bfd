"""A labelling stream that is killed in the middle of a batch, and goes on."""

import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from docsift.streaming import labels

KILLED = """
import os, sys
from docsift.session import local_session
from docsift.streaming import labels
from pyspark.sql import functions as F
root = sys.argv[1]
spark = local_session(2, 2, "killed")
truth = spark.range(40).select(F.col("id").cast("string").alias("stem"), F.lit("abcd").alias("gt"))
seen = []

def recognise(batch):
    seen.append(1)
    if len(seen) == 3:
        # half a batch is there, without _SUCCESS, when the process dies
        batch.selectExpr("image_path", "degradation", "1.0D as cer", "'half' as label", "2L as batch").limit(3).write.mode("overwrite").parquet(f"{root}/labels/batch=2")
        os.remove(f"{root}/labels/batch=2/_SUCCESS")
        os.kill(os.getpid(), 9)
    return batch.select("image_path", F.lit("abcx").alias("text"))

labels.label_stream(labels.task_stream(spark, f"{root}/tasks", 1), recognise, truth, f"{root}/labels", f"{root}/checkpoint").awaitTermination()
"""


def add_tasks(root: Path, name: str, ids):
    (root / "tasks").mkdir(exist_ok=True)
    (root / "tasks" / name).write_text("".join(json.dumps({"image_path": f"{i}.png", "stem": str(i), "degradation": "original"}) + "\n" for i in ids))


def test_a_killed_stream_goes_on(spark, tmp_path):
    for k in range(5):
        add_tasks(tmp_path, f"{k}.json", range(8 * k, 8 * k + 8))
    died = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], cwd=Path(__file__).parents[1], capture_output=True)
    assert died.returncode != 0
    assert len(labels.whole_batches(spark, str(tmp_path / "labels"))) == 2 and labels.written_labels(spark, str(tmp_path / "labels")).count() == 16
    truth = spark.range(40).select(F.col("id").cast("string").alias("stem"), F.lit("abcd").alias("gt"))
    calls = []

    def recognise(batch):
        calls.append(1)
        return batch.select("image_path", F.lit("abcx").alias("text"))

    run = lambda: labels.label_stream(labels.task_stream(spark, str(tmp_path / "tasks"), 1), recognise, truth, str(tmp_path / "labels"), str(tmp_path / "checkpoint")).awaitTermination()
    run()
    got = labels.written_labels(spark, str(tmp_path / "labels"))
    assert sorted(int(r["image_path"][:-4]) for r in got.collect()) == list(range(40))
    assert {(r["cer"], r["label"]) for r in got.collect()} == {(0.25, "not_ready")} and len(calls) == 3  # the two batches before the kill aren't done again
    add_tasks(tmp_path, "9.json", [3, 39, 40])  # two of them are labelled already, one has no truth
    run()
    assert labels.written_labels(spark, str(tmp_path / "labels")).count() == 40 and len(calls) == 4
    run()
    assert len(calls) == 4


def test_no_labels_yet(spark, tmp_path):
    assert labels.written_labels(spark, str(tmp_path / "none")).collect() == []
