"""One file for each row: round trips, tasks that fail, runs that are given up."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docsift.operators.experiments import sample_variants
from docsift.sources.imagefiles import ImageFileWriter, degraded_files, image_metadata, write_image_files


def images(spark, ids):
    stems = spark.createDataFrame([(f"{i:04d}",) for i in ids], "stem string")
    rows = sample_variants(stems, ["blur_light", "noise_heavy", "jpeg_q10"], 2, "stem")
    return rows.withColumn("content", F.concat(F.encode(F.concat("stem", "degradation"), "UTF-8"), F.lit(b"\xff\x00")))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "set")
    assert image_metadata(spark, path).collect() == []
    rows = degraded_files(images(spark, range(30))).repartition(3)
    write_image_files(rows, path)
    meta = image_metadata(spark, path)
    want = {(r["original"], r["degradation"], f"{r['degradation']}/{r['file']}"): bytes(r["content"]) for r in rows.collect()}
    assert {tuple(r)[:3] for r in meta.collect()} == set(want) and meta.count() == 60
    assert all((Path(path) / k[2]).read_bytes() == v for k, v in want.items())
    assert sorted(p.name for p in Path(path).iterdir()) == ["_metadata", "blur_light", "jpeg_q10", "noise_heavy"]
    # the files are images to any reader of folders, and meet their metadata again
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path)
    assert read.count() == 60
    write_image_files(degraded_files(images(spark, range(30, 32))), path)
    assert image_metadata(spark, path).count() == 64
    write_image_files(degraded_files(images(spark, range(2))), path, "overwrite")
    assert image_metadata(spark, path).count() == 4
    write_image_files(rows.limit(0), path)
    assert image_metadata(spark, path).count() == 4


def test_a_task_that_fails_once_is_listed_once(spark, tmp_path):
    writer, rows = ImageFileWriter(str(tmp_path), False), degraded_files(images(spark, range(5))).collect()

    def cut(n):
        yield from rows[:n]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(cut(6))
    assert image_metadata(spark, str(tmp_path)).collect() == []
    writer.commit([writer.write(iter(rows)), None])
    assert image_metadata(spark, str(tmp_path)).count() == len(rows) == len(list(tmp_path.glob("*/*.jpg"))) and not list(tmp_path.glob("*/.*[0-9a-f]"))


def test_a_failed_run_lists_nothing(spark, tmp_path):
    path = str(tmp_path)
    good = degraded_files(images(spark, range(4)))
    write_image_files(good, path)
    bad = good.withColumn("content", F.when(F.col("original") != "0003.jpg", F.col("content"))).repartition(2)
    with pytest.raises(Exception, match="no content"):
        write_image_files(bad.withColumn("original", F.lit("x")), path)
    assert image_metadata(spark, path).count() == 8 and image_metadata(spark, path).where("original = 'x'").isEmpty()
    assert len(list((tmp_path / "_metadata").glob("*.json"))) <= 4
    with pytest.raises(Exception, match="not a file name"):
        write_image_files(good.withColumn("file", F.lit("../out.jpg")), path)
