"""Layout, quality, experiments, seams, sources, sinks and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import experiments, extraction, images, labelling, layout, preprocess, quality, seams
from docsift.sources import annotations, sinks

BOXES = "doc_id long, seq int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>"


def lines(spark, rows):
    return [(r["text"], r["bbox"] and tuple(r["bbox"]), r["confidence"]) for r in layout.merge_lines(spark.createDataFrame(rows, BOXES)).orderBy("line_no").collect()]


def test_line_merge(spark):
    hello = [(1, 0, "Hello", 0.95, (0, 10, 50, 30)), (1, 1, "World", 0.85, (60, 12, 110, 32))]
    assert lines(spark, []) == []
    assert lines(spark, hello[:1]) == [("Hello", (0, 10, 50, 30), 0.95)]
    assert lines(spark, hello) == [("Hello World", (0, 10, 110, 32), pytest.approx(0.9))]
    drift = [*hello, (1, 2, "drift", 0.5, (5, 21, 9, 30)), (1, 3, "next", 0.5, (0, 60, 9, 70))]
    assert [x[0] for x in lines(spark, drift)] == ["Hello drift World", "next"]


def test_box_without_place_is_a_line_of_its_own(spark):
    rows = [(1, 0, "a", 0.9, (0, 1, 5, 5)), (1, 1, "b", 0.9, None), (1, 2, "c", 0.9, (6, 1, 9, 5))]
    assert [x[0] for x in lines(spark, rows)] == ["b", "a c"]


def test_reading_order_and_text(spark):
    rows = [(1, 0, "low", 0.9, (0, 50, 5, 55)), (1, 1, "1O", 0.9, (0, 1, 5, 5)), (1, 2, " ", 0.9, (0, 2, 5, 5)), (1, 3, "high", 0.9, (9, 1, 12, 5))]
    b = spark.createDataFrame(rows, BOXES)
    assert layout.reading_order(b).first()["text"] == "1O\nhigh\nlow"
    assert layout.document_text(b).first()["text"] == "10 high\nlow"


def test_labels_and_gates(spark):
    rows = spark.createDataFrame([(0.0499,), (0.05,), (0.2,), (0.2001,)], "c double")
    assert [r[0] for r in rows.select(quality.cer_label(F.col("c"))).collect()] == ["ready", "marginal", "marginal", "not_ready"]
    swept = quality.threshold_sweep(spark.createDataFrame([(0.1, 0.2), (0.5, 0.4), (0.9, 1.0)], "p_not_ready double, cer double")).orderBy("threshold").collect()
    assert [(r["accepted"], r["rejected"], round(r["cer"], 6)) for r in swept] == [(0, 3, 0.0), (1, 2, 0.2), (1, 2, 0.2), (2, 1, 0.3)]


def test_classification_report(spark):
    matrix = [[79, 16, 9], [32, 111, 31], [17, 64, 212]]
    rows = spark.createDataFrame([(i, j) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)], "t int, p int")
    report = {r["class"]: r for r in quality.class_report(rows, "t", "p").collect()}
    assert report["accuracy"]["f1"] == pytest.approx(402 / 571)
    assert [round(report[c]["precision"], 6) for c in "012"] == [0.617188, 0.581152, 0.841270]
    assert [round(report[c]["f1"], 6) for c in "012"] == [0.681034, 0.608219, 0.777982]
    assert [list(r)[1:] for r in quality.confusion(rows, "t", "p").orderBy("true").collect()] == matrix


def test_split_counts(spark):
    sizes = {"ready": 688, "marginal": 1156, "not_ready": 1947}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "label string, i int")
    split = quality.stratified_split(rows, "label", quality.random_order("label", "i"))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 2652, "val": 568, "test": 571}


def test_running_best_keeps_the_earliest(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 3.0, 2.0, 3.0, 4.0])], "g int, i int, v double")
    assert [r["is_best"] for r in quality.running_best(rows, "g", ["i"], "v").orderBy("i").collect()] == [True, True, False, False, True]


def test_running_best_of_one_hot_group(spark):
    """One user, rows that are equal in the first order column, ties in value and order, nulls; no range holds them all."""
    import random

    from docsift.operators import ranges

    dice = random.Random(3)
    rows = [(dice.choice([None, "u"]) if i < 40 else "u", 7, i // 2, dice.choice([None, 1.0, float(i // 9), 5.0])) for i in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "u string, day int, i int, v double, before string").repartition(3)
    held = ranges.ranged(df, ["u"], ["day", "i"], {})
    assert held.groupBy("range").count().agg(F.max("count")).first()[0] < 250
    got = {}
    for r in quality.running_best(df, "u", ["day", "i"], "v").collect():
        got.setdefault((r["u"], r["i"]), []).append(r)
    best = {}
    for u, i in sorted(got, key=lambda k: (str(k[0]), k[1])):
        own, before = got[u, i], best.get(u)
        values = [r["v"] for r in own if r["v"] is not None]
        best[u] = max([*values, before if before is not None else -1.0])
        best[u] = None if best[u] == -1.0 else best[u]
        assert max((r["best"] for r in own if r["best"] is not None), default=None) == best[u]
        assert len(values) == 0 or before is None or any(r["is_best"] for r in own) == (max(values) > before)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert quality.roc_auc(rows, F.col("y") == 1, F.col("s")).first()["auc"] == pytest.approx(0.625)


def test_stage_deltas_and_upsert(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([0.294121, 0.183919, 0.246391, 0.158189])], "stage int, v double")
    d = experiments.stage_deltas(rows, "stage", "v").orderBy("stage").collect()
    assert [round(r["delta"], 6) for r in d] == [0.294121, -0.110202, 0.062472, -0.088202] and d[-1]["total"] == pytest.approx(0.158189)
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "exp string, v int")
    new = spark.createDataFrame([("a", 9)], "exp string, v int")
    once = experiments.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 9), ("b", 3)] == sorted(map(tuple, experiments.upsert(once, new).collect()))


def test_results_are_merged_on_disk(spark, tmp_path):
    path = str(tmp_path / "results")
    for rows in ([("a", 1), ("b", 2)], [("a", 5)], [("a", 5)]):
        out = sinks.merge_results(spark, path, spark.createDataFrame(rows, "exp string, v int"))
    assert sorted(map(tuple, out.collect())) == [("a", 5), ("b", 2)]


def test_labelling_resumes(spark):
    todo = spark.createDataFrame([(f"{i}.png", str(i), "original") for i in range(4)], "image_path string, stem string, degradation string")
    seen = spark.createDataFrame([(f"{i}.png", "abcd" if i else "abcx") for i in range(4)], "image_path string, text string")
    truth = spark.createDataFrame([("0", "abcd"), ("1", "abcd"), ("2", " "), ("3", "abcd")], "stem string, gt string")
    done = spark.createDataFrame([("3.png",)], "image_path string")
    first = labelling.assign_labels(todo, seen, truth, done)
    assert {r["image_path"]: r["label"] for r in first.collect()} == {"0.png": "not_ready", "1.png": "ready"}
    again = done.union(first.select("image_path"))
    assert labelling.assign_labels(todo, seen, truth, again).count() == 0


def test_recognition_seam(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a b")), (2, None)], "doc_id long, image binary")
    assert [r["text"] for r in seams.recognise(rows, seams.StubEngine).orderBy("seq").collect()] == ["a", "b"]
    failed = seams.recognise(rows, seams.engine("tesseract"), keep_errors=True).collect()
    assert sorted(r["doc_id"] for r in failed) == [1, 2] and all("isn't installed" in r["error"] for r in failed)  # a null image is a row, too
    with pytest.raises(ValueError, match="unknown engine"):
        seams.engine("other")


def test_language_model_seam_retries(spark):
    calls = spark.createDataFrame([(1, "x"), (2, "bad")], "doc_id long, prompt string")

    def ask(p):
        if p == "bad":
            raise RuntimeError("500")
        return p.upper()

    got = {r["doc_id"]: (r["answer"], r["error"]) for r in seams.answered(calls, ask).collect()}
    assert got == {1: ("X", None), 2: (None, "500")}


def test_image_kernels(spark):
    x = np.random.default_rng(0).integers(0, 256, (40, 60, 3), dtype=np.uint8)
    assert images.to_gray(x).shape == (40, 60) and images.to_three(images.to_gray(x)).shape == (40, 60, 3)
    flat = np.full((30, 30), 77, np.uint8)
    assert (images.gaussian_blur(flat, 5) == 77).all() and (images.closing(flat) == 77).all()
    assert set(np.unique(images.adaptive_threshold(x))) <= {0, 255}
    assert images.scale(x, 0.5).shape == (20, 30, 3) and images.scale(x, 1.0) is x
    assert (images.rotate(flat, 0) == flat).all() and images.rotate(x, 30, expand=True).shape[0] > 40
    corners = [[5, 5], [54, 5], [54, 34], [5, 34]]
    ramp = np.add.outer(np.arange(40) * 2, np.arange(60) * 2).astype(np.uint8)
    out = images.four_point_transform(ramp, corners)
    assert out.shape == (29, 49) and out[0, 0] == ramp[5, 5] and out[-1, -1] == ramp[34, 54]
    for name, f in images.DEGRADATIONS.items():
        assert f(x, 1).shape == x.shape and f(images.to_gray(x), 1).shape == x.shape[:2], name
    rows = spark.createDataFrame([(1, 2, 2, 1, bytearray(b"\x00\x01\x02\x03")), (2, 2, 2, 1, bytearray(b"\x00"))], "doc_id long, height int, width int, channels int, data binary")
    out = {r["doc_id"]: r for r in images.transformed(rows, images.to_gray).collect()}
    assert bytes(out[1]["data"]) == b"\x00\x01\x02\x03" and out[2]["error"]


def test_annotations(spark, tmp_path):
    note = {"valid_line": [{"words": [{"text": " a "}, {"text": ""}, {"text": "b"}]}, {"words": [{"text": " "}]}, {"words": [{"text": "c"}]}], "gt_parse": json.dumps({"total": {"total_price": "5"}})}
    for name, body in (("0001", note), ("0002", {"valid_line": []}), ("0003", note)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    for name in ("0001.jpg", "0001.png", "0002.png"):
        (tmp_path / name).write_bytes(b"x")
    notes = annotations.annotations(spark, str(tmp_path / "*.json"))
    got = notes.orderBy("stem").select(annotations.annotation_text(F.col("json")).alias("lines"), annotations.annotation_text(F.col("json"), False).alias("flat"), annotations.ground_truth(F.col("json")).alias("gt")).collect()
    assert (got[0]["lines"], got[0]["flat"], json.loads(got[0]["gt"])) == ("a b\nc", "a b c", {"total": {"total_price": "5"}}) and got[1]["gt"] == "{}"
    paired = annotations.paired_samples(notes, annotations.images(spark, str(tmp_path))).collect()
    assert [(r["stem"], r["path"].endswith("0001.png")) for r in paired] == [("0001", True)]


def test_streaming_equals_batch(spark, tmp_path):
    from docsift.streaming import ingest

    rows = spark.createDataFrame([(i, f"Tea  {i} x  1{i},000\nTOTAL  9O,OOO") for i in range(20)], "doc_id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    ingest.write_receipts(ingest.receipt_stream(spark, str(tmp_path / "in"), files_at_once=1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r["doc_id"], r["receipt"]["total"]["total_price"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(ingest.extracted(rows)) == [(i, "90,000") for i in range(20)]


@pytest.mark.parametrize("values", [[0, 1, 2999, 3000, 3001, 90000, 90000, None], [7, 7, None], [-2.5, 0.1, 0.2, 4.0, 1e6], [None], []])
def test_histogram_holds_every_value(spark, values):
    got = experiments.histogram(spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double"), "v").collect()
    known = [v for v in values if v is not None]
    want = np.histogram(known, 30) if known else (np.zeros(30, int), None)
    assert {r["bin"]: r["n"] for r in got} == {i: n for i, n in enumerate(want[0].tolist()) if n}
    if known:
        density = np.histogram(known, 30, density=True)[0]
        assert {r["bin"]: r["density"] for r in got} == {i: pytest.approx(d) for i, d in enumerate(density.tolist()) if d}


def test_ranks_and_medians_by_ranges(spark):
    import random
    import statistics

    dice = random.Random(7)
    rows = [(dice.choice(["a", "a", "b", None]), i, dice.choice([None, dice.random(), 0.5, 2.0])) for i in range(400)] + [("nulls", 400, None), ("nulls", 401, None), ("one", 402, 3.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    groups = {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((i, v))
    want = {g: (len(own), statistics.median(vs) if (vs := [v for _, v in own if v is not None]) else None) for g, own in groups.items()}
    # a column that is named as an inner one
    got = experiments.summarise(df.withColumn("total", F.col("v")), ["g"], ["v", "total"]).collect()
    assert {r["g"]: (r["n"], r["v_median"]) for r in got} == want == {r["g"]: (r["n"], r["total_median"]) for r in got}
    assert {r["g"]: (r["n"], r["median"]) for r in experiments.statistics(df, "v", ["g"]).collect()} == {g: (sum(v is not None for _, v in own), want[g][1]) for g, own in groups.items()}
    split = {r["i"]: r["split"] for r in quality.stratified_split(df.withColumn("rank", F.lit("x")), "g", ["i"]).collect()}
    for own in groups.values():
        n = len(own)
        a, b = int(n * 0.7), int(n * 0.15)
        assert [split[i] for i, _ in sorted(own)] == ["train"] * a + ["val"] * b + ["test"] * (n - a - b)
    none = df.where("i < 0")
    assert experiments.summarise(none, ["g"], ["v"]).collect() == quality.stratified_split(none, "g", ["i"]).collect() == []
    assert quality.roc_auc(none, F.col("i") == 1, F.col("v")).first()["auc"] is None


def receipt_page(height=300, width=400):
    x = np.full((height, width, 3), 255, np.uint8)
    for row in range(60, height - 60, 24):
        x[row : row + 3, 60 : width - 60] = 0
    return x


@pytest.mark.parametrize("angle", [7, -9, 12])
def test_skew_is_found_and_undone(angle):
    page = images.rotate(receipt_page(), angle)
    assert preprocess.skew_by_lines(page) == pytest.approx(-angle, abs=0.5)
    assert preprocess.skew_by_area(page) == pytest.approx(angle, abs=0.1)  # rows and columns in exchange turn the sign
    straight = preprocess.deskew(page)
    assert abs(preprocess.skew_by_lines(straight)) < 0.5 and straight.shape[0] > 300 and straight[0, 0].tolist() == [255] * 3


def test_skew_guards():
    slightly, blank = images.rotate(receipt_page(), 3), np.full((50, 50), 255, np.uint8)
    assert preprocess.deskew(slightly) is slightly and preprocess.deskew(blank, "minAreaRect") is blank
    assert preprocess.skew_by_lines(blank) == preprocess.skew_by_area(blank) == 0.0
    with pytest.raises(ValueError):
        preprocess.deskew(blank, "other")


def test_documents_are_found():
    paper = np.full((200, 250, 3), 230, np.uint8)
    paper[50:60, 40:200] = 20
    photo = images.warp(paper, np.array([[1, 0.1, -60], [-0.08, 1, -30], [0, 0, 1.0]]), 300, 400, 30)
    found = preprocess.detect_document(photo)
    assert found.shape[0] == pytest.approx(200, abs=8) and found.shape[1] == pytest.approx(250, abs=8) and found.mean() > 200
    noise = np.random.default_rng(0).integers(0, 255, (100, 100, 3), dtype=np.uint8)
    for nothing in (noise, np.full((40, 60, 3), 9, np.uint8), photo[:60, :60]):
        assert preprocess.detect_document(nothing) is nothing
    # a disc isn't a quadrilateral
    y, x = np.mgrid[:200, :200]
    disc = np.where((y - 100) ** 2 + (x - 100) ** 2 < 6000, 240, 20).astype(np.uint8)
    assert preprocess.detect_document(disc) is disc


def test_regions_against_brute_force():
    for seed in range(20):
        mask = np.random.default_rng(seed).random((12, 15)) < 0.45
        for diagonal in (True, False):
            got, n = preprocess.labelled(mask, diagonal)
            seen, want = np.zeros(mask.shape, int), 0
            for start in zip(*np.nonzero(mask), strict=True):
                if not seen[start]:
                    want += 1
                    seen[start], open_ = want, [start]
                    while open_:
                        y, x = open_.pop()
                        for dy in (-1, 0, 1):
                            for dx in (-1, 0, 1):
                                p = y + dy, x + dx
                                if (diagonal or not dy or not dx) and 0 <= p[0] < 12 and 0 <= p[1] < 15 and mask[p] and not seen[p]:
                                    seen[p] = want
                                    open_.append(p)
            assert n == want and len(set(zip(got[mask].tolist(), seen[mask].tolist(), strict=True))) == n and not got[~mask].any()


def test_outline_and_corners_of_a_box():
    mask = np.zeros((30, 40), bool)
    mask[5:20, 8:33] = True
    line = preprocess.outline(mask)
    assert len(line) == 2 * (14 + 24) and preprocess.area(line) == 14 * 24 and preprocess.perimeter(line) == 2 * (14 + 24)
    assert preprocess.ordered(preprocess.simplified(line, 1.5)).tolist() == [[8, 5], [32, 5], [32, 19], [8, 19]]


def test_enhancement():
    x = np.random.default_rng(0).integers(0, 255, (100, 100, 3), dtype=np.uint8)
    dull = (images.to_gray(x) // 8 + 100).astype(np.uint8)
    assert preprocess.clahe(dull).std() > 1.5 * dull.std() and preprocess.clahe(dull).shape == dull.shape and preprocess.clahe(dull[:5, :3]).shape == (5, 3)
    assert preprocess.clahe(np.full((50, 70), 9, np.uint8)).std() == 0
    step = np.repeat([[0, 255]], 20, 1).repeat(20, 0).astype(np.uint8)
    noisy = np.clip(step + np.random.default_rng(1).normal(0, 10, step.shape), 0, 255).astype(np.uint8)
    smooth = preprocess.bilateral_filter(noisy)
    assert smooth[:, :20].std() < noisy[:, :20].std() and smooth[:, 19].mean() < 40 and smooth[:, 20].mean() > 215  # the edge stays
    assert preprocess.enhance(x).shape == (100, 100) and preprocess.enhance(x, gray=False, contrast=False, threshold=False).ndim == 3
    assert set(np.unique(preprocess.enhance(x))) <= {0, 255} and preprocess.preprocess(x).shape == (100, 100)


def test_jpeg_loses_less_at_higher_quality():
    x = images.resize(np.random.default_rng(0).integers(0, 255, (10, 10, 3), dtype=np.uint8), 37, 41)
    off = [np.abs(images.jpeg(x, q).astype(int) - x).mean() for q in (10, 30, 75, 100)]
    assert off == sorted(off, reverse=True) and np.abs(images.jpeg(x[..., 0], 100).astype(int) - x[..., 0]).mean() < 1 and (images.jpeg(np.full((9, 9), 128, np.uint8), 10) == 128).all()


def test_model_input():
    x = np.full((30, 50, 3), (0, 0, 255), np.uint8)  # red
    out = preprocess.model_input(x)
    assert out.shape == (3, 224, 224) and out.dtype == np.float32 and out[:, 5, 5].tolist() == pytest.approx([(1 - 0.485) / 0.229, -0.456 / 0.224, -0.406 / 0.225])
    assert (preprocess.model_input(x, seed=1) == preprocess.model_input(x, seed=1)).all() and preprocess.model_input(x, 32, seed=2).shape == (3, 32, 32)


def test_extraction_from_images(spark, tmp_path):
    class Reader:
        def recognise(self, image):
            kind, size, _, _ = image.split(b"\n", 3)
            if size == b"9 9":
                raise RuntimeError("too small")
            return [("TOTAL", 0.9, (0, 20, 9, 30)), ("9O,OOO", 0.9, (50, 21, 80, 30)), (f"Tea{kind.decode()}  1 x", 0.8, (0, 0, 9, 9)), ("1,000", 0.8, (50, 1, 80, 9))]

    def row(i, x):
        return i, x.shape[0], x.shape[1], x.shape[2] if x.ndim == 3 else 1, bytearray(x.tobytes())

    page = receipt_page(60, 80)
    table = spark.createDataFrame([row(1, page), row(2, page), row(3, page[:9, :9]), (4, 5, 5, 1, bytearray(b"x")), (5, 5, 5, 1, None)], "doc_id long, height int, width int, channels int, data binary")
    assessed = spark.createDataFrame([(1, "not_ready", 0.5), (2, "not_ready", 0.6), (3, "ready", 0.9)], "doc_id long, label string, score double")
    got = {r["doc_id"]: r for r in extraction.extract(table, str(tmp_path / "a"), Reader, assessed=assessed).collect()}
    assert len(got) == 5 and got[1]["ocr_text"].endswith("TOTAL 90,000") and got[1]["receipt"] is not None and got[1]["error"] is None
    assert got[2]["rejected"] and got[2]["receipt"] is None and got[2]["ocr_text"] == "" and not got[1]["rejected"]
    assert got[3]["error"] == "too small" and got[3]["receipt"] is None and got[4]["error"] and got[5]["error"]

    def ask(prompt):
        return '{"menu": {"nm": "Tea"}, "total": {"total_price": "90,000",}}' if "P6" in prompt else "no"

    got = {r["doc_id"]: r for r in extraction.extract(table, str(tmp_path / "b"), Reader, steps=None, parser="llm", ask=ask).collect()}
    assert got[1]["receipt"]["total"]["total_price"] == "90,000" and [m["nm"] for m in got[1]["receipt"]["menu"]] == ["Tea"] and got[2]["receipt"] is not None
    refused = extraction.extract(table.where("doc_id < 2"), str(tmp_path / "c"), Reader, parser="llm", ask=lambda p: "no").first()
    assert refused["receipt"] is None and refused["error"]
    # seconds by stage, for rejected and failed rows as well, and sums of the run
    from pyspark.sql import Observation

    seen = Observation("run")
    timed = {r["doc_id"]: r["seconds"] for r in extraction.extract(table, str(tmp_path / "d"), Reader, assessed=assessed, observation=seen).collect()}
    assert timed[1]["prepare"] > 0 and timed[1]["recognise"] > 0 and timed[1]["ask"] is None and timed[1]["total"] == pytest.approx(timed[1]["prepare"] + timed[1]["recognise"])
    assert timed[2]["prepare"] is None and timed[2]["total"] == 0.0 and timed[4]["prepare"] is not None and timed[4]["recognise"] is None
    assert (seen.get["images"], seen.get["rejected"], seen.get["failed"], seen.get["parsed"]) == (5, 1, 3, 1)
    assert seen.get["total_seconds"] == pytest.approx(sum(t["total"] for t in timed.values()))
    with pytest.raises(ValueError, match="unknown parser"):
        extraction.extract(table, str(tmp_path / "e"), Reader, parser="rules")


@pytest.mark.parametrize("calls", [None, 4])
def test_refused_prompts_are_asked_again(spark, tmp_path, calls):
    """No prompt is lost, none is asked more often than allowed, and a task that is refused stops asking."""
    log = tmp_path / "log"

    def ask(prompt):
        with open(log, "a") as f:
            f.write(f"{prompt}\n")
        with open(log) as f:
            own = f.read().split("\n").count(prompt)
        if prompt == "p3":
            raise RuntimeError("broken")
        if prompt == "p5" or (prompt in ("p1", "p8") and own == 1):
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return f"answer to {prompt}"

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "doc_id long, prompt string").repartition(2)
    got = {r["doc_id"]: r for r in seams.answered_in_passes(prompts, ask, str(tmp_path / "queue"), attempts=2, wait=0, calls=calls).collect()}
    assert sorted(got) == list(range(10))
    asked = log.read_text().split()
    assert {i: asked.count(f"p{i}") for i in range(10)} == {i: 2 if i in (1, 5, 8) else 1 for i in range(10)} == {i: r["attempts"] for i, r in got.items()}
    assert got[3]["error"] == "broken" and "429" in got[5]["error"] and all(r["answer"] == f"answer to p{i}" for i, r in got.items() if i not in (3, 5))
    none = seams.answered_in_passes(prompts.limit(0), ask, str(tmp_path / "none"))
    assert none.columns == ["doc_id", "answer", "error", "attempts", "seconds"] and none.collect() == []


def test_images_without_content_or_text_have_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a b")), (2, None), (3, bytearray(b""))], "doc_id long, image binary")
    got = {(r["doc_id"], r["seq"]): r for r in seams.recognise(rows, seams.StubEngine, keep_errors=True).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, None), (3, None)} and got[2, None]["error"] == "no image" and got[3, None]["error"] is None
