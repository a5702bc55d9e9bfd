"""Boxes gathered by document: against a plain reckoning, on odd boxes and turns, and what the plans shuffle."""

import random
from itertools import groupby

import duckdb
import pytest

from docsift.operators import layout
from docsift.plans import catalog

BOXES = "doc_id long, seq int, text string, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>"
GATHERED = ["q06_line_merge", "q07_reading_order", "q42_recognised_text"]


def merged(rows):
    """(doc_id, line_no): (text, confidence, bbox)."""
    out = {}
    for doc, own in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        lines, last = [], None
        for r in sorted(own, key=lambda r: ((r[4] and r[4][1]) or 0, (r[4] and r[4][0]) or 0, r[1])):
            y = r[4] and r[4][1]
            if y is None or last is None or abs(y - last) > 10:
                lines.append([])
            lines[-1].append(r)
            last = y
        for k, line in enumerate(lines, 1):
            words = [r[2] for r in sorted(line, key=lambda r: (r[4] and r[4][0]) or 0) if r[2] is not None]
            known, places = [r[3] for r in line if r[3] is not None], [r[4] for r in line if r[4]]
            side = lambda i, f: f((p[i] for p in places if p[i] is not None), default=None)
            box = (side(0, min), side(1, min), side(2, max), side(3, max)) if places else None
            out[doc, k] = (" ".join(words), pytest.approx(sum(known) / len(known)) if known else None, box if box and box[0] is not None else None)
    return out


def test_lines_of_odd_boxes(spark):
    own, rows = random.Random(5), []
    for doc in range(60):
        for seq in range(own.choice([1, 2, 30])):
            x, y = own.randrange(-20, 200), own.randrange(-30, 90)
            box = own.choice([None, (x, None, x + 5, y), (None, y, x, y + 5), (x, y, None, y + 5)]) if own.random() < 0.2 else (x, y, x + 9, y + 9)
            rows.append((doc, seq, own.choice([None, "", " ", "a  b"]) if own.random() < 0.2 else f"w{seq}", None if own.random() < 0.2 else own.random(), box))
    own.shuffle(rows)
    got = layout.merge_lines(spark.createDataFrame(rows, BOXES).repartition(5)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["text"], r["confidence"], r["bbox"] and tuple(r["bbox"])) for r in got} == merged(rows) and len(got) == len(merged(rows))


@pytest.mark.parametrize("name", GATHERED)
def test_odd_turns(spark, tmp_path, name):
    """Turns without words or text, an id that two turns share, and one without an id."""
    path = str(tmp_path / "conversations.parquet")
    turns = [(0, 0, "1O \n\n word"), (0, 1, None), (0, 2, ""), (0, 3, " \n "), (0, 4, "l5 x é" + "".join(f" w{i}" for i in range(3000))), (0, 1000, None), (1, 0, "shared"), (None, 1, "nowhere 5O")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = duck.sql(catalog.ORACLE_SQL[name])
    rows = catalog.QUERIES[name](spark, str(tmp_path))
    key = lambda rows, names: sorted(repr([round(r[c], 5) if isinstance(r[c], float) else r[c] for c in names]) for r in rows)
    assert key(rows.collect(), sorted(rows.columns)) == key([dict(zip(want.columns, r)) for r in want.fetchall()], sorted(want.columns))


@pytest.mark.parametrize("name", GATHERED)
def test_turns_meet_as_texts(spark, name):
    """No task sorts words: they are made of texts after the only shuffle."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan
    assert plan.count("Exchange") == plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange")
