"""Every registered query of the library gives the rows of its SQL."""

import duckdb
import pytest

from docsift.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    rows = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    names = sorted(rows.columns)
    assert names == sorted(want.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in rows.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_point_works_without_the_text_operators():
    import subprocess
    import sys

    code = (
        "import sys\nfor m in ('corpus_pipeline', 'docsift.llm'): sys.modules[m] = None\n"
        "import __spark_entry__ as e\nassert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and len(e.queries()) > 40"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_turns_are_compared_whole(spark, tmp_path):
    long = "same start " * 15
    turns = [[long + "one end", long + "another", None, "é" * 200, "ü" * 200, ""], [long * 4, long * 3 + "x" * 150], ["", ""], ["a" * 130, "a" * 120]]
    rows = [(c, i, t) for c, ts in enumerate(turns) for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for c, ts in enumerate(turns):
        for i, t in enumerate(ts):
            a, b = t or "", (ts[i - 1] or "") if i else ""
            s = 1 - distance(a, b) / max(len(a), len(b)) if a or b else 1.0
            want[c, i] = pytest.approx((s, s if s >= 0.5 else 0.0), abs=1e-6)
    got = {(r["conv_id"], r["turn"]): (r["nls"], r["anls"]) for r in catalog.q11_nls_anls(spark, str(tmp_path)).collect()}
    assert got == want


def test_histogram_query_counts_every_document(spark, duck):
    want = duck.sql("select count(n_chars), count(*) filter (n_chars > 3000) from documents").fetchall()[0]
    assert want[1] and sum(r["n"] for r in catalog.q33_histogram(spark, SF).collect()) == want[0]
