"""Empty tables, extra columns of clashing names, repeated rows and very long texts where other tests have none; the pipeline's stages against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import corpus, key, lower, path, prose, word


def labelled(n=400, seed=21):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w, toxic = [word() for _ in range(r.randint(15, 50))], int(r.random() < 0.25)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["blargwit", "zonkhead", "mupplesnot"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rows, labels = labelled()
    long = prose(60_000)
    extra = [(1000, long), (1001, long + " blargwit you zonkhead mupplesnot " * 3), rows[5], rows[5], (None, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 9, 0.5, "en") for i, t in [*rows, *extra]], "doc_id long, text string, carried int, score double, held_out string").repartition(4)
    return docs, spark.createDataFrame([(i, x, 1.5) for i, x in labels], "doc_id long, toxic int, text double")


def test_toxicity_of_odd_tables(spark, toxic_tables):
    from docsift.llm.toxicity import score_toxicity

    docs, labels = toxic_tables
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["score"] for r in [*by[5], *by[None]]}) == 1 and len(by[5]) == 3 and by[None][0]["held_out"] in (False, None)
    # a thousand times longer than any labelled text: scored whole, so that what is toxic at its end counts
    assert 0 <= by[1000][0]["score"] < by[1001][0]["score"] <= 1
    assert score_toxicity(docs.limit(0), labels).collect() == []
    assert all(r["score"] == 0 for r in score_toxicity(docs.limit(9), labels.limit(0)).collect())


def test_extraction_of_odd_tables(spark):
    from docsift.llm.html_extraction import extract

    body = "".join(f"<p>{prose(60)}</p>" for _ in range(400))
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Long</h1>{body}</article><footer>me</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page, "x", 3), (1, "u", page, "y", 4), (None, None, "<p>a</p>", None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = extract(rows).collect()
    assert [r.__fields__ for r in got] == [["page_id", "url", "text", "n_chars"]] * 3
    long = [r for r in got if r["page_id"] == 1]
    assert long[0]["text"] == long[1]["text"] and long[0]["text"].count("\n\n") == 400 and long[0]["n_chars"] == len(long[0]["text"])
    assert extract(rows.limit(0)).collect() == []


def test_search_among_extra_columns(spark):
    from docsift.llm.topk_search import top_k

    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=64).tolist(), 7, 8, "x") for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int, rank int, code string")
    got = top_k(table, table.where("vec_id = 0"), k=3).collect()
    assert [x.__fields__ for x in got] == [["query_id", "rank", "vec_id", "distance"]] * 3 and got[0]["distance"] == 0


def test_tokens_of_a_text_beyond_a_chunk(spark):
    """Longer than the default chunk, so its state maps are composed."""
    from tokenizers import Tokenizer

    from docsift.llm.token_counts import CHUNK, count_tokens

    text = (prose(5000) + "  \n don't 12345 ü ") * 40
    text = text * (CHUNK // len(text) + 2)
    assert len(text) > CHUNK
    got = count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), path("byte_bpe_50k.json")).first()
    assert got["n_tokens"] == len(Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids)


# --- the pipeline ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, toxic_tables):
    folder = tmp_path_factory.mktemp("tables")
    docs, labels = toxic_tables
    labels.write.parquet(str(folder / "labels.parquet"))
    items = [(1, "the quick brown fox jumps over the lazy dog again today"), (2, "only three words"), (None, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs.write.parquet(str(folder / "documents.parquet"))
    return str(folder), items


def test_drop_toxic_keeps_what_the_operator_passes(spark, toxic_tables, tables):
    import corpus_pipeline as p
    from docsift.llm.toxicity import score_toxicity

    docs, labels = toxic_tables
    kept = p.drop_toxic(spark, docs, tables[0])
    assert kept.schema == docs.schema or [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    bad = {r["doc_id"] for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
    want = [tuple(r) for r in docs.collect() if r["doc_id"] not in bad]
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(want, key=key)
    assert 0 < len(want) < docs.count()


def test_drop_contaminated_against_brute_force(spark, tables):
    import corpus_pipeline as p

    folder, items = tables
    rows = [*corpus(), (800, f"{prose(20)} The QUICK brown fox, jumps over the lazy dog again {prose(5)}", "s", "k"), (801, "so only three, words here", "s", "k"), (802, "only three", "s", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(3)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for _, t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + len(x)]) == x for w in [words(t)] for x in windows for i in range(len(w)))
    want = [r for r in rows if not hit(r[1])]
    assert len(rows) - len(want) == 2
    assert sorted(map(tuple, p.drop_contaminated(spark, docs, folder).collect()), key=key) == sorted(want, key=key)


def test_run_packs_what_all_stages_keep(spark, tables):
    """The stages one after another, each on what the one before wrote, as the last one's pieces say; and clean documents stay."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables[0]).collect(), docs.schema)
    tokens = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = np.array([*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
    got = p.run(spark, tables[0]).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(own)[0][0] == 0 and sum(n for _, n in own) <= 4096 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) for own in by.values())
    clean = {i for i, t in labelled()[0] if not re.search("blargwit|zonkhead|mupplesnot", t)}
    left = {r["doc_id"] for r in got}
    assert len(clean & left) >= 0.97 * len(clean)


def test_toxicity_looks_at_every_word_of_a_text():
    """Text far from any telling string is compressed, too: its distance is that of its run, whole."""
    from docsift.llm.toxicity import RUN, Model, runs

    text = f"{prose(500)} zonkhead zonkhead blargwit, {prose(501)}".encode()
    assert b" ".join(b" ".join(r.split()) for r in runs(text)) == b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    assert all(len(r.split()) == RUN for r in runs(text)[:-1]) and runs(None) == runs(b" ,") == []
    plain, toxic = Model(["nowhere"], b" you zonkhead zonkhead blargwit go " * 3, b""), Model(["nowhere"], b"", b"")
    got, other = plain.whole([text, None, b""]), toxic.whole([text, None, b""])
    assert got[0][0] == max(map(plain.distance, runs(text))) > 0 == other[0][0]
    assert got[0][1] == sum(map(plain.distance, runs(text))) / len(runs(text))
    assert got[1].tolist() == got[2].tolist() and not got[1][:4].any()
