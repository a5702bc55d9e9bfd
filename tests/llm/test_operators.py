"""The text operators against brute force on small tables with nulls, empty and very long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

R = random.Random(5)
SYLLABLES = "the an re on st er in ha tion ble éau wh ou ly ed".split()


def word():
    return "".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 3)))


def prose(n):
    return " ".join(word() + R.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


PASSAGE, LINE = prose(120), prose(20)


def corpus():
    base = prose(150)
    texts = [
        None, "", " \n\t ", "x", "two words", base, base, base.replace("the", "THE", 1), PASSAGE, f"{prose(30)} {PASSAGE} {prose(9)}", f"{PASSAGE} {prose(60)} {PASSAGE}", LINE, f"{LINE} {LINE}",
        "a" * 5000, "ab " * 3000, prose(4000), "don't it's I'LL 've 12345 <|endoftext|> x <|startoftext|>", "é à ü　\x1c\x85wide" * 30, f"{prose(49)}", f"{prose(10)} {base[:250]}",
    ]
    near = base.split(" ")
    for i in (3, 70, 140):
        texts.append(" ".join([*near[:i], "changed", *near[i + 1 :]]))
    rows = [(i * 3, t, "src", f"extra{i}") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, "n"), (6, PASSAGE + " again", "src", "same id")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def key(r):
    return tuple((x is None, x) for x in r)


# --- token counts ---------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    from docsift.llm.token_counts import count_tokens

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted((tuple(r) for r in count_tokens(docs, path("byte_bpe_50k.json")).collect()), key=key)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 512) for i, t, *_ in rows), key=key)
    assert count_tokens(empty(spark), path("byte_bpe_50k.json")).count() == 0


def test_chunk_maps_compose_to_the_whole():
    from tokenizers import Tokenizer

    from docsift.llm.token_counts import counter

    library, own = Tokenizer.from_file(path("byte_bpe_50k.json")), counter(path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["'", "s", "'re", "'ll", " ", "  ", "\n", "a", "The", "12", "!", "''", "é", "中文", "　", "<|endoftext|>", "\x1c", "aaaa", "\r\n"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert [own.count(t), own.count(t, 1), own.count(t, 3), own.count(t, 7)] == [want] * 4, repr(t)


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    from docsift.llm.packing import pack_documents

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    got = pack_documents(docs, path("word_bpe_49k.json"), capacity=256).collect()
    want = sorted((i if i is not None else -1, ids[a : a + 256], a) for i, t, *_ in rows for ids in [[*library.encode(t or "", add_special_tokens=False).ids, 1]] for a in range(0, len(ids), 256))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["length"], r["ids_crc32"], r["start"]) for r in got) == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), a) for i, x, a in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["start"] == r["piece"] * 256
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-sum(len(x) for _, x, _ in want) // 256) * 1.1 + 1
    assert pack_documents(empty(spark), path("word_bpe_49k.json")).count() == 0


def test_plan_holds_the_histogram_and_packs_tightly():
    from docsift.llm.packing import plan

    r = random.Random(2)
    for lengths in ([r.randint(1, 4096) for _ in range(3000)], [min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(20000)], [4096] * 10, [1] * 5000, [2049] * 7, []):
        histogram = {n: lengths.count(n) for n in set(lengths)}
        patterns, held, used = plan(histogram), {}, 0
        for pattern, times in patterns:
            assert sum(n * k for n, k in pattern) <= 4096
            used += times
            for n, k in pattern:
                held[n] = held.get(n, 0) + k * times
        assert held == histogram
        if len(lengths) >= 3000:
            assert used <= max(sum(n > 2048 for n in lengths), sum(lengths) / 4096) * 1.03 + 2


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_contamination(text, items, width=10):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    patterns = {}
    for i, t in items:
        w = words_of(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(i)
    w = words_of(text)
    hit, found = set(), set()
    for n in {len(p) for p in patterns}:
        for k in range(len(w) - n + 1):
            if (p := tuple(w[k : k + n])) in patterns:
                hit |= set(range(k, k + n))
                found |= patterns[p]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, rows, pass_bytes):
    from docsift.llm.decontamination import find_contamination

    items = [(1, PASSAGE[:300].upper()), (2, "two"), (10, LINE), (3, None), (4, "?!"), (5, PASSAGE[100:400]), (None, "x")]
    got = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), pass_bytes=pass_bytes).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute_contamination(t, [x for x in items if x[0] is not None])) for i, t, *_ in rows), key=key)
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).where("contaminated").count() == 0


# --- repeated text --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot,few", [(4 << 20, 1000), (0, 0)])
def test_suffix_array_dedup(spark, docs, rows, hot, few, monkeypatch):
    """With hot = 0 every anchor is compared window by window, with few = 0 frequent keys are broadcast, as in large tables."""
    from docsift.llm import recurring
    from docsift.llm.suffix_dedup import without_repeats

    monkeypatch.setattr(recurring, "HOT_BYTES", hot)
    monkeypatch.setattr(recurring, "FEW", few)

    counts = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            counts[b[i : i + 200]] = counts.get(b[i : i + 200], 0) + 1
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        want.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in without_repeats(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert without_repeats(empty(spark)).count() == 0


def test_levels_merge_and_find_all_repeats():
    from docsift.llm.suffix_dedup import Index

    r = random.Random(4)
    index, texts = Index(20), []
    for _ in range(12):
        t = bytes(r.choice(b"ab") for _ in range(120)) + (texts[-1][:30] if texts and r.random() < 0.5 else b"")
        texts.append(t)
        index.add(t, np.arange(len(t) - 19), np.ones(len(t) - 19, int))
    assert len(index.levels) < 6
    windows = [t[i : i + 20] if i <= len(t) - 20 else None for t in texts for i in range(len(t))]
    assert index.recurring().tolist() == [w is not None and windows.count(w) > 1 for w in windows]


def brute_phrases(rows):
    largest = 1 << 63
    split = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t, *_ in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, largest), largest if d is None else d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (largest if d is None else d):
                gone[i : i + 50] = [True] * 50
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=key)


@pytest.mark.parametrize("hot", [4 << 20, 0])
def test_phrase_dedup(spark, docs, rows, hot, monkeypatch):
    """With hot = 0 every anchor is compared window by window, as frequent ones are."""
    from docsift.llm import phrase_dedup, recurring

    monkeypatch.setattr(recurring, "HOT_BYTES", hot)
    monkeypatch.setattr(recurring, "FEW", hot)
    assert sorted((tuple(r) for r in phrase_dedup.without_repeats(docs).collect()), key=key) == brute_phrases(rows)
    assert phrase_dedup.without_repeats(empty(spark)).count() == 0


# --- near duplicates ------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x]
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 63), 1 << 63 if d is None else d)
    return sorted(((d, len(sets[i]), None if (c := least[top(i)] if sets[i] else d) == 1 << 63 else c, links[i]) for i, (d, *_) in enumerate(rows)), key=key)


@pytest.mark.parametrize("chunk", [8000, 2])
def test_jaccard_join(spark, docs, rows, chunk):
    from docsift.llm.jaccard_join import join

    got = [tuple(r)[:4] for r in join(docs, chunk=chunk).collect()]
    assert sorted(got, key=key) == brute_components(rows)
    assert join(empty(spark)).count() == 0


def test_linked_sets_share_a_key_at_every_size():
    from docsift.llm.jaccard_join import Scheme

    r = np.random.default_rng(0)
    scheme = Scheme()
    for n in [*range(2, 60), 75, 100, 137, 200, 400]:
        for m in sorted({scheme.largest(n), n, n + 1} & set(range(n, scheme.largest(n) + 1))):
            for _ in range(4):
                common = scheme.common(n, m)
                if common > n:
                    continue
                pool = np.unique(r.integers(0, 1 << 63, n + m, dtype=np.uint64))
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([r.permutation(pool[:n])[:common], pool[n : n + m - common]]))
                if not np.array_equal(a, b):
                    assert len(np.intersect1d(scheme.keys(a), scheme.keys(b))), (n, m)


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    from docsift.llm.toxicity import score_toxicity

    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(20, 80))]
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["blargwit", "zonkhead", "mupplesnot"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5001, None)], "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = score_toxicity(docs, marked).collect()
    assert len(got) == len(rows) + 3 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    truth = dict(labels)
    held = [x for x in got if x["doc_id"] in truth and x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert not any(x["predicted"] for x in got if x["doc_id"] in (5000, 5001, None))
    nobody = score_toxicity(docs, marked.where("toxic = 0")).collect()
    assert all(x["score"] == 0 for x in nobody)


def test_toxicity_features_against_brute_force():
    import zstandard as z

    from docsift.llm.toxicity import THRESHOLDS, TOP, Model, telling_windows

    telling, toxic, ordinary = [" blarg", "onkhe"], b" you blargwit and zonkhead go " * 3, prose(200).encode()
    texts = [None, "", " ,. ", "x", "one BLARGWIT, two zonkhead-three four", "no telling word here", "blargwit", f"{prose(40)} zonkhead {prose(3)} blargx, {prose(40)} zonkhead", "unblarg zonkhe é blargé ü", "blargwit " * 50]
    parameters = z.ZstdCompressionParameters.from_level(3, min_match=4, write_checksum=0, write_content_size=0, write_dict_id=0)
    size = lambda text, content: len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress(text))
    raw = [None if t is None else t.encode() for t in texts]
    got, found = Model(telling, toxic, ordinary).features(raw), telling_windows(raw, telling)
    for text, b, row, own in zip(texts, raw, got, found, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        windows = [f" {' '.join(words[max(0, i - 1) : i + 2])} ".encode() for i, w in enumerate(words) if any(s in f" {w} " for s in telling)]
        assert own == windows
        d = sorted((size(w, ordinary) - size(w, toxic + ordinary) for w in set(windows)), reverse=True)
        top = [min(max(x, 0), 10) for x in [*d, *[0] * TOP][:TOP]] if len(d) < TOP else [min(max(x, 0), 10) for x in d[:TOP]]
        assert row.tolist() == pytest.approx([*top, *(np.log1p(sum(x >= t for x in d)) for t in THRESHOLDS), np.log1p(len(b or b"")) / 10, 1.0])


# --- pages ----------------------------------------------------------------------------------------------------------


def test_html_extraction(spark):
    from docsift.llm.html_extraction import extract

    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Big &amp; small</h1><p><b>One\n two<br><p>Three</p></article><script>x='</p>'</script><footer>&copy; me</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p>just <i>this</i>")], "page_id long, url string, html string")
    got = sorted((tuple(r) for r in extract(rows).collect()), key=key)
    text = "Big & small\n\nOne two\n\nThree"
    assert got == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (4, "u", "just this", 9)], key=key)


def test_decoding_is_consistent_and_accurate():
    from docsift.llm import html_extraction as h

    r, right, n = random.Random(77), 0, 0
    for _ in range(60):
        order, marks = h.labelled(h.training_page(r))
        h.decode(order, h.trained().odds(h.features(order)))
        assert all(x.parent is None or x.parent.keep or not x.keep for x in order)
        right += sum(float(x.keep) == y for x, y in zip(order, marks, strict=True))
        n += len(order)
    assert right / n > 0.98


# --- urls and search ------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    from docsift.llm.url_filter import judge_urls

    urls = [None, "", "no-scheme", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://x.net", "https://net/de/8", "http://a.example.net/de/8/1", "http://a.example.net/de/9", "x://b.org/es/", "http://notexample.com/en/7", "http://h.com?en/"]
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 4: ("example.com", "/en/8", "com/en/", "block"),
        5: ("x.net", "", None, "allow"), 6: ("net", "/de/8", "net/de/", "block"), 7: ("a.example.net", "/de/8/1", "example.net/de/8", "allow"), 8: ("a.example.net", "/de/9", "net/de/", "block"),
        9: ("b.org", "/es/", "org/es/", "block"), 10: ("notexample.com", "/en/7", "com/en/", "block"), 11: ("h.com", "", None, "allow"),
    }


def test_templates_are_rejected_by_labelled_purity(spark):
    from docsift.llm.url_filter import judge_urls

    rules = [("block", "h.test", "/shop/1"), ("allow", "h.test", "/news/1")]
    urls = [f"http://h.test/{s}/{n}" for s in ("shop", "news") for n in range(100, 300)]
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).where("rule is null")
    assert {(r["v"], r["s"]) for r in got.selectExpr("verdict as v", "split(path, '/')[1] as s").collect()} == {("block", "shop"), ("allow", "news")}


def test_templates_differ_below_the_third_segment(spark):
    """Nulls, repeated rows, extra columns of clashing names, no rows."""
    from docsift.llm.url_filter import judge_urls

    rules = [("block", "h.test", "/a/b/c/d/shop/1"), ("allow", "h.test", "/a/b/c/d/news/1")]
    rows = [(i, f"http://h.test/a/b/c/d/{s}/{n}", "x") for i, (s, n) in enumerate((s, n) for s in ("shop", "news") for n in range(100, 300))]
    pages = spark.createDataFrame([*rows, rows[150], (None, None, None)], "page_id long, url string, template string")
    got = judge_urls(pages, rules)
    assert {(r["v"], r["s"]) for r in got.where("rule is null").selectExpr("verdict as v", "get(split(path, '/'), 5) as s").collect()} == {("block", "shop"), ("allow", "news"), ("allow", None)}
    assert got.count() == 402 and got.where("page_id = 150").count() == 2 and judge_urls(pages.limit(0)).count() == 0


def test_a_rule_parts_blocks(spark):
    from docsift.llm.html_extraction import Tree, blocks, parse

    assert blocks(parse("<article>Bare text before<hr>Bare text after</article>", Tree())[0]) == ["Bare text before", "Bare text after"]


def test_exact_topk(spark):
    from docsift.llm.topk_search import top_k

    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=64).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(20)] + [(300, None), (None, vectors[1][1]), (301, [None, *vectors[2][1][1:]])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    codes = {i: [x is not None and x > 0 for x in v] for i, v in vectors if i is not None and v is not None}
    want = {}
    for q in (0, 100, 200):
        near = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items())[:10]
        want |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["distance"]) for x in top_k(table, table.where("vec_id in (0, 100, 200)")).collect()}
    assert got == want
    assert top_k(table.limit(0), table.limit(0)).count() == 0
    few = top_k(table.where("vec_id < 3"), table.where("vec_id < 1"), k=10).collect()
    assert len(few) == 3


# --- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as p

    near = p.drop_near_duplicates(spark, docs, "").collect()
    assert len(near) == len({(r["doc_id"], r["text"]) for r in near})
    groups = {}
    for (d, t, *_), (_, n, c, _) in zip(sorted(rows, key=lambda x: key((x[0], len(shingle_set(x[1]))))), sorted(brute_components(rows), key=lambda x: key(x[:2])), strict=True):
        if n:
            groups.setdefault(c, []).append((d, t))
    kept = {}
    for r in near:
        kept[r["doc_id"]] = kept.get(r["doc_id"], 0) + 1
    assert all(kept.get(c, 0) >= 1 for c in groups)
    assert sum(1 for r in near if shingle_set(r["text"])) == len(groups)
    assert sum(1 for r in near if not shingle_set(r["text"])) == sum(1 for _, t, *_ in rows if not shingle_set(t))

    cut = p.drop_repeated_text(spark, docs, "")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert sorted(r["kept"] for r in cut.collect()) == sorted(x[3] for x in rows)  # an extra column of a clashing name is carried


def brute_groups(texts, size, percent):
    """For each text the number of its group, None without shingles."""
    split = [[x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x] for t in texts]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)] if w else []) for w in split]
    group = [i if s else None for i, s in enumerate(sets)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def near_copies(r):
    """Families of texts with 0 to 12 % of the words replaced."""
    out = []
    for n in (3, 6, 12, 25, 40, 100, 150, 300):
        for _ in range(4):
            base = [f"w{r.randrange(10**9)}" for _ in range(n)]
            for share in (0, 0.01, 0.02, 0.03, 0.05, 0.12):
                own = list(base)
                for i in r.sample(range(n), round(n * share)):
                    own[i] = f"v{r.randrange(10**9)}"
                out.append(" ".join(own))
    return out


def test_near_duplicate_stage_links_at_five_words_and_80(spark):
    import corpus_pipeline as p

    texts = near_copies(random.Random(21))
    near = p.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "")
    group = brute_groups(texts, 5, 80)
    want = sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())
    assert len(want) < len(set(brute_groups(texts, 3, 90)))
    assert sorted(r["doc_id"] for r in near.collect()) == want


@pytest.mark.parametrize("chunk", [8000, 2])
def test_jaccard_join_at_five_words_and_80(spark, chunk):
    from docsift.llm.jaccard_join import join

    texts = near_copies(random.Random(22))
    group = brute_groups(texts, 5, 80)
    least = {g: i for i, g in reversed(list(enumerate(group)))}
    got = join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), percent=80, size=5, chunk=chunk)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(i, least[g]) for i, g in enumerate(group)]


def test_linked_sets_share_a_key_at_80():
    from docsift.llm.jaccard_join import Scheme

    r = np.random.default_rng(1)
    scheme = Scheme(80)
    for n in [*range(2, 60), 75, 100, 137, 200, 400]:
        for m in sorted({scheme.largest(n), (n + scheme.largest(n)) // 2, n, n + 1} & set(range(n, scheme.largest(n) + 1))):
            for _ in range(8):
                common = scheme.common(n, m)
                if common > n:
                    continue
                pool = np.unique(r.integers(0, 1 << 63, n + m, dtype=np.uint64))
                r.shuffle(pool)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([r.permutation(pool[:n])[:common], pool[n : n + m - common]]))
                if not np.array_equal(a, b):
                    assert len(np.intersect1d(scheme.keys(a), scheme.keys(b))), (n, m)


@pytest.mark.parametrize("chunk", [8000, 2])
def test_near_duplicate_stage_keeps_a_row_of_each_group(spark, chunk, monkeypatch):
    """Null and shared ids with linked and unlinked texts, repeated rows with and without words."""
    import corpus_pipeline as p
    from docsift.llm import jaccard_join

    join = jaccard_join.join
    monkeypatch.setattr(jaccard_join, "join", lambda *a, **k: join(*a, chunk=chunk, **k))
    r = random.Random(31)
    text = lambda: " ".join(f"w{r.randrange(10**9)}" for _ in range(120))
    near = lambda t: " ".join(t.split(" ")[:-1] + ["changed"])
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(None, t) for t in (a, near(a), b, c, c, "two words", "", "", None, None, " \n")]
    rows += [(7, t) for t in (d, e, near(e), near(c), f, f, "", "", None)] + [(9, near(d)), (8, g), (1, near(g)), (2, "x"), (2, "y"), (2, "x")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, version long").repartition(3)
    out = p.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(x) for x in out.collect()]
    group = brute_groups([t for _, t in rows], 5, 80)
    assert sorted(n for _, _, n in got if group[n] is None) == [n for n, x in enumerate(group) if x is None]
    kept = [n for _, _, n in got if group[n] is not None]
    assert sorted(group[n] for n in kept) == sorted({x for x in group if x is not None})
    least = lambda n: min((i is None, i or 0) for (i, _), x in zip(rows, group, strict=True) if x == group[n])
    assert all((rows[n][0] is None, rows[n][0] or 0) == least(n) for n in kept)
    assert all((i, t) == rows[n] for i, t, n in got)


def test_features_of_long_lists_count_every_sibling():
    from docsift.llm import html_extraction as h

    parent = h.Node("div", "", None)
    parent.text, parent.links, parent.words, parent.blocks = 7140, 3540, 120, 1
    order = [parent]
    for i in range(120):
        child = h.Node("p" if i < 60 else "li", "", parent)
        child.text, child.links, child.words, child.blocks = i, i // 2, 1, 1
        parent.children.append(child)
        order.append(child)
    out = h.features(order)[:, 3 * len(h.TOKENS) :]
    texts, links = sum(range(120)), sum(i // 2 for i in range(120))
    assert out[1:, 14].tolist() == pytest.approx([i / 120 for i in range(120)])
    assert set(out[1:, 10].tolist()) == {np.float32(texts / 120)} and set(out[1:, 11].tolist()) == {np.float32(links / texts)}
    assert set(out[1:, 12].tolist()) == {0.5} and out[0, 15:17].tolist() == [60, 60]


def test_live_results_survive_later_runs(spark):
    """Results that are made first and read last, among them two pipelines."""
    import corpus_pipeline as p
    from docsift.llm.queries import QUERIES

    made = {name: QUERIES[name](spark, "/root/testdata/sf0.001") for name in ("op1_exact_topk", "op2_suffix_array_dedup", "op4_best_fit_packing", "op6_ngram_jaccard_join", "op7_phrase_dedup", "op10_url_filter")}
    first, second = (p.run(spark, "/root/testdata/sf0.001") for _ in range(2))
    pieces = [sorted(map(tuple, x.select("doc_id", "piece", "length", "ids_crc32").collect())) for x in (first, second)]
    assert pieces[0] == pieces[1]
    assert all(x.count() > 0 for x in made.values())


def test_a_run_deletes_its_own_tables_alone(spark, tmp_path):
    from pathlib import Path

    from docsift.llm.common import settled, written

    there = lambda x: Path(x.written_to.removeprefix("file:")).exists()
    inner = []

    def make(fails=False):
        inner.append(written(spark.range(3), "inner"))
        nested = settled(lambda: written(spark.range(5), "deeper").where("id > 1"), "nested")
        inner.append(nested)
        if fails:
            raise ValueError("fails")
        return inner[0].join(nested, "id")

    other = written(spark.range(2), "other")
    out = settled(make, "out")
    with pytest.raises(ValueError, match="fails"):
        settled(lambda: make(True), "out")
    assert out.count() == 1 and other.count() == 2
    assert len(inner) == 4 and not any(map(there, inner)) and there(out) and there(other)
