"""Packing by retrieval: exact round trips through the library, and the index against plain BM25."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import corpus, path

VOCABULARY = "byte_bpe_50k.json"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(VOCABULARY))


def check(rows, pieces, window):
    """Each id lies in one piece, sequences have no gaps, and none needs padding."""
    tokens = library()
    ids = [np.array([*tokens.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]
    want, have = {}, {}
    for (doc, *_), own in zip(rows, ids, strict=True):
        want.setdefault((doc, len(own)), []).append(own)
    for p in pieces:
        have.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    assert want.keys() == have.keys()
    for key, texts in want.items():
        left = sorted(have[key])
        for own in texts:  # rows of one id and length: pieces are matched by what they hold
            at = 0
            while at < len(own):
                hit = next(x for x in left if x[0] == at and x[2] == zlib.crc32(own[at : at + x[1]]))
                left.remove(hit)
                at += hit[1]
            assert at == len(own)
        assert not left
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total == window or total & (total - 1) == 0
    short = [s for s in (sum(n for _, n in own) for own in by.values()) if s < window]
    assert len(short) == len(set(short))  # only what is left in the end
    assert -(-sum(map(len, ids)) // window) <= len(by) <= sum(map(len, ids)) // window + window.bit_length()


@pytest.mark.parametrize(("window", "shard", "partition"), [(2048, 1 << 19, 1 << 22), (64, 300, 2000), (16, 40, 500)])
def test_every_id_lies_in_one_piece(spark, window, shard, partition):
    """Nulls, empty and very long texts, special strings, repeated rows, shared ids, several levels of what is left."""
    from docsift.llm.retrieval_packing import pack_by_retrieval

    rows = corpus() + [(900 + i, "") for i in range(300)] + [(2000, "tail <|endoftext|> and more <|endoftext|>")]
    docs = spark.createDataFrame([(r[0], r[1], 1, b"x") for r in rows], "doc_id long, text string, sequence_id long, ids binary").repartition(4)
    check(rows, pack_by_retrieval(docs, path(VOCABULARY), window, shard, partition).collect(), window)


def test_no_rows_and_one(spark):
    from docsift.llm.retrieval_packing import pack_by_retrieval

    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack_by_retrieval(none, path(VOCABULARY)).collect() == []
    check([(None, None)], pack_by_retrieval(spark.createDataFrame([(None, None)], none.schema), path(VOCABULARY)).collect(), 2048)


def test_ids_are_the_library_s():
    import pyarrow as pa

    from docsift.llm.retrieval_packing import encoder

    texts = [r[1] for r in corpus()] + ["naïve 12x  \n\n end ", "日本 語 𝒳𝒴", "<|endoftext|>", "it's  we'll\t'tis"]
    got = encoder(path(VOCABULARY)).ids(pa.array(["skipped", *texts]).slice(1))
    tokens = library()
    assert [x.tolist() for x in got] == [tokens.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_windows_are_filled_by_bm25():
    """Each window against plain BM25 over the unused items of its shard."""
    from docsift.llm.retrieval_packing import B, DOCS, ITEMS, K1, TOKENS, Shard, Statistics

    r = random.Random(4)
    topics = [r.sample(range(200), 25) for _ in range(6)]
    items = [(i, 0, n, np.array([r.choice(topics[i % 6]) if r.random() < 0.7 else r.randrange(200) for _ in range(n)], "<u2")) for i in range(150) for n in [r.randint(1, 40)]]
    frequency = Counter(t for x in items for t in set(x[3].tolist()))
    tokens = sum(len(x[3]) for x in items)
    shard = Shard(items, Statistics({**frequency, DOCS: 150, ITEMS: 150, TOKENS: tokens}))
    mean = tokens / 150

    def score(query, item):
        times = Counter(item.tolist())
        idf = lambda t: math.log(1 + (150 - frequency[t] + 0.5) / (frequency[t] + 0.5))
        return sum(idf(t) * times[t] * (K1 + 1) / (times[t] + K1 * (1 - B + B * len(item) / mean)) for t in set(query))

    left, seed, n = {i: len(x[3]) for i, x in enumerate(items)}, None, 0
    for taken in shard.windows(64):
        seed = next(i for i in range(150) if left[i]) if seed is None else seed
        query = items[seed][3][len(items[seed][3]) - left[seed] :].tolist()
        assert taken[0][0] == seed and len(taken[0][2]) == left[seed]
        left[seed] = 0
        ranks = sorted((i for i in left if left[i]), key=lambda i: (-round(score(query, items[i][3]), 9), i))
        want, room, seed = [], 64 - len(query), None
        for i in ranks:
            if not room:
                break
            k = min(room, left[i])
            want.append((i, k))
            left[i] -= k
            room -= k
            seed = i if left[i] else None
        if want:
            seed = want[-1][0] if left[want[-1][0]] else None
        assert [(d, len(x)) for d, _, x, _ in taken[1:]] == want
        n += 1
    assert n == tokens // 64 and sum(map(len, (x[3] for x in shard.rest()))) == tokens % 64
    assert len(left) == 150
