"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root and, for each leaf, (side, sibling) or None level by level."""
    level, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for proof, i in zip(proofs, at, strict=True):
            other = i ^ 1
            proof.append((other < i, level[other]) if other < len(level) else None)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (first(r[0]), leaf(r)))
        trees[name] = own, *tree([leaf(r) for r in own])
    root, tops = tree([trees[n][1] for n in names]) if names else (None, [])
    out = []
    for name, top in zip(names, tops, strict=True):
        own, subroot, proofs = trees[name]
        for r, proof in zip(own, proofs, strict=True):
            whole = proof + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            now = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for s in whole:
                now = h(now) if s is None else h(s[1], now) if s[0] else h(now, s[1])
            out.append((r[0], leaf(r), subroot, root, h(*(s[1] for s in whole if s)), now, now == root))
    return out


def key(r):
    return tuple(map(repr, r))


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_manifest_against_a_plain_tree(spark, block):
    """Nulls everywhere, repeated rows and ids, long and empty texts, languages of one row and of many, bytewise order of languages."""
    from docsift.llm.merkle import manifest

    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(70)] + [(i, None, "de", None, "ä" * i) for i in range(200, 205)]
    rows += [(i, "s", x, 5, "x") for i, x in enumerate([None, None, None, "", "éa", "z", "Z", "zz"], 300)] + [(7, "s1", "en", 7, "text 7"), (7, "other", "en", 1, ""), (None, "s", "en", 3, None), (None, None, None, None, None), (901, "s", "z", 9, "long " * 30_000)]
    rows += [rows[7], rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], COLUMNS + ", tree string, proof double").repartition(5)
    got = [tuple(x) for x in manifest(docs, block=block).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {x[6] for x in got} == {True, False}


def test_manifest_of_no_rows_and_of_one(spark):
    from docsift.llm.merkle import manifest

    assert manifest(spark.createDataFrame([], COLUMNS)).collect() == []
    one = [(5, "a", "en", 1, "x")]
    assert [tuple(x) for x in manifest(spark.createDataFrame(one, COLUMNS)).collect()] == brute(one)


def test_post_order_matches_level_order():
    from docsift.llm.merkle import traversed

    for n in range(1, 40):
        leaves = [h(str(i)) for i in range(n)]
        root, proofs = traversed(leaves, (n - 1).bit_length())
        want = tree(leaves)
        assert root == want[0]
        assert proofs == [["" if s is None else ("<" if s[0] else ">") + s[1] for s in p] for p in want[1]]
