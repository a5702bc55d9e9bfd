"""The template tree against a plain recursion, and a plan that holds the fit of a packing."""

import math
import random
import re

import pytest

from docsift.llm.url_filter import RULES, judge_urls


def brute(urls, rules=RULES, threshold=0.5, prior=0.1, weight=4.0, errors=2.0, least=5):
    rows, hosts = [], {}
    for i, url in urls:
        m = re.match(r"[^:]*?://([^/?#]*)([^?#]*)", url or "", re.S) if "://" in (url or "") else None
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else None
        shape = tuple("*" if re.search("[0-9]", s) else s for s in path.split("/") if s)
        rows.append((i, host, path, rule, shape))
        counts = hosts.setdefault(host, {}).setdefault(shape, [0, 0, 0])
        counts[0] += 1
        counts[1] += bool(rule and rule[2] == "block")
        counts[2] += bool(rule)
    rejected = set()

    def grow(host, group, depth, prior):
        total = [sum(c[k] for _, c in group) for k in range(3)]
        if len({s[depth:] for s, _ in group}) > 1 and total[0] >= least:
            while len({s[depth : depth + 1] for s, _ in group}) == 1:
                depth += 1
            children = {}
            for s, c in group:
                children.setdefault(s[depth] if len(s) > depth else "", []).append((s, c))
            kinds = lambda own: [sum(c[1] for _, c in own), sum(c[2] - c[1] for _, c in own), sum(c[0] - c[2] for _, c in own), sum(c[0] for s, c in own if len(s) <= depth + 1), sum(c[0] for s, c in own if s[depth + 1 : depth + 2] == ("*",))]
            pool = [x for k, own in children.items() if k for x in own]
            pool_n = sum(c[0] for _, c in pool)
            branches = {}
            for k, own in children.items():
                n = sum(c[0] for _, c in own)
                alike = k and all(abs(a / n - b / pool_n) <= errors * math.sqrt(b / pool_n * (1 - b / pool_n) / n) + 1e-9 for a, b in zip(kinds(own), kinds(pool), strict=True))
                branches.setdefault("*" if alike else k, []).extend(own)
            for own in branches.values():
                grow(host, own, depth + 1, (total[1] + weight * prior) / (total[0] + weight))
        elif (total[1] + prior * weight) / (total[2] + weight) >= threshold:
            rejected.update((host, s) for s, _ in group)

    for host, shapes in hosts.items():
        grow(host, list(shapes.items()), 0, prior)
    return [(i, h, p, r and r[1], r[2] if r else "block" if (h, s) in rejected else "allow") for i, h, p, r, s in rows]


def key(r):
    return tuple(map(repr, r))


def check(spark, urls, **more):
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in urls], "page_id long, url string, template string, prior double").repartition(3)
    got = [tuple(r) for r in judge_urls(pages, **more).collect()]
    assert sorted(got, key=key) == sorted(brute(urls, **more), key=key)
    return got


def test_tree_against_a_plain_recursion(spark):
    """Hosts with and without labels, small and large branches, ends within branches, nulls, repeated rows, empty segments."""
    r = random.Random(6)
    urls = []
    for _ in range(900):
        host = r.choice(["a.com", "b.net", "c.org", "d.test", "A.example.COM", "example.net"])
        top = r.choice([*["en"] * 9, "de", "es", "fr", f"u{r.randrange(3)}", r.choice("pqrstuvw")])
        rest = "/".join(r.choice(["", f"{r.randrange(90)}", r.choice("xyz"), r.choice("xyz")]) for _ in range(r.randrange(4)))
        urls.append(f"{r.choice(['http', 'https'])}://{host}/{top}/{rest}{r.choice(['', '?q=1', '#f'])}")
    urls = list(enumerate([*urls, None, "", "no scheme", "://", "x://h", urls[3], urls[3]]))
    got = check(spark, [*urls, urls[5], (None, urls[9][1])])
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_one_bad_branch_and_a_bad_host(spark):
    rules = [("block", "bad.test", "/en/"), ("block", "mixed.test", "/de/")]
    urls = [f"http://bad.test/en/{i}" for i in range(90)] + [f"http://bad.test/fr/{i}" for i in range(10)] + [f"http://mixed.test/de/{i}" for i in range(20)] + [f"http://mixed.test/en/{i}" for i in range(80)]
    got = check(spark, list(enumerate(urls)), rules=rules)
    assert {(r[1], r[2].split("/")[1], r[4]) for r in got} == {("bad.test", "en", "block"), ("bad.test", "fr", "block"), ("mixed.test", "de", "block"), ("mixed.test", "en", "allow")}


def test_many_alike_branches_are_one_template(spark):
    """Names below /user are blocked where the rule sees them; the others are judged with them."""
    rules = [("block", "h.test", f"/user/{c}") for c in "abcdefghijkl"] + [("allow", "h.test", "/help/a")]
    names = [a + b for a in "abcdefghijklmn" for b in "pqrst"]
    urls = [f"http://h.test/user/{n}/{i}" for n in names for i in range(3)] + [f"http://h.test/help/{n}/{i}" for n in names for i in range(3)]
    got = check(spark, list(enumerate(urls)), rules=rules)
    assert {r[4] for r in got if r[3] is None and "/user/" in r[2]} == {"block"} and {r[4] for r in got if r[3] is None and "/help/" in r[2]} == {"allow"}


def test_deep_paths_cost_rounds_by_branchings(spark, monkeypatch):
    from docsift.llm import url_filter

    made, own = [], url_filter.written
    monkeypatch.setattr(url_filter, "written", lambda df, label: (made.append(label), own(df, label))[1])
    deep = "/".join("abcdefgh"[i % 8] for i in range(300))
    check(spark, list(enumerate([f"http://h.test/{deep}/{x}/{i}" for x in "xy" for i in range(6)])))
    assert made.count("round") == 1


@pytest.mark.parametrize("seed", range(3))
def test_packing_plan_keeps_the_fit_and_is_no_worse_than_best_fit(seed):
    from docsift.llm import packing

    r = random.Random(seed)
    histograms = [{n: r.randint(1, 30) for n in r.sample(range(1, 4097), 400)}, {1366: 3000, 1364: 1000, 2100: 700, 1900: 600, 90: 500}, {4096: 3, 1: 5}, {r.randint(1, 900): 40 for _ in range(60)}]
    for h in histograms:
        ways = packing.fitted(h, 4096, packing.GROUPS, packing.MOST_IN_PATTERN)
        size = lambda found: sum(t for _, t in found)
        alone, found = size(packing.filled(h, 4096, packing.GROUPS, [])), packing.plan(h)
        assert size(found) <= alone
        held = {}
        for pattern, times in found:
            assert sum(n * k for n, k in pattern) <= 4096
            for n, k in pattern:
                held[n] = held.get(n, 0) + k * times
        assert held == h
        each = {s: size(packing.filled(h, 4096, packing.GROUPS, [(w, t * s // packing.SHARES) for w, t in ways])) for s in range(packing.SHARES + 1)}
        assert size(found) == min(each.values())
