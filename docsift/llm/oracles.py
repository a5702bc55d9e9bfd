"""SQL that gives the rows of some of this package's queries."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = r"[\x20\x09-\x0D]+"
SPLIT = "list_filter(regexp_split_to_array({0}, '" + BLANK + "'), lambda w: w <> '')"

OP6 = f"""
with recursive words as (select doc_id, {SPLIT.format(LOWER.format("coalesce(text, '')"))} as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as s from words),
sized as (select doc_id, len(s)::bigint as n, s from sets),
items as (select doc_id, n, unnest(s) as g from sized),
common as (
  select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c from items a join items b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by all),
links as (select x, y from common where 100 * c >= 90 * (nx + ny - c)),
reach as (
  select doc_id as a, doc_id as b from sized
  union
  select r.a, e.y from reach r join (select x, y from links union all select y, x from links) e on r.b = e.x)
select doc_id, n as n_shingles, (select min(b) from reach where a = doc_id) as component_id from sized
"""

OP7 = f"""
with words as (select doc_id, {SPLIT.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
firsts as (select k, min(doc_id) as least from windows group by 1),
hits as (select doc_id, i from windows join firsts using (k) where least < doc_id),
gone as (select distinct doc_id, i + j as p from hits, (select unnest(range(0, 50)) as j)),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from words),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from each anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from words left join kept using (doc_id)
"""

PARTS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
with docs as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{PARTS}') as w from documents),
items as (select item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{PARTS}') as w from benchmark),
patterns as (
  select distinct item_id, k, least(10, len(w)) as n
  from (select item_id, w, unnest([array_to_string(w[i : i + 9], ' ') for i in range(1, greatest(len(w) - 8, 2))]) as k from items where len(w) > 0)),
sizes as (select distinct n from patterns),
windows as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from windows join patterns using (n, k)),
marked as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join marked using (doc_id) left join found using (doc_id)
"""

ENCODED = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
LEAF = lambda n: "sha256(" + " || ".join(map(ENCODED, ["doc_id", "source", "lang", n, "text"])) + ")"
#: CRC-32 of an ASCII string, bit by bit.
CRC32 = lambda c: f"""xor(list_reduce(list_prepend(4294967295::ubigint, flatten(list_transform(string_split({c}, ''), lambda x: [(ascii(x) + 256)::ubigint, 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: case when b > 0 then xor(a, b - 256) when a % 2 = 1 then xor(a // 2, 3988292384::ubigint) else a // 2 end), 4294967295::ubigint)"""  # noqa: E731
#: Trees level by level: a node's siblings are found by its place.
OP13 = f"""
with recursive leaves as materialized (
  select doc_id, lang, {LEAF("n_chars")} as leaf, case when {CRC32("doc_id::varchar")} % 7 = 0 then {LEAF("(n_chars + 1)")} else {LEAF("n_chars")} end as forged from documents),
numbered as materialized (select *, (row_number() over w - 1)::bigint as place, count(*) over (partition by lang) as total from leaves window w as (partition by lang order by doc_id nulls first, leaf)),
nodes as (
  select lang, 0 as level, place, leaf as digest, total from numbered
  union all
  select lang, level + 1, place // 2, sha256(string_agg(digest, '' order by place)), (total + 1) // 2 from (select * from nodes where total > 1) group by lang, level + 1, place // 2, total),
subroots as materialized (select lang, digest as subroot, level as height, (row_number() over (order by lang nulls first) - 1)::bigint as place, count(*) over () as total from nodes where total = 1),
tops as (
  select 0 as level, place, subroot as digest, total from subroots
  union all
  select level + 1, place // 2, sha256(string_agg(digest, '' order by place)), (total + 1) // 2 from (select * from tops where total > 1) group by level + 1, place // 2, total),
root as materialized (select digest as root, level as height from tops where total = 1),
lower as materialized (
  select n.doc_id, n.lang, n.place, n.leaf, n.forged, s.subroot, s.place as top_at, list(case when x.place is null then '' when x.place < n.place // (1 << x.level) then '<' || x.digest else '>' || x.digest end order by l.level) filter (l.level is not null) as proof
  from numbered n join subroots s on n.lang is not distinct from s.lang left join (select unnest(range(64))::int as level) l on l.level < s.height
  left join nodes x on x.lang is not distinct from n.lang and x.level = l.level and x.place = xor(n.place // (1 << l.level), 1::bigint) group by all),
upper as materialized (
  select s.place as top_at, list(case when x.place is null then '' when x.place < s.place // (1 << x.level) then '<' || x.digest else '>' || x.digest end order by l.level) filter (l.level is not null) as proof
  from subroots s, root r left join (select unnest(range(64))::int as level) l on l.level < r.height left join tops x on x.level = l.level and x.place = xor(s.place // (1 << l.level), 1::bigint) group by all),
proofs as materialized (select l.* exclude (proof), list_concat(coalesce(l.proof, []), coalesce(u.proof, [])) as proof from lower l join upper u using (top_at)),
folded as (select *, list_reduce(list_prepend(forged, proof), lambda a, s: case when s = '' then sha256(a) when s[1] = '<' then sha256(s[2:] || a) else sha256(a || s[2:]) end) as folded_root from proofs)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folded, root
"""


def k_means_sql(k: int = 8, rounds: int = 10) -> str:
    """Round by round: d and a assign vectors to the centroids c of the round before, c moves them."""
    assign = lambda i: f"""a{i} as materialized (select n, min_by(c, (d, c)) as c, min(d) as d from (
  select n, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::hugeint as d from kept, c{i}) group by 1)"""  # noqa: E731
    move = lambda i: f"""s{i} as (select c, j, sum(x[j])::hugeint as s, count(*)::hugeint as n from (select c, x, unnest(range(1, 65)) as j from a{i - 1} join kept using (n)) group by 1, 2),
c{i} as materialized (select c, coalesce(f, m) as m from c{i - 1} left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as f from s{i} group by 1) using (c))"""  # noqa: E731
    steps = [assign(0)] + [x for i in range(1, rounds + 1) for x in (move(i), assign(i))]
    return f"""with kept as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id::varchar), x) - 1)::int as c, x as m from kept qualify c < {k}),
{", ".join(steps)},
total as (select c, sum(d)::bigint as cluster_inertia from a{rounds} group by 1)
select vec_id, c as cluster, d::bigint as distance, cluster_inertia, (select sum(d)::bigint from a{rounds}) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join kept using (n) join total using (c) join c{rounds} using (c)"""
