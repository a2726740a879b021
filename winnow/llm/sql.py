"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Words are the operator's constants K = 8 and two-word substrings, numbered from 1 here.
ANCHORS = (
    "w as (select *, {words} as w from {table}), "
    "g as (select *, case when len(w) < 8 then []::varchar[] else [substr(md5(w[i] || ' ' || w[i + 1]), 1, 8) for i in range(1, len(w))] end as g from w), "
    "m as (select *, [{{'p': i - 1, 'h': substr(md5(g[i] || g[i + 2] || g[i + 4] || g[i + 6]), 1, 6), 'c': least(g[i], g[i + 6]) <= least(g[i + 1], g[i + 2], g[i + 3], g[i + 4], g[i + 5])}} for i in range(1, len(g) - 5)] as m from g), "
    "c as (select *, list_filter(m, lambda x: x.c) as closed from m), "
    "a as (select *, case when len(w) < 8 then [{{'p': i - 1, 'h': substr(md5(w[i]), 1, 6), 'c': true}} for i in range(1, len(w) + 1)] when len(closed) = 0 then m else closed end as a from c), "
    "{out} as (select doc_id, array_to_string([(a[i].p - coalesce(a[i - 1].p, 0))::varchar || a[i].h for i in range(1, len(a) + 1)], '') as f, "
    "list_distinct(case when len(a) = 1 then [a[1].h] else [a[i].h || (a[i + 1].p - a[i].p)::varchar || a[i + 1].h for i in range(1, len(a))] end) as u from a)"
)


def _anchors(table: str, out: str) -> str:
    """CTEs from a table (doc_id, text) to out (doc_id, f: fingerprint, u: what positional matching compares)."""
    sql = ANCHORS.format(words=WORDS, table=table, out=out)
    for name in "wgmca":
        sql = sql.replace(f"from {name})", f"from {out}_{name})").replace(f"from {name}), ", f"from {out}_{name}), ").replace(f"{name} as (select", f"{out}_{name} as (select")
    return sql


def _near(x: str, y: str) -> str:
    return f"case when len({x}) + len({y}) = 0 then 1.0::double else 2 * len(list_intersect({x}, {y})) / (len({x}) + len({y}))::double end"


FINGERPRINTS = (
    "with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc) as k, count(*) over () as n from documents), "
    "p as (select x.doc_id, x.text, length(x.text) as n_chars, y.doc_id as next_id, left(x.text, length(x.text) - length(x.text) // 2) || left(y.text, length(x.text) // 2) as edited from d x join d y on y.k = x.k % x.n + 1), "
    "e as (select doc_id, edited as text from p), "
    + _anchors("d", "fd")
    + ", "
    + _anchors("e", "fe")
    + f" select p.doc_id, n_chars, sha256(edited) as edited_sha256, o.f as fingerprint, e.f as edited_fingerprint, {_near('o.u', 'e.u')} as near_edited, {_near('o.u', 'x.u')} as near_next "
    "from p join fd o on o.doc_id = p.doc_id join fe e on e.doc_id = p.doc_id join fd x on x.doc_id = p.next_id"
)

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NEAR_DEDUP = (
    f"with recursive w as (select doc_id, {WORDS.replace('coalesce(text', f'coalesce({LOWER}')} as w from documents), "
    "s as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else [array_to_string(list_slice(w, i, i + 3), ' ') for i in range(1, len(w) - 2)] end) as s from w), "
    "n as (select doc_id, count(*) as n from s group by 1), "
    "c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2), "
    "l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)), "
    "r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen), "
    "m as (select node, min(seen) as component_id from r group by 1) "
    "select node as doc_id, coalesce(n.n, 0) as n_shingles, component_id, node = component_id as kept from m left join n on n.doc_id = node"
)

SUFFIX_DEDUP = (
    f"with w as (select doc_id, {WORDS} as w from documents), "
    "x as (select doc_id, unnest(range(0, len(w) - 49)) as pos, unnest([array_to_string(list_slice(w, i, i + 49), ' ') for i in range(1, len(w) - 48)]) as x from w where len(w) >= 50), "
    "one as (select x, min(doc_id) as one from x group by 1 having min(doc_id) <> max(doc_id)), "
    "two as (select x, min(doc_id) as two from x join one using (x) where doc_id <> one group by 1), "
    "h as (select doc_id, pos, case when doc_id = one then two else one end as other from x join one using (x) join two using (x)), "
    "b as (select *, case when pos < max(pos + 50) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from h), "
    "p as (select *, sum(fresh) over (partition by doc_id order by pos) as part from b) "
    "select doc_id, min(pos)::bigint as start_word, (max(pos) + 50)::bigint as end_word, (max(pos) + 50 - min(pos))::bigint as n_words, min(other) as other_id from p group by doc_id, part"
)

BITS = "('0x' || substr(h, {at}, 5))::bigint"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
BASE32 = " || ".join(f"substr({LETTERS}, (({BITS.format(at=5 * g + 1)}) >> {15 - 5 * j} & 31)::int + 1, 1)" for g in range(8) for j in range(4))
WARC = (
    "with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages), "
    "f as (select *, min(page_id) over (partition by h) as first from p) "
    f"select page_id, payload_bytes, {BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from f"
)

#: crc32 by the reflected polynomial's table; crc(x) is for a list of byte numbers.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"
BYTES = "[('0x' || substr({hex}, 2 * i + 1, 2))::bigint for i in range(0, length({hex}) // 2)]"

RESAMPLING = (
    f"with crc as (select {CRC_TABLE} as t), "
    "texts as (select doc_id as id, true as own, text from documents union all select item_id, false, text from benchmark), "
    f"w as (select id, own, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts), "
    "f as (select id, own, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as f from w), "
    "d as (select f, hex(encode(f)) as h from (select distinct f from f)), "
    f"b as (select f, {CRC.format(bytes=BYTES.format(hex='h'))} % 10000 as bucket from d, crc), "
    "n as (select bucket, count(*) filter (where own)::bigint as s, count(*) filter (where not own)::bigint as t from f join b using (f) group by 1), "
    "total as (select sum(s)::double as s, sum(t)::double as t from n), "
    "g as (select bucket, floor(1000 * ln((n.t + 1)::double * (total.s + 10000) / ((n.s + 1)::double * (total.t + 10000))))::bigint as gain from n, total), "
    "x as (select id as doc_id, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from f join b using (f) join g using (bucket) where own group by 1), "
    "y as (select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('7:' || id::varchar), 1, 8))::bigint as h from w left join x on x.doc_id = w.id where own), "
    "z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from y), "
    "r as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from z where n_words >= 20) "
    "select doc_id, n_features, weight, score, case when rank <= 25 * n // 100 then rank end as rank from z left join r using (doc_id)"
)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _merkle_levels(name: str, leaves: str) -> str:
    """CTEs name_n: all nodes (g, level, pos, size, hash); name_s: with each node's siblings l, r and parent."""
    up = f"select g, level + 1 as level, pos // 8 as pos, (any_value(size) + 7) // 8 as size, sha256(string_agg(hash, '' order by pos)) as hash from {name}_n where size > 1 group by g, level, pos // 8"
    side = lambda sign: f"coalesce(string_agg(b.hash, '' order by b.pos) filter (where b.pos {sign} a.pos), '')"
    return (
        f"{name}_n as (select g, 0::bigint as level, pos, size, hash from {leaves} union all {up}), "
        f"{name}_s as (select a.g, a.level, a.pos, {side('<')} as l, {side('>')} as r from {name}_n a join {name}_n b on a.g is not distinct from b.g and a.level = b.level and a.pos // 8 = b.pos // 8 where a.size > 1 group by 1, 2, 3)"
    )


MERKLE = (
    f"with recursive crc as (select {CRC_TABLE} as t), "
    f"d as (select documents.*, {CRC.format(bytes='[ascii(c) for c in string_split(doc_id::varchar, ' + chr(39) * 2 + ')]')} % 3 = 0 as hit from documents, crc), "
    f"h as (select doc_id, lang, {_leaf('text')} as leaf, case when hit then {_leaf(LOWER)} else {_leaf('text')} end as later from d), "
    "p as (select doc_id, lang as g, leaf as hash, later, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos, count(*) over (partition by lang) as size from h), "
    + _merkle_levels("a", "p")
    + ", sub as (select g as lang, hash from a_n where size = 1), "
    "q as (select 0 as g, lang, hash, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as size from sub), "
    + _merkle_levels("b", "q")
    + ", root as (select hash as root from b_n where size = 1), "
    "f as (select doc_id, g, 0::bigint as level, pos, later as h, ''::varchar as proof from p union all select f.doc_id, f.g, f.level + 1, f.pos // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r from f join a_s s on s.g is not distinct from f.g and s.level = f.level and s.pos = f.pos), "
    "e as (select doc_id, g, h, proof from (select *, row_number() over (partition by doc_id order by level desc) as k from f) where k = 1), "
    "t as (select e.doc_id, e.g, 0::bigint as level, q.pos, e.h, e.proof from e join q on q.lang is not distinct from e.g union all select t.doc_id, t.g, t.level + 1, t.pos // 8, sha256(s.l || t.h || s.r), t.proof || s.l || s.r from t join b_s s on s.level = t.level and s.pos = t.pos), "
    "o as (select doc_id, h, proof from (select *, row_number() over (partition by doc_id order by level desc) as k from t) where k = 1) "
    "select p.doc_id, p.hash as leaf, sub.hash as subroot, root, sha256(o.proof) as proof_sha256, o.h as folded_root, o.h = root as verified from p join sub on sub.lang is not distinct from p.g join o using (doc_id), root"
)


def oracle_sql() -> dict[str, str]:
    return {"op3_fingerprints": FINGERPRINTS, "op6_near_dedup": NEAR_DEDUP, "op7_suffix_dedup": SUFFIX_DEDUP, "op9_warc": WARC, "op11_resampling": RESAMPLING, "op13_merkle": MERKLE}
