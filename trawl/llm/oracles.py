"""The contract queries that DuckDB's SQL can express: sharding, mixing, the removal of repeated bytes, manifests and tries."""

from __future__ import annotations

#: Fixed values of XXH64, and the reversed polynomial of CRC-32.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
CRC_POLYNOMIAL = 3988292384
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _big(n: int) -> str:
    return f"'{n}'::UHUGEINT"


MODULUS = _big(2**64)


def _turned(x: str, bits: int) -> str:
    return f"(({x} * {_big(2**bits)}) % {MODULUS} + {x} // {_big(2 ** (64 - bits))})"


def _folded(x: str, bits: int) -> str:
    return f"xor({x}, {x} // {_big(2**bits)})"


def hashed(rows: str, seed: str, value: str, out: str) -> str:
    """rows (a SELECT) with out, Spark's xxhash64 of a long from a seed, unsigned. Each step is a SELECT of its own, so none is written out twice."""
    p1, p2, p3, p4, p5 = map(_big, PRIMES)
    steps = (
        f"{value}::UHUGEINT * {p2} % {MODULUS}",
        f"{_turned('_x', 31)} * {p1} % {MODULUS}",
        f"xor(({seed} + {p5} + {_big(8)}) % {MODULUS}, _x)",
        f"({_turned('_x', 27)} * {p1} + {p4}) % {MODULUS}",
        f"{_folded('_x', 33)} * {p2} % {MODULUS}",
        f"{_folded('_x', 29)} * {p3} % {MODULUS}",
        _folded("_x", 32),
    )
    sql = f"SELECT *, {steps[0]} AS _x FROM ({rows})"
    for s in steps[1:]:
        sql = f"SELECT * REPLACE ({s} AS _x) FROM ({sql})"
    return f"SELECT * RENAME (_x AS {out}) FROM ({sql})"


def seeded(seed: int, start: int = 42) -> int:
    """xxhash64 of an integer literal, as Spark hashes the columns before the next."""
    p1, p2, p3, _, p5 = PRIMES
    cut = 2**64 - 1
    h = ((start + p5 + 4) & cut) ^ (seed * p1 & cut)
    h = (((h << 23) & cut | h >> 41) * p2 + p3) & cut
    h = (h ^ h >> 33) * p2 & cut
    h = (h ^ h >> 29) * p3 & cut
    return h ^ h >> 32


def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(doc_id || '/{name}'), 1, 13))::UBIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {weight}::DOUBLE"


def sharding() -> str:
    """Two regions of two racks of two shards; one more shard weighs 1 against the regions' 4 and 4."""
    names = {f"r{i}": 4 for i in range(2)} | {f"k{i}": 2 for i in range(4)} | {f"s{i}": 1 for i in range(8)}
    draws = ", ".join(f"{_draw(n, w)} AS {n}" for n, w in names.items())
    rack = lambda k: f"CASE WHEN s{2 * k} <= s{2 * k + 1} THEN {2 * k} ELSE {2 * k + 1} END"
    region = lambda r: f"CASE WHEN k{2 * r} <= k{2 * r + 1} THEN {rack(2 * r)} ELSE {rack(2 * r + 1)} END"
    crc = f"""list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)"""
    entry = f"list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}::BIGINT) ELSE c >> 1 END, n::BIGINT)"
    flat = f"""SELECT doc_id, octet_length(encode(body))::BIGINT + 1 AS size, xor({crc}, 4294967295::BIGINT)::BIGINT AS text_crc32,
 CASE WHEN r0 <= r1 THEN {region(0)} ELSE {region(1)} END AS shard, grown < least(r0, r1) AS moved
 FROM (SELECT doc_id, coalesce(text, '') AS body, {draws}, {_draw('r+8', 1)} AS grown FROM documents) CROSS JOIN (SELECT list({entry} ORDER BY n) AS entries FROM range(256) t(n))"""
    placed = hashed(hashed(flat, _big(42), "doc_id", "_first"), "_first", "text_crc32", "_second")
    return f"""SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY _second % 4096, doc_id, text_crc32) - 1 AS slot,
 CASE WHEN moved THEN 8 ELSE shard END::INT AS grown_shard FROM ({placed})"""


def mixing() -> str:
    """A source is full at three times its size if its share of what the sources with less room for their weight leave is above that."""
    docs = hashed(f"SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents", _big(seeded(42)), "doc_id", "_hash")
    before = "OVER (ORDER BY words / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH d AS ({docs}), s AS (SELECT source, sum(size)::DOUBLE AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
 w AS (SELECT *, CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END::DOUBLE AS weight FROM s),
 f AS (SELECT *, (sum(words) OVER () - 3 * coalesce(sum(words) {before}, 0)) * weight > 3 * words * (sum(weight) OVER () - coalesce(sum(weight) {before}, 0)) AS full_ FROM w),
 r AS (SELECT sum(words) - 3 * coalesce(sum(words) FILTER (full_), 0) AS rest, sum(weight) FILTER (NOT full_) AS open_ FROM f),
 t AS (SELECT source, words, CASE WHEN full_ THEN 3 * words ELSE rest * weight / open_ END AS target FROM f CROSS JOIN r),
 q AS (SELECT *, round_even(target, 0)::BIGINT AS sent, words::BIGINT AS n FROM t),
 p AS (SELECT *, CASE WHEN n > 0 THEN sent // n ELSE 0 END AS whole FROM q),
 o AS (SELECT d.*, n, target, whole, sent - whole * n AS left_, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY _hash, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
 SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, left_ - seen)))::BIGINT AS taken FROM o"""


def repeats() -> str:
    """Every 400-byte string by itself, in hexadecimal: starts whose string starts elsewhere too, joined to runs where they touch."""
    return """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 w AS (SELECT doc_id, s, md5(b[s + 1 : s + 400]) AS m FROM (SELECT doc_id, b, unnest(range(0, octet_length(b)::BIGINT - 399)) AS s FROM d)),
 r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
 i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
 g AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY doc_id, k),
 e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM g),
 k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(hex(b[from_ + 1 : a]), '' ORDER BY a) || hex(any_value(b)[max(z) + 1 :]) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


#: The 256 entries of CRC-32's table, as a list.
CRC_ENTRIES = f"""SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLYNOMIAL}::BIGINT) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS entries FROM range(256) t(n)"""


def crc_of(value: str) -> str:
    """CRC-32 of a text; entries must be at hand."""
    taken = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({taken}, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def manifest() -> str:
    """Trees by recursion over levels, each row's siblings by joins with the runs on its way, and the root folded again."""
    value = lambda v: f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')"
    head = " || ".join(map(value, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang, sha256(head || {value('text')}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || {value('lower_')}) END AS other
  FROM (SELECT doc_id, lang, text, {lower} AS lower_, {head} AS head, {crc_of('doc_id::VARCHAR')} AS crc FROM documents CROSS JOIN ({CRC_ENTRIES}))),
 e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
 t(lang, l, i, h, n) AS (SELECT lang, 0, place, leaf, n FROM e UNION ALL SELECT lang, l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((n + 7) // 8) FROM t WHERE n > 1 GROUP BY lang, l, i // 8),
 s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE n = 1),
 u(l, i, h, n) AS (SELECT 0, place, subroot, count(*) OVER () FROM s UNION ALL SELECT l + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((n + 7) // 8) FROM u WHERE n > 1 GROUP BY l, i // 8),
 own AS (SELECT lang, place, l, string_agg(h, '' ORDER BY i) FILTER (i < place >> 3 * l) AS before, string_agg(h, '' ORDER BY i) FILTER (i > place >> 3 * l) AS after
  FROM (SELECT e.lang, e.place, t.l, t.i, t.h FROM e JOIN t ON e.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.i // 8 = e.place >> 3 * (t.l + 1)) GROUP BY ALL),
 up AS (SELECT lang, l, string_agg(h, '' ORDER BY i) FILTER (i < place >> 3 * l) AS before, string_agg(h, '' ORDER BY i) FILTER (i > place >> 3 * l) AS after
  FROM (SELECT s.lang, s.place, u.l, u.i, u.h FROM s JOIN u ON u.n > 1 AND u.i // 8 = s.place >> 3 * (u.l + 1)) GROUP BY lang, place, l),
 way AS (SELECT lang, place, coalesce(before, '') AS before, coalesce(after, '') AS after, row_number() OVER (PARTITION BY lang, place ORDER BY outer_, l) AS k
  FROM (SELECT lang, place, 0 AS outer_, l, before, after FROM own UNION ALL SELECT e.lang, e.place, 1, l, before, after FROM e JOIN up ON e.lang IS NOT DISTINCT FROM up.lang)),
 f(lang, place, k, x) AS (SELECT lang, place, 1, coalesce(other, leaf) FROM e UNION ALL SELECT f.lang, f.place, f.k + 1, sha256(before || x || after) FROM f JOIN way ON f.lang IS NOT DISTINCT FROM way.lang AND f.place = way.place AND f.k = way.k),
 r AS (SELECT lang, place, arg_max(x, k) AS folded FROM f GROUP BY lang, place),
 p AS (SELECT lang, place, string_agg(before || after, '' ORDER BY k) AS proof FROM way GROUP BY lang, place)
 SELECT e.doc_id, e.leaf, s.subroot, u.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, r.folded AS folded_root, r.folded = u.h AS verified
 FROM e JOIN s ON e.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.n = 1 JOIN r ON e.lang IS NOT DISTINCT FROM r.lang AND e.place = r.place LEFT JOIN p ON e.lang IS NOT DISTINCT FROM p.lang AND e.place = p.place"""


def trie() -> str:
    """A prefix is named by all of its turns; a node's subtree are the nodes whose smallest member's way leads through it."""
    return f"""WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
 b AS (SELECT DISTINCT c, {crc_of('c::VARCHAR')} % 6 AS h FROM o CROSS JOIN ({CRC_ENTRIES})),
 r AS (SELECT b.c, role, text, 0 AS kind, place FROM b JOIN o ON o.c = b.c - b.c % 100 AND place < h UNION ALL SELECT b.c, role, text, 1, place FROM b JOIN o ON o.c = b.c AND place >= h),
 q AS (SELECT c, text, octet_length(encode(role)) || ':' || role || text AS turn, row_number() OVER (PARTITION BY c ORDER BY kind, place) AS depth FROM r),
 m AS (SELECT c, depth, length(text) AS chars, sha256(string_agg(sha256(turn), '' ORDER BY other)) AS node FROM (SELECT a.c, a.depth, a.text, z.turn, z.depth AS other FROM q a JOIN q z ON a.c = z.c AND z.depth <= a.depth) GROUP BY c, depth, text),
 w AS (SELECT c, depth, chars, node, lag(node, 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS parent FROM m UNION ALL SELECT c, 0, 0, 'root', NULL FROM b),
 n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM w GROUP BY node),
 k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
 g AS (SELECT w.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens FROM n LEFT JOIN k USING (node) JOIN w ON w.c = n.conv_id AND w.depth <= n.depth GROUP BY w.node),
 e AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(node, depth) AS node FROM w GROUP BY c) GROUP BY node)
 SELECT n.conv_id, n.depth, z.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
 FROM n LEFT JOIN n z ON n.parent = z.node LEFT JOIN k ON n.node = k.node JOIN g ON n.node = g.node LEFT JOIN e ON n.node = e.node"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding(), "op5_mixing": mixing(), "op9_suffix_dedup": repeats(), "op12_merkle_manifest": manifest(), "op13_prefix_trie": trie()}
