"""SQL of the queries op11 to op13."""

from __future__ import annotations

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The table of the check sum's polynomial; ``_crc`` looks up one entry per byte.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab"


def _crc(x: str) -> str:
    each = f"list_transform(range(0, octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"


def _leaf(n: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n, "text")) + ")"


OP11 = f"""WITH RECURSIVE k AS ({CRC_TABLE}),
d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS other FROM documents, k),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS lev, pos, leaf AS h, n FROM p UNION ALL
  SELECT lang, any_value(lev) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, pos // 2, n),
s AS (SELECT lang, h AS subroot, lev AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lev, pos, subroot AS h, n FROM s UNION ALL SELECT any_value(lev) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY pos // 2, n),
a AS (SELECT p.lang IS NULL AS nolang, coalesce(p.lang, '') AS l, p.pos AS leaf_pos, t.lev, CASE WHEN t.pos < p.pos >> t.lev THEN 1 ELSE 2 END AS side, t.h FROM p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang AND t.pos = xor(p.pos >> t.lev, 1)
  UNION ALL SELECT s.lang IS NULL, coalesce(s.lang, ''), p.pos, s.height + u.lev, CASE WHEN u.pos < s.pos >> u.lev THEN 1 ELSE 2 END, u.h FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.pos = xor(s.pos >> u.lev, 1)),
b AS (SELECT nolang, l, leaf_pos, map_from_entries(list({{'k': lev, 'v': {{'side': side, 'h': h}}}})) AS steps, sha256(string_agg(h, '' ORDER BY lev)) AS proof FROM a GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, p.other, s.subroot, s.height + (SELECT max(lev) FROM u) AS levels, b.steps, b.proof FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN b ON b.nolang = (p.lang IS NULL) AND b.l = coalesce(p.lang, '') AND b.leaf_pos = p.pos),
g AS (SELECT doc_id, leaf, subroot, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(other, leaf), list_transform(range(levels), lambda i: CASE WHEN steps[i] IS NULL THEN '0' ELSE steps[i].side || steps[i].h END)), lambda acc, x: sha256(CASE x[1] WHEN '0' THEN acc WHEN '1' THEN substr(x, 2) || acc ELSE acc || substr(x, 2) END)) AS folded_root FROM f)
SELECT g.doc_id, leaf, subroot, r.root, proof_sha256, folded_root, folded_root = r.root AS verified FROM g, (SELECT h AS root FROM u WHERE n = 1) r"""

OP12 = f"""WITH RECURSIVE k AS ({CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, '{UP}', '{LO}') AS run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc("(id || ':' || run)")} AS h FROM c, k),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
v AS (SELECT word, n, x.i AS i, x.less AS less FROM (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: {{'i': i, 'less': substr(word, 1, i - 1) || substr(word, i + 1)}})) AS x FROM w)),
e AS (SELECT x.word AS a, y.word AS b, y.n AS m FROM v x JOIN v y ON x.less = y.less AND x.i = y.i AND x.word <> y.word UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
q AS (SELECT a, count(*) AS n_near, min({{'less': -m, 'word': b}}) AS best FROM e GROUP BY 1),
z AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.word END AS form, CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN q ON q.a = w.word),
y AS (SELECT word, word AS root FROM z UNION ALL SELECT y.word, z.form FROM y JOIN z ON z.word = y.root WHERE z.form IS NOT NULL)
SELECT z.word, z.form, y.root, z.n, z.n_near, z.form_n FROM z JOIN y ON y.word = z.word JOIN z AS last ON last.word = y.root AND last.form IS NULL"""

SP = r"[\x20\x09-\x0D]"


def _chars(kinds: str) -> str:
    return f"length(regexp_replace(text, '[^{kinds}]', '', 'g'))"

OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{SP}+'), lambda x: x <> '') AS ws, string_split(text, chr(10)) AS ls FROM d),
g AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'g': array_to_string(ws[i:i + 2], ' ')}})) AS x FROM w WHERE len(ws) > 2),
t AS (SELECT rid, x.i AS i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x.g) AS m FROM g) WHERE m > 1),
q AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
b AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '{SP}', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words,
  {_chars(r'\x20\x09-\x0D')} AS c0, {_chars(r'\p{Ll}')} AS c1, {_chars(r'\p{Lu}\p{Lt}')} AS c2, {_chars(r'\p{Lm}\p{Lo}\p{M}')} AS c3, {_chars(r'\p{P}')} - {_chars(r'#*%&@/_\\')} AS c4, {_chars(r'\p{S}')} + {_chars(r'#*%&@/_\\')} AS c5, length(text) - {_chars(r'\p{N}')} AS c7 FROM w LEFT JOIN q USING (rid)),
a AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [c0, c1, c2, c3, c4, c5, c7 - c0 - c1 - c2 - c3 - c4 - c5] AS cs FROM b),
hot AS (SELECT rid, m >= 20 AND 100 * m > (count(*) OVER (PARTITION BY lang)) AS many FROM (SELECT rid, lang, count(*) OVER (PARTITION BY lang, text) AS m FROM d)),
v AS (SELECT a.* FROM a JOIN hot USING (rid) WHERE NOT many AND NOT base_failed),
n AS (SELECT lang, count(*) AS docs FROM v GROUP BY 1),
f AS (SELECT lang, unnest(range(7)) AS c, unnest(list_transform(cs, lambda x: x * 1024 // c7)) AS bin FROM v WHERE c7 > 0),
m AS (SELECT lang, list(bin ORDER BY c) AS cl FROM (SELECT lang, c, list_sort(list(bin))[(count(*) + 1) // 2] AS bin FROM f GROUP BY ALL) GROUP BY 1),
e AS (SELECT list(bin ORDER BY c) AS cl FROM (SELECT c, list_sort(list(bin))[(count(*) + 1) // 2] AS bin FROM f GROUP BY ALL)),
o AS (SELECT rid, lang, n_words, word, count(*) AS k FROM (SELECT rid, lang, n_words, base_failed, unnest(list_transform(ws, lambda x: translate(x, '{UP}', '{LO}'))) AS word FROM a) GROUP BY ALL),
s AS (SELECT o.lang, o.word, CAST(sum(o.k * 1048576 // o.n_words) AS BIGINT) AS total FROM o JOIN v USING (rid) GROUP BY ALL),
r AS (SELECT s.lang, s.word, total // docs AS share FROM s JOIN n ON s.lang IS NOT DISTINCT FROM n.lang WHERE total * 400 >= docs * 1048576 AND docs >= 20),
h AS (SELECT a.rid, r.share / 1048576 AS q, coalesce(o.k, 0) / a.n_words AS p FROM a JOIN r ON a.lang IS NOT DISTINCT FROM r.lang LEFT JOIN o ON o.rid = a.rid AND o.word = r.word WHERE a.n_words >= 50),
j AS (SELECT * FROM h UNION ALL SELECT rid, 1 - sum(q), 1 - sum(p) FROM h GROUP BY 1),
x AS (SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS far FROM j GROUP BY 1),
l AS (SELECT a.rid, list_transform(coalesce(CASE WHEN n.docs >= 20 THEN m.cl END, e.cl), lambda b: CASE WHEN b > 0 THEN 2 * b + 1 ELSE 0 END) AS cl, cs, c7 FROM a CROSS JOIN e LEFT JOIN n ON n.lang IS NOT DISTINCT FROM a.lang LEFT JOIN m ON m.lang IS NOT DISTINCT FROM a.lang WHERE c7 >= 100),
i AS (SELECT rid, unnest(list_transform(cs, lambda c: c / c7)) AS p, unnest(list_transform(cl, lambda c: c / list_sum(cl))) AS q FROM l),
y AS (SELECT rid, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS near FROM i GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near <= 0.14, true) AND coalesce(far <= 0.18 + 2.6 / sqrt(n_words), true) AS kept,
  round(near, 6) AS class_distance, round(far, 6) AS word_distance FROM a LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)"""
