"""The operators that SQL can express, as DuckDB SQL over the given tables."""

from __future__ import annotations

from .secret_ledger import BASE, RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: list_aggregate(w[k:k + 4], 'string_agg', ' ')) WHEN len(w) > 0 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, o.vec_id, list_inner_product(q.v::DOUBLE[], o.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v o ON q.vec_id % 100 = 0 AND o.vec_id <> q.vec_id)) WHERE rank <= 10"""


def _spans() -> str:
    """A row per span of every rule: pieces between matches and the matches add up to positions."""
    arms = []
    for order, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        arms.append(f"SELECT doc_id, {order} AS o, '{r.kind}' AS kind, {r.least} AS least, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS longs, list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x)) AS kept FROM d WHERE regexp_matches(t, '{p}')")
    return " UNION ALL ".join(arms)


OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_spans()}),
e AS (SELECT doc_id, o, kind, kept[i] >= least AS ok, list_sum(gaps[1:i]) + coalesce(list_sum(longs[1:i - 1]), 0) AS a, longs[i] AS n FROM (SELECT *, unnest(range(1, len(longs) + 1)) AS i FROM m)),
f AS (SELECT doc_id, o, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM e WHERE ok),
g AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, string_agg(s, ',' ORDER BY a, o) FILTER (WHERE o < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY a, o) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""

OP6 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, k, list_aggregate(w[k:k + 12], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM hit),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
y AS (SELECT doc_id, count(*) AS n, count(gone.p) AS r, string_agg(x, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept FROM x LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN y USING (doc_id)"""

#: crc32 of the UTF-8 bytes that {0} gives in hexadecimal: a byte is added, then eight bits are shifted out.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len({0}), 2), lambda k: [(instr('123456789ABCDEF', {0}[k]) * 16 + instr('123456789ABCDEF', {0}[k + 1]))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295::BIGINT)"

OP12 = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, hex(encode(doc_id::VARCHAR)) AS x FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, {_CRC.format("x")} AS h FROM t),
a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + 1 + i % p])) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM d),
agree AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM agree) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch s WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) AS rank FROM run),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM run GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP13 = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
g AS (SELECT doc_id, w, count(*) AS k, hex(encode(doc_id || ':' || w)) AS x FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, k, {_CRC.format("x")} AS h FROM g),
o AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
shorter AS (SELECT DISTINCT c.word, c.n, v.word AS near, v.n AS near_n FROM cut c JOIN v ON v.word = c.less),
near AS (SELECT word, n, near, near_n FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY 1),
y AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
chain AS (SELECT word, word AS reached, form AS next FROM y UNION ALL SELECT c.word, y.word, y.form FROM chain c JOIN y ON y.word = c.next)
SELECT y.word, y.form, reached AS root, y.n, y.n_near, y.form_n FROM y JOIN chain c ON c.word = y.word AND c.next IS NULL"""
