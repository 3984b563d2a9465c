"""DuckDB SQL of the operators whose results SQL can express outright, by plain window and set comparison."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, unnest(list_transform(range(1, len(words) - 48), lambda i: md5_number(array_to_string(list_slice(words, i, i + 49), ' ')))) AS win FROM d WHERE len(words) >= 50),
m AS (SELECT win, min(doc_id) AS least FROM h GROUP BY win),
s AS (SELECT doc_id, i FROM h JOIN m USING (win) WHERE least < doc_id),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
c AS (SELECT u.doc_id, u.i, word, s.i AS last_start FROM u ASOF LEFT JOIN s ON u.doc_id = s.doc_id AND u.i >= s.i),
f AS (SELECT doc_id, i, word, coalesce(i - last_start < 50, false) AS gone FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
u AS (SELECT doc_id, len(x) AS n, unnest(x) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS shared FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n_a + n_b - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(encode(coalesce(text, '')) AS BLOB) AS b FROM documents),
b AS (SELECT rid, doc_id, unnest(range(1, octet_length(b) + 1)) AS i, unnest(list_transform(range(1, octet_length(b) + 1), lambda i: hex(b[i:i]))) AS x FROM d),
h AS (SELECT rid, doc_id, i, x, CASE WHEN count(*) OVER w = 50 THEN md5_number(string_agg(x, '') OVER w) END AS win FROM b WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS least FROM h WHERE win IS NOT NULL GROUP BY win),
s AS (SELECT rid, i, x, max(CASE WHEN least < doc_id THEN i END) OVER (PARTITION BY rid ORDER BY i) AS last_start FROM h LEFT JOIN m USING (win)),
f AS (SELECT rid, i, x, coalesce(i - last_start < 50, false) AS gone FROM s),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS begins FROM f),
k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
