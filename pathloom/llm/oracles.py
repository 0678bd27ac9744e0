"""DuckDB SQL of the operators that SQL can express on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str, name: str) -> str:
    """Distinct five-word shingles (key, s) of a table's texts; with fewer words, the whole sequence."""
    words = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) AS s FROM {name}_w WHERE len(w) > 0)"""


WARC = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS top FROM pages)"""

DECONTAMINATION = f"""
WITH {_shingles('documents', 'doc_id', 'd')}, {_shingles('benchmark', 'item_id', 'b')},
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, k AS n_shared, CAST(k AS DOUBLE) / n AS containment FROM m JOIN n USING (item_id) WHERE k >= 0.75 * n"""

NGRAM_JOIN = f"""
WITH RECURSIVE {_shingles('documents', 'doc_id', 'd')},
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)"""

VECTOR_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
g AS (SELECT a AS vec_id, min(b) AS c FROM r GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
o AS (SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id FROM embeddings LEFT JOIN g USING (vec_id) LEFT JOIN k USING (vec_id))
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM o"""

SUFFIX_DEDUP = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS x FROM documents),
w AS MATERIALIZED (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM t WHERE n >= 400)),
d AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1) AS new FROM w SEMI JOIN d USING (h)),
k AS (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span FROM m),
s AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY r, span),
p AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM s UNION ALL SELECT r, max(b), max(n) FROM s JOIN t USING (r) GROUP BY r),
left_ AS (SELECT r, string_agg(substr(x, 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a) AS y FROM p JOIN t USING (r) GROUP BY r),
c AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM t LEFT JOIN c USING (r) LEFT JOIN left_ USING (r)"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 30), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN k USING (lang, t) GROUP BY lang, source, t),
x AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT x.lang, source, t, n, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY x.lang, source) + 5 * v) AS p FROM x JOIN v ON x.lang = v.lang),
y AS (SELECT lang, t, sum(n) AS n FROM x GROUP BY lang, t),
q AS (SELECT y.lang, t, 1 + (1000000000 * CAST(n + 5 AS HUGEINT)) // (sum(n) OVER (PARTITION BY y.lang) + 5 * v) AS q FROM y JOIN v ON y.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.t, CAST(p - q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE n > 0 AND p > q),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 50"""
