"""DuckDB SQL for the queries that SQL can express. The others are tested against plain versions in tests/llm."""

from cytoquill.llm import secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id)) AS component_id FROM s"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = vec_id), vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c"""


def _spans(kind: int, pattern: str, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {kind} AS kind, b AS start, b + length(m) AS "end", {value} AS value FROM (
  SELECT doc_id, source, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b
  FROM (SELECT doc_id, source, regexp_extract_all(t, '{quoted}') AS ms, string_split_regex(t, '{quoted}') AS gs FROM d), unnest(range(1, len(ms) + 1)) AS u(i))"""


_HEAD = secrets.ASSIGN_HEAD.replace("'", "''")
SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({_spans(0, secrets.ASSIGN, f"regexp_replace(m, '{_HEAD}', '')")}),
f AS (SELECT * FROM a WHERE length(value) >= {secrets.ASSIGN_LEAST} UNION ALL {_spans(1, secrets.ACCESS, "m")} UNION ALL {_spans(2, secrets.HEX, "m")}),
o AS (SELECT value, count(DISTINCT coalesce('s' || source, 'n')) <= {secrets.LIVE_OWNERS} AND count(DISTINCT doc_id) <= {secrets.LIVE_REPOSITORIES}
    AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS} AND regexp_matches(value, '[0-9]') AS live FROM f GROUP BY value),
j AS (SELECT f.*, o.live FROM f JOIN o USING (value)),
x AS (SELECT doc_id, start, kind, "end" FROM j UNION ALL SELECT DISTINCT doc_id, "end" - length(value), 3, "end" FROM j WHERE live),
y AS (SELECT doc_id, start, kind, (['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || start || ':' || "end" AS s FROM x),
per AS (SELECT doc_id, string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans FROM y GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN per USING (doc_id) LEFT JOIN c USING (doc_id)"""


_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
q AS (SELECT iid, item_id, t, count(*) AS times FROM (SELECT iid, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
c AS (SELECT count(*) AS documents, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c.documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t),
s AS (SELECT iid, item_id, doc_id, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * c.documents) // words)))) AS BIGINT) AS score
  FROM p JOIN f USING (t) JOIN q USING (t), c GROUP BY iid, item_id, doc_id, rid),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS size FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS u(k))),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cut AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM x)),
s AS (SELECT cut.lang, cut.phrase, cut.a, k, h.a AS l, e.a AS r, CAST((CAST(cut.a AS HUGEINT) * 2000000) // (h.a + e.a) AS BIGINT) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f e ON e.lang = cut.lang AND e.phrase = tail),
b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM x)) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN inside USING (lang, phrase)
  WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""

CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM i WHERE len(w) > 0))),
pos AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT rid, item_id, pos.k, i FROM pos JOIN win USING (k, g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)"""
