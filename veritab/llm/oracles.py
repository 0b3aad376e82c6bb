"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

THRESHOLD_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_COMPONENTS = """
reach(node, other) AS (SELECT DISTINCT u, u FROM links UNION SELECT reach.node, links.v FROM reach JOIN links ON links.u = reach.other),
classes AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""

PARITY_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(2, len(ws) - 3))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN classes ON node = w.doc_id
"""

MULTI_INDEX = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u),
{_COMPONENTS}
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN classes ON node = vec_id
"""

TREE_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, greatest(1, len(ws) - 18))) t(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM hit, unnest(range(i, i + 20)) t(j)),
words AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) t(j)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOOR = "(({0}) - ((({0}) % ({1})) + ({1})) % ({1})) // ({1})"


def _clustering() -> str:
    steps = []
    for r in range(4):
        steps.append(f"""
n{r} AS MATERIALIZED (SELECT row_id, min(struct_pack(d := d, c := c)) AS best FROM (SELECT row_id, c, CAST(e2 - 2 * list_inner_product(v.e, p.e) + list_inner_product(p.e, p.e) AS BIGINT) AS d FROM v, p{r} p) GROUP BY row_id)""")
        if r < 3:
            floor = _FLOOR.format("CAST(sum(CAST(x AS BIGINT)) AS BIGINT)", "count(*)")
            steps.append(f"""
m{r} AS (SELECT c, list(CAST(f AS DOUBLE) ORDER BY i) AS e FROM (SELECT best.c AS c, i, {floor} AS f FROM (SELECT best, unnest(v.e) AS x, unnest(range(64)) AS i FROM n{r} JOIN v USING (row_id)) GROUP BY 1, 2) GROUP BY c),
p{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.e, p{r}.e) AS e FROM p{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, e, list_inner_product(e, e) AS e2 FROM k),
p0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v QUALIFY c < 16),{",".join(steps)},
got AS (SELECT vec_id, best.c AS c, best.d AS d FROM n3 JOIN v USING (row_id)),
per AS (SELECT c, sum(d) AS s FROM got GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(per.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM got) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(p3.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM got JOIN per USING (c) JOIN p3 USING (c)
"""


def _codes() -> str:
    steps = []
    for r in range(5):
        steps.append(f"""
n{r} AS MATERIALIZED (SELECT row_id, q, min(struct_pack(d := d, j := j)) AS best
      FROM (SELECT row_id, q, j, CAST(list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, p.e) + list_inner_product(p.e, p.e) AS BIGINT) AS d FROM v JOIN p{r} p USING (q)) GROUP BY row_id, q)""")
        if r < 4:
            floor = _FLOOR.format("CAST(sum(CAST(x AS BIGINT)) AS BIGINT)", "count(*)")
            steps.append(f"""
m{r} AS (SELECT q, j, list(CAST(f AS DOUBLE) ORDER BY i) AS e
      FROM (SELECT q, best.j AS j, i, {floor} AS f FROM (SELECT q, best, unnest(v.e) AS x, unnest(range(len(v.e))) AS i FROM n{r} JOIN v USING (row_id, q)) GROUP BY 1, 2, 3) GROUP BY q, j),
p{r + 1} AS MATERIALIZED (SELECT q, j, coalesce(m{r}.e, p{r}.e) AS e FROM p{r} LEFT JOIN m{r} USING (q, j))""")
    return f"""
WITH k AS (SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE {_FINITE}),
v AS MATERIALIZED (SELECT row_id, vec_id, label, q, e[q * len(e) // 4 + 1:(q + 1) * len(e) // 4] AS e FROM k, range(4) t(q)),
p0 AS MATERIALIZED (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS j, e FROM v QUALIFY j < 256),{",".join(steps)},
got AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(best.j), 2, '0')), '' ORDER BY q) AS code, sum(best.d) AS error FROM n4 JOIN v USING (row_id, q) GROUP BY row_id, vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY q, j)) AS h FROM p4)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM got
"""


CENTROID_CLUSTERING, VECTOR_CODES = _clustering(), _codes()


def _escaped_chars(text: str) -> str:
    """Code points of a text with the template's escapes: a backslash more for each backslash, each # behind another, each end mark."""
    return rf"(len({text}) + len({text}) - len(replace({text}, '\', '')) + len({text}) - len(replace({text}, '#', '')) - len(regexp_extract_all({text}, '#+')) + len(regexp_extract_all({text}, '</turn>')))"


PREFIX_TARGETS = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
spelt AS (SELECT *, replace(replace(role, '%', '%25'), ':', '%3A') AS r FROM t),
f AS (SELECT *, 4 + {_escaped_chars("r")} + 2 + {_escaped_chars("text")} + 8 AS chars FROM spelt),
o AS (SELECT *, row_number() OVER w AS i, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
