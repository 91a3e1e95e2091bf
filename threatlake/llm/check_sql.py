"""DuckDB SQL with the same results as the queries that SQL can express over whole tables."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

JACCARD_COMPONENTS = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
    FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)
    GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id
FROM sets
"""

_LOWERED = r"""regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"""

#: Similarity of every window that starts at a shared shingle, counted from the shared shingles. Items of five words or more.
DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
iw AS (SELECT item_id, {_LOWERED} AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) AS total, unnest(range(0, len(w) - 4)) AS pos,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM dw),
ig AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, len(w) AS n,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM iw) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, total, least(n, total) AS m, pos, g, c FROM dg JOIN ig USING (g)),
starts AS (SELECT DISTINCT doc_id, item_id, least(pos, total - m) AS start FROM hits),
inside AS (SELECT doc_id, item_id, start, n, m, g, least(count(*), any_value(c)) AS common
    FROM starts JOIN hits USING (doc_id, item_id) WHERE pos BETWEEN start AND start + m - 5 GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, start, n, m, sum(common) AS s FROM inside GROUP BY ALL)
    WHERE 4 * s >= 3 * (m + n - 8 - s)),
items AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM held GROUP BY ALL)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, coalesce(item_ids, '') AS item_ids
FROM documents JOIN items USING (doc_id)
"""

INNER_PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS f FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.f AS DOUBLE[]), CAST(x.f AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id AND len(q.f) = len(x.f))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def _centroid_clusters(k: int = 40, rounds: int = 5) -> str:
    """The rounds of the clustering, one after the other; a sum is divided downwards, whatever its sign."""
    nearest = """SELECT vec_id, f, arg_min(num, (d, num)) AS num, min(d) AS d FROM (
        SELECT vec_id, f, num, CAST(list_sum(list_transform(list_zip(f, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{0}) GROUP BY vec_id, f"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT num, coalesce(g, c) AS c FROM c{i} LEFT JOIN (
            SELECT num, list((s - ((s % n) + n) % n) // n ORDER BY j) AS g FROM (
                SELECT num, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT num, unnest(f) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY num, j) GROUP BY num) USING (num))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS f FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS num, f AS c FROM (
    SELECT f, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)},
a AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, CAST(num AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY num) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} USING (num)
"""


CENTROID_CLUSTERS = _centroid_clusters()
