"""DuckDB SQL for those operators whose whole result SQL expresses."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: SHA-1 as base32: five hexadecimal digits are four letters.
_BASE32 = f"""list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
  lambda s: substr({_LETTERS}, 1 + ((('0x' || substr(sha1(t), (5 * g + 1)::INT, 5))::INT >> s) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '')"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

#: A token is covered if a window that also starts in a smaller document starts at it or at one of the 49 tokens before.
_COVERED = """, m AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
r AS (SELECT k.doc_id, k.i FROM k JOIN m USING (s) WHERE m.first < k.doc_id),
c AS (SELECT t.doc_id, t.j, t.x, max(r.i) OVER (PARTITION BY t.doc_id ORDER BY t.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.j) """

WORDS = (
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS j, unnest(l) AS x FROM d),
w AS (SELECT doc_id, unnest(range(1, len(l) - 48)) AS i, l FROM d WHERE len(l) >= 50),
k AS (SELECT doc_id, i, array_to_string(l[i : i + 49], ' ') AS s FROM w)"""
    + _COVERED
    + """, g AS (SELECT doc_id, sum(gone::INT) AS n, coalesce(string_agg(x, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
)

BYTES = (
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, unnest(range(1, length(h) // 2 + 1)) AS j, unnest(regexp_extract_all(h, '..')) AS x FROM d),
u AS (SELECT doc_id, unnest(range(0, length(h), 512)) AS a, h FROM d),
v AS (SELECT doc_id, a, substr(h, a + 1, 610) AS p FROM u),
w AS (SELECT doc_id, a, p, unnest(range(0, least(512, length(p) - 98), 2)) AS o FROM v WHERE length(p) >= 100),
k AS (SELECT doc_id, (a + o) // 2 + 1 AS i, substr(p, o + 1, 100) AS s FROM w)"""
    + _COVERED
    + """, e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), FALSE) AS begins FROM c),
g AS (SELECT doc_id, sum(gone::INT) AS n, sum(begins::INT) AS spans, coalesce(string_agg(x, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(g.kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
)

#: Days 0 to 367: no correction reaches the last, which stands for all days to come. Equal neighbours form islands.
HISTORY = """WITH c AS (SELECT doc_id - ((doc_id % 5) + 5) % 5 AS d, doc_id AS m, j, lang AS v, ('0x' || substr(sha256(doc_id || ':' || j), 1, 12))::BIGINT AS h
  FROM documents, (SELECT unnest([0, 1]) AS j) WHERE doc_id IS NOT NULL),
k AS (SELECT *, h % 365 AS s, CASE WHEN (h // 1000) % 10 < 2 THEN 'd' WHEN (h // 1000) % 10 < 5 THEN 'c' ELSE 'u' END AS kind FROM c),
days AS (SELECT d, unnest(range(0, 368)) AS day FROM (SELECT DISTINCT d FROM k)),
f AS (SELECT x.d, x.day, max({a: h, b: m, c: j, k: kind, v: v}) FILTER (kind = 'c' AND day < s + 3) AS o, max({s: s, a: h, b: m, c: j, k: kind, v: v}) FILTER (kind <> 'c') AS b
  FROM days x JOIN k ON k.d = x.d AND k.s <= x.day GROUP BY ALL),
p AS (SELECT d, day, CASE WHEN o IS NOT NULL THEN o.v ELSE b.v END AS v FROM f WHERE o IS NOT NULL OR b.k = 'u'),
e AS (SELECT *, (lag(day) OVER w IS DISTINCT FROM day - 1 OR lag(v) OVER w IS DISTINCT FROM v)::INT AS begins FROM p WINDOW w AS (PARTITION BY d ORDER BY day)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY d ORDER BY day) AS version FROM e)
SELECT d AS doc_id, version::INT AS version, min(day) AS valid_from, nullif(max(day) + 1, 368) AS valid_to, min(v) AS value FROM g GROUP BY d, version"""

#: All pairs of a label; the smallest id of a component is the smallest that links reach.
EMBEDDINGS = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id"""


def _lloyd(clusters: int = 40, rounds: int = 5) -> str:
    """Rounds one after another; whole numbers all through, and a quotient rounded down whatever its sign."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id) - 1)::INT AS k, q FROM v QUALIFY k < {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.q) AS q, min({{d: {far}::BIGINT, k: c.k}}) AS b FROM v, c{r} c GROUP BY v.vec_id)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT b.k AS k, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{r})")
            steps.append(f"m{r} AS (SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM u{r} GROUP BY k, i)")
            steps.append(f"l{r} AS (SELECT k, list(x::BIGINT ORDER BY i) AS q FROM m{r} GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(l.q, c.q) AS q FROM c{r} c LEFT JOIN l{r} l USING (k))")
    return (
        """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = 64), """
        + ", ".join(steps)
        + f""" SELECT vec_id, b.k AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.k = b.k"""
    )


ORACLES = {"op1_warc": WARC, "op2_substring_dedup": WORDS, "op3_suffix_array_dedup": BYTES, "op5_embedding_dedup": EMBEDDINGS, "op12_history": HISTORY, "op13_centroids": _lloyd()}
