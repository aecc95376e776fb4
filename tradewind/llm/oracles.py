"""The same results in DuckDB's SQL, where SQL can express them."""

WORDS = r"""list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

OP3 = (
    """
WITH RECURSIVE w AS (
    SELECT doc_id, """
    + WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ AS ws FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN s x ON a = x.doc_id JOIN s y ON b = y.doc_id
    WHERE 100 * c >= 90 * (len(x.sh) + len(y.sh) - c)
), linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, x.b FROM reach r JOIN linked x ON r.b = x.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, sh
"""
)

OP5 = (
    """
WITH w AS (
    SELECT doc_id, """
    + WORDS.format(text="coalesce(text, '')")
    + """ AS ws FROM documents
), g AS (
    SELECT doc_id, unnest(range(1, len(ws) - 11)) AS pos, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS phrase
    FROM w WHERE len(ws) >= 13
), f AS (SELECT phrase, min(doc_id) AS earliest FROM g GROUP BY phrase),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM g JOIN f USING (phrase) WHERE earliest < doc_id),
r AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
)

OP6 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: A round: the nearest entry of every part, then the entries anew.
_NEAREST = """
d{r} AS (
    SELECT k.id, k.p, e.e, list_sum(list_transform(range(1, len(k.v) + 1), lambda i: (k.v[i] - e.v[i]) * (k.v[i] - e.v[i]))) AS d
    FROM parts k JOIN b{r} e USING (p)
), n{r} AS (SELECT id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY id, p ORDER BY d, e) AS place FROM d{r}) WHERE place = 1),
"""
_REPLACED = """
c{r} AS (
    SELECT p, e, list(m ORDER BY i) AS v FROM (
        SELECT p, e, i, (s - ((s % c) + c) % c) // c AS m FROM (
            SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS c
            FROM (SELECT n.p, n.e, unnest(range(1, len(k.v) + 1)) AS i, unnest(k.v) AS x FROM n{r} n JOIN parts k USING (id, p)) GROUP BY p, e, i
        )
    ) GROUP BY p, e
), b{n} AS (SELECT p, e, coalesce(c.v, b.v) AS v FROM b{r} b LEFT JOIN c{r} c USING (p, e)),
"""

OP11 = (
    """
WITH x AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE """
    + FINITE
    + """
), parts AS (SELECT id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM x, range(4) AS t(p)),
b0 AS (SELECT p, id AS e, v FROM parts WHERE id < 256),
"""
    + "".join(_NEAREST.format(r=r) + _REPLACED.format(r=r, n=r + 1) for r in range(4))
    + _NEAREST.format(r=4)
    + """
digest AS (
    SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
    FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS c FROM b4)
), rows AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM rows JOIN x USING (id), digest
"""
)

OP13 = (
    """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE """
    + FINITE
    + """ AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, x.b FROM reach r JOIN links x ON r.b = x.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least_of.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least_of.b, vec_id)) AS kept
FROM embeddings LEFT JOIN least_of ON least_of.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
)
