"""SQL (DuckDB) that states the results of the registered queries where SQL can: joins and repeats.

No SQL: op1 (a randomised projection), op2 (a learned classifier), op3, op6 and op10 (tokenizers), op7 (hash
lanes), op9 (its patterns look behind, which DuckDB's don't). Their tests hold them against plain versions, exact round trips or held-out rows.
"""

from __future__ import annotations

#: Words of documents; white space is what the contracts name.
_WORDS = r"""
w AS (SELECT doc_id, text, {case} AS t FROM documents),
s AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(t, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM w
)"""

#: Links are among documents that share a shingle that is rare in the first places of both.
OP4 = (
    "WITH RECURSIVE"
    + _WORDS.format(case="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
sh AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(words) = 0 THEN []
             WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END
    ) AS g
    FROM s
),
h AS (SELECT doc_id, md5_number(g) AS g FROM sh),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
r AS (
    SELECT h.doc_id, h.g, n.n, row_number() OVER (PARTITION BY h.doc_id ORDER BY f.f, h.g) AS place
    FROM h JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS f FROM h GROUP BY g) f ON h.g = f.g
),
p AS (
    SELECT DISTINCT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv
    FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE a.place <= a.n - ceil(0.85 * a.n) + 1 AND b.place <= b.n - ceil(0.85 * b.n) + 1
      AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
),
i AS (
    SELECT u, v, nu, nv, count(*) AS i
    FROM p JOIN h a ON a.doc_id = u JOIN h b ON b.doc_id = v AND b.g = a.g
    GROUP BY ALL
),
l AS (SELECT u, v FROM i WHERE 100 * i >= 85 * (nu + nv - i)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
c AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT c.a, e.v FROM c JOIN e ON e.u = c.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) USING (doc_id)
"""
)

OP8 = (
    "WITH"
    + _WORDS.format(case="text")
    + """,
x AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM s WHERE len(words) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM x),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, range(0, 35) t(k)),
g AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id),
one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM s),
k AS (
    SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS kept
    FROM one LEFT JOIN gone USING (doc_id, i)
    WHERE gone.i IS NULL GROUP BY one.doc_id
)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
)

#: Runs of the bytes that repeated windows of {n} bytes cover: a start more than {n} behind the one before opens a new one.
_RUNS = """
x{n} AS (SELECT doc_id, unnest(range(0, n - {n} + 1)) AS i, h FROM hx WHERE n >= {n}),
win{n} AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 2 * {n})) AS m FROM x{n}),
rep{n} AS (SELECT doc_id, i FROM win{n} JOIN (SELECT m FROM win{n} GROUP BY m HAVING count(*) > 1) USING (m)),
o{n} AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {n} THEN 0 ELSE 1 END AS new
    FROM rep{n}
),
r{n} AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o{n}),
runs{n} AS (SELECT doc_id, run, min(i) AS lo, max(i) + {n} AS hi FROM r{n} GROUP BY ALL),
g{n} AS (SELECT doc_id, sum(hi - lo)::BIGINT AS covered, count(*) AS spans FROM runs{n} GROUP BY doc_id)"""

OP5 = (
    """
WITH b AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
),
hx AS (SELECT doc_id, n, lower(hex(b)) AS h FROM b),"""
    + _RUNS.format(n=400)
    + ","
    + _RUNS.format(n=256)
    + """,
cut AS (
    SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM runs400
    UNION ALL SELECT doc_id, max(hi), NULL FROM runs400 GROUP BY doc_id
),
k AS (
    SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS kept
    FROM cut JOIN hx USING (doc_id) GROUP BY doc_id
)
SELECT hx.doc_id AS doc_id, n AS n_bytes, coalesce(g400.covered, 0) AS n_removed, coalesce(g400.spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(g256.covered, 0) AS n_repeated
FROM hx LEFT JOIN g400 USING (doc_id) LEFT JOIN g256 USING (doc_id) LEFT JOIN k USING (doc_id)
"""
)

ORACLES = {"op4_jaccard": OP4, "op5_suffixes": OP5, "op8_blocks": OP8}
