"""DuckDB SQL for the rows of operators that SQL can express, by comparing everything with everything."""

from __future__ import annotations

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SETS = f"""words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words)"""

#: Equal sets are one class; classes that share a shingle are compared, links closed over classes.
NEAR_DUPLICATES = f"""WITH RECURSIVE {_SETS},
    classes AS MATERIALIZED (SELECT s, min(doc_id) AS a, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
    posts AS MATERIALIZED (SELECT a, n, unnest(s) AS x FROM classes),
    links AS MATERIALIZED (SELECT p.a AS a, q.a AS b FROM posts p JOIN posts q ON p.x = q.x AND p.a < q.a GROUP BY p.a, q.a, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
    ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT a, a FROM classes UNION SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b),
    roots AS MATERIALIZED (SELECT a, min(b) AS root FROM reach GROUP BY a)
    SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
    FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN roots ON roots.a = classes.a"""

#: Every 400-byte string by its digest; starts within reach of one another make one removed run.
REPEATED_BYTES = """WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    strings AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM bytes)),
    starts AS (SELECT doc_id, p FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
    marked AS (SELECT *, coalesce(p > lag(p) OVER w + 400, true) AS fresh FROM starts WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
    numbered AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
    runs AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM numbered GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM runs),
    ends AS (SELECT doc_id, coalesce(max(z), 0) AS a, length(h) // 2 AS z FROM bytes LEFT JOIN runs USING (doc_id) GROUP BY doc_id, h),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a, g.z) AS k FROM bytes JOIN (FROM gaps UNION ALL FROM ends) g USING (doc_id) GROUP BY doc_id),
    sums AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM bytes JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""

ORACLES: dict[str, str] = {"op4_suffix_array_dedup": REPEATED_BYTES, "op8_minhash_near_dedup": NEAR_DUPLICATES}
