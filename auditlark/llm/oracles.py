"""DuckDB statements of the operators on vectors and words."""

from __future__ import annotations

#: Vectors that can be compared, as doubles.
SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd, its rounds written out one after another: no bounds, every part against every entry."""
    ctes = [
        f"""e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE {SOUND})""",
        f"""p AS MATERIALIZED (SELECT vec_id, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS x FROM e, range({parts}) r(part))""",
        f"""b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c
            FROM p WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * 1000 + entry) % 1000 AS entry, min(d) AS d FROM (
                SELECT vec_id, part, entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
                FROM p JOIN b{r} USING (part)) GROUP BY ALL)"""
        )
        if r < rounds:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
                    SELECT part, entry, list(m ORDER BY i) AS c FROM (
                        SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m
                        FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM p JOIN a{r} USING (vec_id, part)) GROUP BY ALL)
                    GROUP BY ALL) m USING (part, entry))"""
            )
    last = f"a{rounds}"
    return f"""
        WITH {", ".join(ctes)},
        v AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM v JOIN e USING (vec_id)"""


def spelling_sql(least_length: int = 6, least_n: int = 5, slips: int = 199, factor: int = 5) -> str:
    """Near words by strings with one letter taken out; the CRC of each run from its table, byte by byte."""
    byte = "(instr('0123456789ABCDEF', substr(x, 2 * i + {}, 1)) - 1)"
    return rf"""
        WITH RECURSIVE r AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        g AS (SELECT w, count(*) AS k, hex(encode(coalesce(doc_id, '') || ':' || w)) AS x FROM r WHERE length(w) >= {least_length} GROUP BY doc_id, w),
        t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) q(i))),
        b AS (SELECT w, k, list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST(16 * {byte.format(1)} + {byte.format(2)} AS BIGINT))) AS bytes FROM g),
        h AS (SELECT w, k, xor(list_reduce(bytes, lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) AS h FROM b, t),
        s AS (SELECT CASE WHEN h % {slips} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM h),
        d AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(w) >= {least_length} GROUP BY w HAVING sum(k) >= {least_n}),
        o AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM d)),
        p AS (SELECT a.w, b.w AS v, b.n AS m FROM o a JOIN o b ON a.k = b.k AND a.i = b.i AND a.w <> b.w
              UNION SELECT o.w, d.w, d.n FROM o JOIN d ON o.k = d.w UNION SELECT d.w, o.w, o.n FROM o JOIN d ON o.k = d.w),
        c AS (SELECT w, count(*) AS n_near, arg_min({{'v': v, 'm': m}}, {{'k': -m, 'v': v}}) AS f FROM p GROUP BY w),
        f AS (SELECT d.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN f.m >= {factor} * n THEN f.v END AS form, CASE WHEN f.m >= {factor} * n THEN f.m END AS form_n FROM d LEFT JOIN c USING (w)),
        u AS (SELECT w, w AS at FROM f UNION ALL SELECT u.w, f.form FROM u JOIN f ON u.at = f.w WHERE f.form IS NOT NULL)
        SELECT f.w AS word, f.n, f.n_near, f.form, f.form_n, u.at AS root FROM f JOIN u ON u.w = f.w JOIN f z ON z.w = u.at WHERE z.form IS NULL"""


def vector_dedup_sql(least: float = 0.95) -> str:
    """All pairs of sound vectors, links counted, components by reachability."""
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {SOUND} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {least}),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT DISTINCT a AS f, a AS t FROM l UNION SELECT r.f, l.b FROM r JOIN l ON r.t = l.a), c AS (SELECT f, min(t) AS c FROM r GROUP BY f)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON f = vec_id"""
