"""DuckDB SQL for the queries that SQL can express."""

# The golden ratio less 1, times 2^20 and by itself: their fractional parts.
GOLDEN = (0.607787409740351, 0.6180339887498949)
LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz')"
)


def _centroids(rounds: int) -> str:
    """Assignments and means, round after round."""
    near = """
        n{0} AS MATERIALIZED (
            SELECT vec_id, v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
            FROM (SELECT vec_id, whole.v, cluster, list_sum(list_transform(
                      list_zip(whole.v, c{0}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
                  FROM whole CROSS JOIN c{0})
            GROUP BY vec_id, v
        )"""
    mean = """
        m{0} AS (
            SELECT cluster, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
            FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM n{0})
            GROUP BY cluster, place
        ), c{1} AS MATERIALIZED (
            SELECT c{0}.cluster, coalesce(new.v, c{0}.v) AS v FROM c{0} LEFT JOIN (
                SELECT cluster, list(x ORDER BY place) AS v FROM m{0} GROUP BY cluster
            ) new ON new.cluster = c{0}.cluster
        )"""
    steps = [step for r in range(rounds) for step in (near.format(r), mean.format(r, r + 1))]
    steps.append(near.format(rounds))
    return f"""
        WITH whole AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, v
            FROM whole ORDER BY sha256('3:' || vec_id) LIMIT 8
        ), {", ".join(steps)}
        SELECT vec_id, n.cluster::INTEGER AS cluster, distance,
               (sum(distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM n{rounds} n JOIN c{rounds} c ON n.cluster = c.cluster
    """


ORACLE = {
    "op4_mixing": rf"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS place,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), n AS (
            SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1)::INTEGER AS number
            FROM s
        ), w AS (
            SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][number % 3 + 1] AS weight,
                   source_size * 2 AS lim
            FROM n
        ), r AS (
            SELECT *, lim / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS whole,
                   sum(weight) OVER () AS all_weights
            FROM w
        ), v AS (
            SELECT *, (whole - coalesce(sum(lim) OVER f, 0))
                      / (all_weights - coalesce(sum(weight) OVER f, 0)) AS level
            FROM r
            WINDOW f AS (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, source_size, number,
                   least(lim::DOUBLE, max(level) OVER () * weight) AS target
            FROM v
        ), p AS (
            SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
                   (sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id
                                    ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        , shares AS (
            SELECT source, number, round(target)::BIGINT AS words,
                   ceil(round(target) / 4096)::BIGINT AS blocks,
                   sum(round(target)) OVER () AS all_words,
                   (sum(ceil(round(target) / 4096)) OVER ())::BIGINT AS slots,
                   count(*) OVER () AS sources,
                   coalesce(sum(round(target)) OVER (ORDER BY number
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM t WHERE round(target) > 0
        ), points AS (
            SELECT slot, x - floor(x) AS point FROM (
                SELECT slot, (slot >> 20) * {GOLDEN[0]!r}::DOUBLE
                             + (slot & 1048575) * {GOLDEN[1]!r}::DOUBLE AS x
                FROM (SELECT unnest(range((SELECT max(slots) FROM shares))) AS slot))
        ), ranked AS (
            SELECT source, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS block
            FROM points JOIN shares
            ON start / all_words <= point AND point < (start + words) / all_words
        ), had AS (
            SELECT s.*, (SELECT count(*) FROM ranked r
                         WHERE r.source IS NOT DISTINCT FROM s.source) AS had FROM shares s
        ), given AS (
            SELECT r.source, r.block, r.slot FROM ranked r JOIN shares s
            ON r.source IS NOT DISTINCT FROM s.source AND r.block < s.blocks
            UNION ALL
            SELECT source, block, slots + number + (block - had) * sources
            FROM (SELECT *, unnest(range(had, blocks)) AS block FROM had WHERE had < blocks)
        ), amounts AS (
            SELECT *, (greatest(0, least(size, words - pos))
                       + greatest(0, least(size, words - pos - source_size)))::BIGINT AS taken
            FROM p
        )
        SELECT doc_id, size::BIGINT AS size, source_size, target, taken,
               given.slot::BIGINT AS first_slot
        FROM amounts LEFT JOIN given
        ON taken > 0 AND amounts.source IS NOT DISTINCT FROM given.source
           AND given.block = pos // 4096
    """,
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS body FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM d
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes
            FROM pages
        ), k AS (
            SELECT *, max(page_id) OVER (PARTITION BY body) AS holder FROM p
        )
        SELECT page_id, bytes AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN bytes >= 1000 AND page_id <> holder
                    THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM k
    """,
    "op11_periods": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)
                       AS digits
            FROM documents
        ), h AS (
            SELECT *, len(w) AS n, xor(4294967295, list_reduce(digits, lambda crc, digit:
                list_reduce(range(8), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384),
                            xor(crc, digit)), 4294967295)) AS h
            FROM d
        ), planted AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
                       list_transform(range(n), lambda i: w[1 + CASE WHEN i < h // 10 % n THEN i
                           ELSE h // 10 % n + (i - h // 10 % n)
                                % (1 + (n - h // 10 % n) // (3 + h // 10 % 8)) END])
                   ELSE w END AS w
            FROM h
        ), words AS (
            SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted
        ), grams AS (
            SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
                                           lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
            QUALIFY i <= n - 5
        ), seeds AS (
            SELECT a.doc_id, a.i, b.i - a.i AS period
            FROM grams a JOIN grams b
            ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
        ), placed AS (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS stretch
            FROM seeds
        ), stretches AS (
            SELECT doc_id, period, min(i) AS start, count(*) + 4 + period AS length
            FROM placed GROUP BY doc_id, period, stretch
            HAVING count(*) + 4 + period >= greatest(6, 4 * period)
        ), found AS (
            SELECT * FROM stretches r WHERE NOT EXISTS (
                SELECT 1 FROM stretches s
                WHERE s.doc_id = r.doc_id AND s.period < r.period AND r.period % s.period = 0
                  AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
        ), best AS (
            SELECT * FROM found
            QUALIFY row_number() OVER (PARTITION BY doc_id
                                       ORDER BY length::DOUBLE / period DESC, start, period) = 1
        ), lists AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(
                start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM found GROUP BY doc_id
        ), dropped AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found
        ), kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS body
            FROM words ANTI JOIN dropped ON words.doc_id = dropped.doc_id AND words.i = dropped.i
            GROUP BY words.doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start,
               length::BIGINT AS length, period::BIGINT AS period,
               (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op13_centroids": _centroids(rounds=10),
}
