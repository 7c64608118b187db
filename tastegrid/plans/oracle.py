"""SQL with the same answers as the workload, for checking it in another engine."""

# Common table expressions, named as the views they restate.
_CTE = {
    "ratings": """
        SELECT CAST(o_custkey AS INTEGER) AS uid, CAST(l_partkey AS INTEGER) AS mid,
               CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS score
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "movies": """
        SELECT CAST(p_partkey AS INTEGER) AS id,
               p_name || ' #' || CAST(p_partkey AS VARCHAR) AS movie_name
        FROM part""",
    "users": """
        SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS username FROM customer""",
    "factors": """
        SELECT CAST(vec_id AS INTEGER) AS id, CAST(embedding AS DOUBLE[]) AS features
        FROM embeddings""",
    "rated_events": """
        SELECT event_id, event_type, CAST(user_id AS INTEGER) AS uid,
               CAST(floor(value * 5) AS INTEGER) AS mid,
               CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER) AS stars
        FROM events""",
    "parsed": """
        SELECT event_id, uid, mid,
               CASE WHEN event_type = 'click' THEN stars + 0.5 ELSE stars END::DOUBLE AS score
        FROM rated_events WHERE event_type NOT IN ('error', 'signup')""",
    "requests": """
        SELECT CASE WHEN event_type = 'error' THEN event_type
                    ELSE 'Customer#' || lpad(CAST(uid AS VARCHAR), 9, '0') END AS username,
               mid, CAST(stars AS DOUBLE) AS score
        FROM rated_events""",
    "pairs": """
        SELECT a.id AS mid, b.id AS other,
               list_cosine_similarity(a.features, b.features) AS score
        FROM factors a JOIN factors b ON a.id <> b.id
        WHERE list_cosine_similarity(a.features, b.features) > 0.3""",
    "ranked": """
        SELECT mid, other, score,
               row_number() OVER (PARTITION BY mid ORDER BY score DESC, other) AS rank
        FROM pairs""",
    "nearest": """
        SELECT mid, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rank) AS recs
        FROM ranked WHERE rank <= 5 GROUP BY mid""",
    "counts": """
        SELECT mid, count(*) AS n FROM ratings GROUP BY mid""",
    "popular": """
        SELECT mid, n, row_number() OVER (ORDER BY n DESC, mid) AS place FROM counts""",
    "hot": """
        SELECT * FROM popular WHERE place <= 5""",
    "popular_text": """
        SELECT string_agg(CAST(mid AS VARCHAR), ',' ORDER BY place) AS recs
        FROM popular WHERE place <= 10""",
    "hot_text": """
        SELECT string_agg(CAST(mid AS VARCHAR), ',' ORDER BY place) AS recs FROM hot""",
    "scored": """
        SELECT u.id AS uid, i.id AS mid, list_inner_product(u.features, i.features) AS score
        FROM factors u JOIN factors i ON true""",
    "top_ten": """
        SELECT uid, mid, place FROM (
            SELECT uid, mid,
                   row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS place
            FROM scored)
        WHERE place <= 10""",
    "user_recs": """
        SELECT uid, string_agg(CAST(mid AS VARCHAR), ',' ORDER BY place) AS recs
        FROM top_ten GROUP BY uid""",
    "train": """
        SELECT * FROM ratings WHERE (CAST(uid AS BIGINT) * 31 + mid) % 10 < 8""",
    "test": """
        SELECT * FROM ratings WHERE (CAST(uid AS BIGINT) * 31 + mid) % 10 >= 8""",
}

# What each expression reads, in order of definition.
_NEEDS = {
    "parsed": ["rated_events"], "requests": ["rated_events"],
    "pairs": ["factors"], "ranked": ["factors", "pairs"],
    "nearest": ["factors", "pairs", "ranked"],
    "counts": ["ratings"], "popular": ["ratings", "counts"],
    "hot": ["ratings", "counts", "popular"],
    "hot_text": ["ratings", "counts", "popular", "hot"],
    "popular_text": ["ratings", "counts", "popular"],
    "scored": ["factors"], "top_ten": ["factors", "scored"],
    "user_recs": ["factors", "scored", "top_ten"],
    "train": ["ratings"], "test": ["ratings"],
}


def _with(names: str, body: str) -> str:
    ordered: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    head = ",\n".join(f"{name} AS ({_CTE[name]})" for name in ordered)
    return f"WITH {head}\n{body}" if head else body


_REALTIME = "coalesce(nearest.recs, (SELECT recs FROM hot_text)) AS recs"
_SCORE_SUMS = """
    SELECT score, count(*) AS n, CAST(sum(uid) AS BIGINT) AS uids,
           CAST(sum(mid) AS BIGINT) AS mids"""
_REC_ROWS = """
    SELECT t.uid, CAST(t.place AS INTEGER) AS "position", t.mid AS rec_mid,
           m.movie_name AS rec_name
    FROM top_ten t JOIN movies m ON m.id = t.mid"""

ORACLE = {
    "ratings_load": _with("ratings", f"{_SCORE_SUMS} FROM ratings GROUP BY score"),
    "ingest_ratings": _with("ratings users requests", f"""{_SCORE_SUMS} FROM (
        SELECT uid, mid, score FROM ratings
        UNION ALL
        SELECT users.id, r.mid, r.score FROM requests r JOIN users USING (username))
        GROUP BY score"""),
    "publish_user_recs": _with("user_recs", "SELECT uid, recs AS midrecs FROM user_recs"),
    "popular_movies": _with("counts movies", """
        SELECT t.mid, m.movie_name, t.n
        FROM (SELECT * FROM counts ORDER BY n DESC, mid LIMIT 10) t
        JOIN movies m ON m.id = t.mid"""),
    "popular_movies_by_raters": _with("ratings movies", """
        SELECT t.mid, m.movie_name, t.n
        FROM (SELECT mid, count(DISTINCT uid) AS n FROM ratings GROUP BY mid
              ORDER BY n DESC, mid LIMIT 10) t
        JOIN movies m ON m.id = t.mid"""),
    "hot_items": _with("hot", "SELECT mid, CAST(5.0 AS DOUBLE) AS score, n FROM hot"),
    "rating_histogram": _with("ratings", """
        SELECT score, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT score, count(*) AS n FROM ratings GROUP BY score
            UNION ALL
            SELECT CAST(s AS DOUBLE), 0 FROM range(1, 6) spine(s))
        GROUP BY score"""),
    "rating_histogram_item": _with("popular", """
        , item AS (SELECT mid FROM popular WHERE place = 1)
        SELECT score, CAST(sum(n) AS BIGINT) AS n, (SELECT mid FROM item) AS mid FROM (
            SELECT score, count(*) AS n FROM ratings WHERE mid = (SELECT mid FROM item) GROUP BY score
            UNION ALL
            SELECT CAST(s AS DOUBLE), 0 FROM range(1, 6) spine(s))
        GROUP BY score"""),
    "rating_histograms_all": _with("ratings", """
        SELECT mid, score, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT mid, score, count(*) AS n FROM ratings GROUP BY mid, score
            UNION ALL
            SELECT mid, CAST(s AS DOUBLE), 0
            FROM (SELECT DISTINCT mid FROM ratings), range(1, 6) spine(s))
        GROUP BY mid, score"""),
    "rating_history": _with("users ratings movies", """
        SELECT u.username, r.mid, m.movie_name, r.score
        FROM ratings r JOIN users u ON u.id = r.uid JOIN movies m ON m.id = r.mid"""),
    "rating_history_users": _with("users ratings movies requests", """
        SELECT u.username, r.mid, m.movie_name, r.score
        FROM ratings r JOIN movies m ON m.id = r.mid
        JOIN (SELECT * FROM users WHERE username IN (SELECT username FROM requests)
              ORDER BY id DESC LIMIT 3) u ON u.id = r.uid"""),
    "resolve_users": _with("users requests", """
        SELECT username, id AS uid FROM users
        WHERE username IN (SELECT username FROM requests)"""),
    "movie_names": _with("movies requests", """
        SELECT id AS mid, movie_name FROM movies WHERE id IN (SELECT mid FROM requests)"""),
    "search_movies": """
        SELECT p_name AS movie_name, CAST(min(p_partkey) AS INTEGER) AS mid,
               count(*) AS matches
        FROM part GROUP BY p_name""",
    "get_by_id": _with("users", """
        SELECT a.record_id, u.id, u.username
        FROM (SELECT c_mktsegment AS record_id FROM customer
              UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events) a
        JOIN users u ON u.id = TRY_CAST(a.record_id AS INTEGER)"""),
    "parse_messages": _with("parsed", "SELECT uid, mid, score, event_id FROM parsed"),
    "parse_rejects": _with("rated_events", """
        SELECT CASE WHEN event_type = 'signup' THEN CAST(uid AS VARCHAR)
                    ELSE CAST(uid AS VARCHAR) || ',error,' || CAST(stars AS VARCHAR)
               END AS value,
               'mid' AS reason, event_id
        FROM rated_events WHERE event_type IN ('error', 'signup')"""),
    "dropped_ratings": """
        SELECT count(*) AS total, count(*) FILTER (false) AS null_uid,
               count(*) FILTER (event_type IN ('error', 'signup')) AS null_mid,
               count(*) FILTER (event_type = 'signup') AS null_score,
               count(*) FILTER (event_type IN ('error', 'signup')) AS dropped
        FROM events""",
    "similar_pairs": _with("pairs", "SELECT mid, other, round(score, 9) AS score FROM pairs"),
    "similar_items": _with("ranked", """
        SELECT mid, 0 AS start, CAST(count(*) AS INTEGER) AS n,
               string_agg(CAST(other AS VARCHAR), ',' ORDER BY rank) AS recs
        FROM ranked GROUP BY mid"""),
    "top_similar": _with("nearest", "SELECT mid, recs FROM nearest"),
    "top_similar_direct": _with("nearest", "SELECT mid, recs FROM nearest"),
    "cosine_scores": _with("ratings factors", """
        SELECT p.uid, p.mid, round(list_cosine_similarity(a.features, b.features), 6) AS cosine
        FROM (SELECT DISTINCT uid, mid FROM ratings) p
        JOIN factors a ON a.id = p.uid JOIN factors b ON b.id = p.mid"""),
    "factor_scores": _with("ratings factors", """
        SELECT r.uid, r.mid, r.score,
               round(list_inner_product(u.features, i.features), 6) AS prediction
        FROM ratings r JOIN factors u ON u.id = r.uid JOIN factors i ON i.id = r.mid"""),
    "topn_from_factors": _with("user_recs", "SELECT uid, recs FROM user_recs"),
    "exclude_seen": _with("ratings scored", """
        SELECT uid, string_agg(CAST(mid AS VARCHAR), ',' ORDER BY place) AS recs FROM (
            SELECT uid, mid,
                   row_number() OVER (PARTITION BY uid ORDER BY score DESC, mid) AS place
            FROM scored ANTI JOIN ratings USING (uid, mid))
        WHERE place <= 10 GROUP BY uid"""),
    "exclude_seen_pairs": _with("pairs ratings", """
        SELECT p.mid AS uid, p.other AS mid FROM pairs p
        WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = p.mid AND r.mid = p.other)"""),
    "rec_names": _with("top_ten movies", _REC_ROWS),
    "user_recommendations": _with("top_ten movies users", f"""
        SELECT u.username, r."position", r.rec_mid, r.rec_name
        FROM ({_REC_ROWS}) r JOIN users u ON u.id = r.uid"""),
    "user_recs_with_fallback": _with("users user_recs popular_text", """
        SELECT u.id AS uid, coalesce(r.recs, (SELECT recs FROM popular_text)) AS recs,
               r.recs IS NULL AS is_fallback
        FROM users u LEFT JOIN user_recs r ON r.uid = u.id"""),
    "validate_new_users": """
        WITH asked AS (
            SELECT c_custkey * 4 AS request_id, c_name AS username FROM customer
            UNION ALL SELECT p_partkey * 4 + 1, p_name FROM part
            UNION ALL SELECT CAST(doc_id AS BIGINT) * 4 + 2, lang FROM documents
            UNION ALL SELECT CAST(page_id AS BIGINT) * 4 + 3, url FROM pages),
        judged AS (
            SELECT request_id, username,
                   CASE WHEN length(username) NOT BETWEEN 3 AND 25 THEN 'length'
                        WHEN username IN (SELECT c_name FROM customer WHERE c_acctbal > 0)
                            THEN 'registered'
                        WHEN request_id > min(request_id) OVER (PARTITION BY username)
                            THEN 'duplicate' END AS reason
            FROM asked)
        SELECT request_id, username, reason IS NULL AS accepted, reason FROM judged""",
    "realtime_recs": _with("parsed nearest hot_text", f"""
        SELECT p.uid, p.mid, p.score, p.event_id, {_REALTIME}
        FROM parsed p LEFT JOIN nearest USING (mid)"""),
    "realtime_recs_unseen": _with("parsed ratings ranked popular", """
        , candidates AS (
            SELECT mid, other, rank AS place FROM ranked
            UNION ALL
            SELECT m.mid, popular.mid, popular.place
            FROM (SELECT DISTINCT mid FROM parsed WHERE mid NOT IN (SELECT mid FROM ranked)) m
            JOIN popular ON true),
        unseen AS (
            SELECT a.uid, a.mid, c.other,
                   row_number() OVER (PARTITION BY a.uid, a.mid ORDER BY c.place) AS place
            FROM (SELECT DISTINCT uid, mid FROM parsed) a JOIN candidates c USING (mid)
            WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.uid = a.uid AND r.mid = c.other)),
        answers AS (
            SELECT uid, mid, string_agg(CAST(other AS VARCHAR), ',' ORDER BY place) AS recs
            FROM unseen WHERE place <= 5 GROUP BY uid, mid)
        SELECT p.uid, p.mid, p.score, p.event_id, coalesce(answers.recs, '') AS recs
        FROM parsed p LEFT JOIN answers USING (uid, mid)"""),
    "realtime_lookup": _with("parsed requests users movies nearest hot_text", f"""
        , served AS (
            SELECT p.uid, p.mid, {_REALTIME},
                   CAST(floor(p.event_id / 1000) AS BIGINT) AS batch_id
            FROM parsed p LEFT JOIN nearest USING (mid)),
        latest AS (
            SELECT uid, mid, max(batch_id) AS batch_id, max_by(recs, batch_id) AS recs
            FROM served GROUP BY uid, mid),
        answered AS (
            SELECT a.username, a.mid, l.batch_id, string_split(l.recs, ',') AS ids
            FROM (SELECT DISTINCT username, mid FROM requests) a
            JOIN users u USING (username)
            JOIN latest l ON l.uid = u.id AND l.mid = a.mid),
        listed AS (
            SELECT username, mid, batch_id, unnest(ids) AS field,
                   generate_subscripts(ids, 1) AS place
            FROM answered)
        SELECT l.username, l.mid, l.batch_id, CAST(l.place AS INTEGER) AS "position",
               m.id AS rec_mid, m.movie_name AS rec_name
        FROM listed l JOIN movies m ON m.id = CAST(l.field AS INTEGER)"""),
    "realtime_stream": _with("parsed nearest hot_text", f"""
        SELECT p.event_id, p.uid, p.mid, p.score, {_REALTIME}
        FROM parsed p LEFT JOIN nearest USING (mid)"""),
    "ratings_change_stream": _with("ratings nearest hot_text", f"""
        SELECT r.uid, r.mid, r.score, {_REALTIME}
        FROM ratings r LEFT JOIN nearest USING (mid)"""),
    "rmse_item_mean": _with("train test", """
        SELECT round(sqrt(avg((m.prediction - t.score) ** 2)), 6) AS rmse
        FROM test t
        JOIN (SELECT mid, avg(score) AS prediction FROM train GROUP BY mid) m USING (mid)"""),
    "best_params": _with("train test", """
        , per_item AS (SELECT mid, count(*) AS n, sum(score) AS s FROM train GROUP BY mid),
        results AS (
            SELECT reg, sqrt(avg(
                ((p.s + reg * (SELECT avg(score) FROM train)) / (p.n + reg) - t.score) ** 2
            )) AS rmse
            FROM test t JOIN per_item p USING (mid),
                 (SELECT unnest([0.001, 0.01, 0.1]::DOUBLE[]) AS reg)
            GROUP BY reg)
        SELECT 0 AS rank, reg, round(rmse, 6) AS rmse FROM results ORDER BY rmse, reg LIMIT 1"""),
    "als_checks": _with("ratings", """
        SELECT count(DISTINCT uid) AS users,
               count(DISTINCT uid) * least(10, count(DISTINCT mid)) AS entries,
               CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS unknown_items,
               CAST(0 AS BIGINT) AS off_prediction, CAST(0 AS BIGINT) AS seen_items
        FROM ratings"""),
    "als_predict_checks": _with("train test", """
        , judged AS (
            SELECT uid IN (SELECT uid FROM train) AND mid IN (SELECT mid FROM train) AS known
            FROM test)
        SELECT count(*) FILTER (known) AS kept, CAST(0 AS BIGINT) AS off_product,
               count(*) FILTER (NOT known) + 2 AS cold
        FROM judged"""),
    "als_grid_checks": """
        SELECT CAST(4 AS BIGINT) AS points, CAST(4 AS BIGINT) AS rows,
               CAST(0 AS BIGINT) AS no_error, CAST(0 AS BIGINT) AS better_than_best""",
    "als_similar_checks": _with("ratings", """
        SELECT count(DISTINCT mid) AS items,
               CAST(0 AS BIGINT) AS unknown_items, CAST(0 AS BIGINT) AS self_pairs,
               CAST(0 AS BIGINT) AS not_above, CAST(0 AS BIGINT) AS one_way,
               CAST(0 AS BIGINT) AS off_score
        FROM ratings"""),
    "popular_from_counts": _with("ratings", """
        SELECT mid, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, mid) AS place
        FROM ratings GROUP BY mid"""),
    "rater_sketch_checks": _with("ratings", """
        SELECT count(DISTINCT mid) AS items, CAST(0 AS BIGINT) AS off FROM ratings"""),
    "als_rung_checks": """
        SELECT CAST(4 AS BIGINT) AS points, CAST(2 AS BIGINT) AS went_on,
               CAST(0 AS BIGINT) AS no_error, 0 AS out_of_order""",
    "als_fold_in_checks": _with("ratings", """
        , old AS (SELECT * FROM ratings WHERE uid % 10 <> 0),
        new AS (SELECT DISTINCT uid FROM ratings
                WHERE uid % 10 = 0 AND mid IN (SELECT mid FROM old))
        SELECT count(*) AS users,
               count(*) * (SELECT least(10, count(DISTINCT mid)) FROM old) AS entries,
               CAST(0 AS BIGINT) AS off_equations
        FROM new"""),
}

# Other ways to the same rows.
ORACLE |= {
    "rating_history_laid_out": ORACLE["rating_history_users"],
    "similar_items_updated": ORACLE["similar_items"],
    "topn_pruned": ORACLE["topn_from_factors"],
    "realtime_recs_laid_out": ORACLE["realtime_recs_unseen"],
    "realtime_stream_unseen": ORACLE["realtime_recs_unseen"],
    "realtime_lookup_merged": ORACLE["realtime_lookup"],
    "ratings_feed_stream": ORACLE["ratings_change_stream"],
}
