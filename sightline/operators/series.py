"""Trailing windows, streaks, pairings, token sets and mesh keys."""

PLANS = {
    "percentile_linear": """SELECT event_type, round(@PCT(value, 0.02), 6) AS p2, round(@PCT(value, 0.95), 6) AS p95, round(@PCT(value, 0.98), 6) AS p98, round(@PCT(value, 0.99), 6) AS p99 FROM {events} GROUP BY event_type""",
    "ocr_confidence": "SELECT user_id, round(avg(value), 6) AS mean_confidence, min(value) AS min_confidence FROM {events} GROUP BY user_id",
    "trailing_median": "SELECT event_id, round(@PCT(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS med FROM {events}",
    "ratio_up": "SELECT event_id, CASE WHEN value <= 0 THEN CAST('Infinity' AS DOUBLE) WHEN value >= 1 THEN value ELSE @ROUND6(1 / value) END AS ratio FROM {events}",
    "tail_limit": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {events}) x WHERE k <= 3",
    "bounded_rows": """SELECT user_id, count_if(k <= 5) AS shown, count_if(k > 5) AS omitted FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}) x GROUP BY user_id""",
    "trailing_prune": "SELECT user_id, event_id FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS newest FROM {events}) x WHERE event_id > newest - 500",
    "ocr_fold": """WITH w AS (SELECT DISTINCT @UNNEST(@TOKENS(text)) AS token FROM {benchmark}), m AS (SELECT token, replace(replace(replace(token, 'rn', 'm'), 'vv', 'w'), 'ii', 'u') AS f FROM w)
        SELECT token, CASE WHEN upper(f) <> f THEN replace(replace(f, '0', 'o'), '1', 'l') ELSE f END AS folded FROM m""",
    "within_one_edit": """SELECT token, before, levenshtein(token, before) <= 1 AS near FROM (SELECT token, lag(token) OVER (PARTITION BY substr(token, 1, 1) ORDER BY token) AS before FROM
        (SELECT DISTINCT @UNNEST(@TOKENS(text)) AS token FROM {benchmark}) w) x WHERE before IS NOT NULL""",
}
