"""Sessionization, sightings, gaps, lineage and other ordered plans."""
GAP = 3600 * 1000000 * 6

_EV = "ev AS (SELECT user_id, event_id, event_type, value, value / 500 AS score, @MICROS(ts) AS t_us FROM {events})"
#: A new sighting starts when the gap is greater than GAP; equality extends.
_ISLANDS = f"""WITH {_EV},
g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id, event_type ORDER BY t_us, event_id) <= CAST({GAP} AS BIGINT) THEN 0 ELSE 1 END AS fresh FROM ev),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM g),
f AS (SELECT user_id, event_type, session, count(*) AS frame_count, min(t_us) AS first_at, max(t_us) AS last_at, max(score) AS best_score, min(event_id) AS first_seq FROM s GROUP BY user_id, event_type, session)"""

PLANS = {
    "sighting_sessions": f"{_ISLANDS} SELECT user_id, event_type, session, frame_count, first_at, last_at FROM f",
    "sighting_fold": f"""{_ISLANDS}, best AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY score DESC, t_us, event_id) AS k FROM s)
        SELECT f.user_id, f.event_type, f.session, frame_count, best_score, event_id AS best_seq, best.t_us AS best_at, last_at - first_at AS duration FROM f JOIN best
        ON f.user_id = best.user_id AND f.event_type = best.event_type AND f.session = best.session AND k = 1""",
    "mature_sightings": f"{_ISLANDS} SELECT user_id, event_type, session, frame_count FROM f WHERE frame_count >= 3",
    "seq_gap_total": """SELECT l_orderkey, CAST(sum(greatest(gap, 0)) AS BIGINT) AS seq_gap_total FROM (SELECT l_orderkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS gap FROM {lineitem}) x GROUP BY l_orderkey""",
    "tx_gap_total": """WITH t AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_id END AS tx FROM {events}),
        g AS (SELECT user_id, tx, tx - lag(tx) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gap FROM t WHERE tx IS NOT NULL)
        SELECT t.user_id, x.total AS tx_gap_total FROM (SELECT DISTINCT user_id FROM t) t LEFT JOIN (SELECT user_id, CAST(coalesce(sum(greatest(gap, 0)), 0) AS BIGINT) AS total FROM g GROUP BY user_id) x ON t.user_id = x.user_id""",
    "upstream_rate": """WITH e AS (SELECT user_id, count(*) AS n, min_by(event_id, event_id) AS a, max_by(event_id, event_id) AS b, min(@MICROS(ts)) AS t0, max(@MICROS(ts)) AS t1 FROM {events} GROUP BY user_id)
        SELECT user_id, CASE WHEN n >= 2 AND b > a THEN round((b - a) / (n - 1), 6) END AS stride, CASE WHEN n >= 2 AND b > a AND t1 > t0 THEN round((b - a) / ((t1 - t0) / 1000000), 6) END AS fps FROM e""",
    "rolling_median_ratio": """SELECT event_id, round(value / nullif(med, 0), 6) AS ratio FROM (SELECT event_id, value, @PCT(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS med FROM {events}) x""",
    "vote_2_of_3": """SELECT event_id, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS BOOLEAN) AS agreed FROM {events}""",
    "corpus_scan_limit": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}) x WHERE k <= 5",
    "newest_wins": "SELECT event_type, max_by(event_id, event_id) AS newest, count(*) - 1 AS coalesced FROM {events} GROUP BY event_type",
    "change_feed": """SELECT event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}) x WHERE before IS NULL OR before <> event_type""",
}
