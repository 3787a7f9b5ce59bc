"""Aggregations, typed metrics, percentiles, fits and reports."""
PLANS = {
    "running_mean_max": "SELECT user_id, count(*) AS n, round(coalesce(avg(value), 0), 6) AS mean, greatest(coalesce(max(value), 0), 0) AS max_value, max_by(value, event_id) AS last_value FROM {events} GROUP BY user_id",
    "p98_core_band": "SELECT event_type, round(@PCT(value, 0.02), 6) AS low, round(@PCT(value, 0.98), 6) AS high FROM {events} GROUP BY event_type",
    "median_family": "SELECT event_type, round(median(value), 6) AS med, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type",
    "mode_first": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS k FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM {events} GROUP BY user_id, event_type) x) y WHERE k = 1",
    "weakest_label": "SELECT source, CASE min(CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 5000 THEN 2 ELSE 3 END) WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS weakest FROM {documents} GROUP BY source",
    "circular_mean": "SELECT event_type, round(sqrt(avg(cos(value)) * avg(cos(value)) + avg(sin(value)) * avg(sin(value))), 6) AS resultant, round(degrees(atan2(avg(sin(value)), avg(cos(value)))), 4) AS direction FROM {events} GROUP BY event_type",
    "entropy_bits": "SELECT round(-sum(p * log2(p)), 6) AS bits FROM (SELECT CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p FROM {events} GROUP BY CAST(floor(value / 10) AS BIGINT)) x",
    "discard_tally": "SELECT count(*) AS total, count_if(l_discount < 0.02) AS low_parallax, count_if(l_tax > 0.06) AS high_error FROM {lineitem}",
}
