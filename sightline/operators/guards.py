"""Filters, gates in their order, projections and lookups."""
PLANS = {
    "class_allowlist_read": "SELECT event_id, event_type FROM {events} WHERE event_type IN ('purchase', 'signup', 'view')",
    "cursor_read": "SELECT event_id, event_type FROM {events} WHERE event_id > 5000",
    "class_precision": "SELECT source, round(sum(quality) / nullif(count(quality), 0), 6) AS score FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source",
    "confidence_buckets": "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'unknown' WHEN value / 500 < 0.02 THEN 'low' WHEN value / 500 < 0.06 THEN 'medium' ELSE 'high' END AS bucket FROM {events}) x GROUP BY bucket",
    "view_side_counts": "SELECT label, side, count(*) AS n FROM (SELECT label, CASE WHEN @AT(1) IS NULL THEN 'unknown' WHEN @AT(1) < -0.05 THEN 'left' WHEN @AT(1) > 0.05 THEN 'right' ELSE 'centre' END AS side FROM {embeddings}) x GROUP BY label, side",
    "json_props_guard": "SELECT event_id, @JSONK AS k, @JSONK IS NOT NULL AS ok FROM {events}",
    "nonempty_partition": "SELECT has, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) > 0 AS has FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) x GROUP BY has",
    "orphan_parts": "SELECT p_partkey FROM {part} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "journal_blob_verify": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'paired' END AS state FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id = l.doc_id",
}
