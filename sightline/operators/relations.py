"""Joins, aggregates and windows over frames, points, segments and worlds."""
#: Objects of a frame: the lines of an order, numbered.
_OBJ = "o AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_partkey AS x, l_suppkey AS y, l_quantity AS w, l_quantity / 2 AS h FROM {lineitem})"
#: A point's owner: its first frame, that frame's segment (customer) and component (nation).
_OWN = "own AS (SELECT l_partkey AS point, min(l_orderkey) AS frame FROM {lineitem} GROUP BY l_partkey), seg AS (SELECT point, frame, o_custkey AS segment, c_nationkey AS component FROM own JOIN {orders} ON frame = o_orderkey JOIN {customer} ON o_custkey = c_custkey)"
_W = "PARTITION BY user_id ORDER BY event_id"
_STREAK = f"e AS (SELECT user_id, event_id, value, CASE WHEN value < 60 THEN 1 ELSE 0 END AS low FROM {{events}}), s AS (SELECT *, CASE WHEN sum(low) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN 1 ELSE 0 END AS lost FROM e), b AS (SELECT *, CASE WHEN lost = 1 AND coalesce(lag(lost) OVER ({_W}), 0) = 0 THEN 1 ELSE 0 END AS cut FROM s)"

PLANS = {
    # joins
    "component_majority": f"WITH {_OWN}, n AS (SELECT segment, component, count(*) AS points FROM seg GROUP BY segment, component) SELECT component, segment AS anchor, points FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY points DESC, segment) AS k FROM n) x WHERE k = 1",
    "publish_remap": "WITH s AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS new_index FROM {part} WHERE p_size >= 5) SELECT l_orderkey, l_linenumber, l_partkey, p_brand, new_index FROM {lineitem} JOIN s ON l_partkey = p_partkey",
    # aggregates
    "selection_coverage": "SELECT round(count_if(n >= 1) / count(*), 4) AS once, round(count_if(n >= 2) / count(*), 4) AS twice FROM (SELECT p_partkey, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS n FROM {part} LEFT JOIN {lineitem} ON p_partkey = l_partkey GROUP BY p_partkey) x",
    "confidence_refresh": "SELECT user_id, event_type, max(value) / 500 AS best_score, CASE WHEN max(value) IS NULL THEN 'unknown' WHEN max(value) < 250 THEN 'low' WHEN max(value) < 400 THEN 'medium' ELSE 'high' END AS confidence FROM {events} GROUP BY user_id, event_type",
    # windows
    # 0.7 to the power of 110 is below a double's last bit, so rows before the window no longer count.
    "loss_grace": f"WITH {_STREAK} SELECT user_id, event_id FROM b WHERE cut = 1",
    # order and choice
    "viewpoint_sample": "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM {embeddings}) x WHERE n <= 240 OR floor(k * 240 / n) > floor((k - 1) * 240 / n)",
}
