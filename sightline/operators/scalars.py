"""Set plans."""
PLANS = {
    "index_union": "SELECT user_id AS key FROM {events} UNION SELECT o_custkey FROM {orders} UNION SELECT c_custkey FROM {customer}",
}
