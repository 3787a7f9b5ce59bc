"""Lists and identity of documents."""
PLANS = {
    "recent_documents": "SELECT doc_id, source FROM {documents} ORDER BY doc_id DESC LIMIT 10",
    "exact_identity": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {documents} GROUP BY md5(coalesce(text, ''))",
    "dialogue_turns": "SELECT conv_id, count(*) AS turns, max_by(role, turn) AS last_role FROM {conversations} GROUP BY conv_id",
}
