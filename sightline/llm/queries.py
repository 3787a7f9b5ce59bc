"""The queries opN_<name> and their SQL, each over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import document_sizes, mix

    sizes = Workspace(spark, "op3").keep(document_sizes(table(spark, sf_dir, "documents")))
    return mix(sizes).drop("source")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import strip_repeats

    return strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_table

    out = quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "cutoff", "holdout", "rejected", "chance")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        return f.read(), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    path = Workspace(spark, "op7").root
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, share=85)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs, with_periods

    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs(docs, texts=False).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), texts=False)
    return out.select("doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
hits AS (
  SELECT n, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC) AS k
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN hits ON urls.n = hits.n AND k = 1
"""

OP3 = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight FROM sizes GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
         ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM per),
lvl AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level * weight <= cap),
goals AS (
  SELECT source, source_size, CASE WHEN lvl.level IS NULL OR lvl.level * weight > cap THEN cap::DOUBLE ELSE lvl.level * weight END AS target
  FROM levels, lvl),
starts AS (
  SELECT s.*, g.source_size, g.target, floor(g.target)::BIGINT AS budget, floor(floor(g.target) / greatest(g.source_size, 1))::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY substr(md5(doc_id::VARCHAR), 1, 15), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM starts
"""

OP4 = r"""
WITH w AS (SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT n, doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS k FROM (SELECT n, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 48))) AS s FROM w)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
bad AS (SELECT DISTINCT n, s FROM win JOIN firsts USING (k) WHERE least < doc_id),
words AS (SELECT n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
marked AS (
  SELECT words.n, word, i, max(s) OVER (PARTITION BY words.n ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN bad ON words.n = bad.n AND i = s),
kept AS (SELECT n, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY n)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (n)
"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, r FROM reach JOIN edges ON a = doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0
                      THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT b, r FROM reach JOIN edges ON a = vec_id)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM edges GROUP BY a) USING (vec_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""


_CRC32 = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::BIGINT)))"

_W = "OVER (PARTITION BY n ORDER BY i)"


def _op11(levels: int = 17) -> str:
    """Ids of 5, 10, 20, ... words by doubling. A run of period q is, at the smallest of these lengths that is q or more, a stretch of places whose next occurrence is q away."""
    grams = [f"g0 AS MATERIALIZED (SELECT * FROM (SELECT n, i, md5(w || ' ' || lead(w, 1) {_W} || ' ' || lead(w, 2) {_W} || ' ' || lead(w, 3) {_W} || ' ' || lead(w, 4) {_W}) AS g FROM words) WHERE g IS NOT NULL)"]
    grams += [f"g{j} AS MATERIALIZED (SELECT * FROM (SELECT n, i, md5(g || lead(g, {5 << j - 1}) {_W}) AS g FROM g{j - 1}) WHERE g IS NOT NULL)" for j in range(1, levels)]
    near = [f"SELECT n, i, q, {5 << j} AS k FROM (SELECT n, i, lead(i) OVER (PARTITION BY n, g ORDER BY i) - i AS q FROM g{j}) WHERE q <= {5 << j} AND q > {0 if j == 0 else 5 << j - 1}" for j in range(levels)]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, xor({_CRC32}, 4294967295) AS h FROM documents),
cut AS (
  SELECT n, doc_id, ws, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM d),
per AS (SELECT n, doc_id, ws, a, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM cut),
docs AS (
  SELECT n, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM per),
words AS (SELECT n, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
{", ".join(grams)},
near AS ({" UNION ALL ".join(near)}),
runs AS (
  SELECT n, min(i)::BIGINT AS s, (count(*) + k - 1 + q)::BIGINT AS l, q::BIGINT AS q
  FROM (SELECT *, i - row_number() OVER (PARTITION BY n, k, q ORDER BY i) AS island FROM near) GROUP BY n, k, q, island
  HAVING count(*) + k - 1 + q >= greatest(6, 4 * q)),
best AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY l::DOUBLE / q DESC, s, q) AS k FROM runs),
listed AS (SELECT n, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY n),
gone AS (SELECT DISTINCT n, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT n, string_agg(w, ' ' ORDER BY i) AS txt FROM words ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
       sha256(coalesce(listed.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256, len(ws)::BIGINT AS n_words
FROM docs LEFT JOIN listed USING (n) LEFT JOIN kept USING (n) LEFT JOIN best ON docs.n = best.n AND best.k = 1
"""


def _op12(rounds: int = 10) -> str:
    nearest = "SELECT v.n, arg_min(c, d * 8 + c) AS c, min(d) AS d FROM (SELECT v.n, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, c{0} c) v GROUP BY v.n"
    steps = []
    for t in range(1, rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED ({nearest.format(t - 1)})")
        steps.append(f"""c{t} AS MATERIALIZED (
  SELECT o.c, coalesce(m.e, o.e) AS e FROM c{t - 1} o LEFT JOIN (
    SELECT c, list((s - (s % k + k) % k) // k ORDER BY j)::BIGINT[] AS e
    FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS j FROM a{t} JOIN v USING (n)) GROUP BY c, j) GROUP BY c) m ON o.c = m.c)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(least(greatest(1024 * x::DOUBLE, -134217728), 134217728))::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, n) - 1 AS c, e FROM (SELECT n, e, sha256('3:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, n LIMIT 8)),
{", ".join(steps)},
fin AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, fin.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY fin.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(cs.e, ',')) AS centroid_sha256
FROM fin JOIN v USING (n) JOIN c{rounds} cs ON cs.c = fin.c
"""


def oracle_sql() -> dict:
    from .licenses import _sql

    return {"op8_license_scan": _sql(), "op1_embedding_dedup": OP1, "op2_url_rules": OP2, "op3_source_mix": OP3, "op4_substring_dedup": OP4, "op7_warc": OP7, "op10_minhash_dedup": OP10, "op11_periodic_runs": _op11(), "op12_centroid_clusters": _op12()}
