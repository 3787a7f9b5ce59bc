"""Rules of gates, fits and windows over their own columns, with their limits and nulls; oracles are texts of their own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .finding import shares_of, tokenise
from .tables import DUCK_EVENTS, events, table

#: Fixed value: classes that are never kept, whatever a table says.
EXCLUDED = ("person",)


def _typed(value: Column) -> Column:
    """A variant's number as a double; null for booleans, strings and everything else."""
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def retention_filter(rows: DataFrame, cutoff: float | None) -> DataFrame:
    """rows (recorded_at variant) -> those recorded at the cutoff or later; with no cutoff all; what is no number (true, text, null) is expired."""
    return rows if cutoff is None else rows.where(F.coalesce(_typed(F.col("recorded_at")) >= cutoff, F.lit(False)))


def schema_version_filter(rows: DataFrame, versions: list[int], required: list[str]) -> DataFrame:
    """rows (id, line) of a journal -> id, version, body of those that are JSON objects of a known version with the required fields.

    Lines that can't be read, and versions that aren't whole numbers (true, "1"), are skipped, not fatal.
    """
    r = rows.withColumn("body", F.try_parse_json("line"))
    version = _typed(F.try_variant_get("body", "$.schema_version", "variant"))
    has = [F.try_variant_get("body", f"$.{k}", "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get("body", f"$.{k}", "variant")) != "VOID") for k in required]
    good = version.isin([float(v) for v in versions])
    for h in has:
        good = good & F.coalesce(h, F.lit(False))
    return r.where(F.coalesce(good, F.lit(False))).select("id", version.cast("int").alias("version"), "body")


def class_tier(classes: DataFrame, tiers: DataFrame) -> DataFrame:
    """classes (label), tiers (label, tier, pos) -> label, tier, excluded, pos: `ignored` for unknown ones and, whatever the table says, for excluded ones."""
    t = tiers.select(F.col("label").alias("_l"), F.col("tier").alias("_t"), "pos")
    out = classes.join(t, F.col("label") == F.col("_l"), "left")
    excluded = F.coalesce(F.col("label").isin(*EXCLUDED), F.lit(False))
    return out.select(*classes.columns, F.when(excluded, "ignored").otherwise(F.coalesce("_t", F.lit("ignored"))).alias("tier"), excluded.alias("excluded"), F.when(~excluded, F.col("pos")).alias("pos"))


def classes_in(tiers: DataFrame, tier: str) -> list[str]:
    """A tier's classes in the order they are declared; the table of tiers has a row a class."""
    return [r.label for r in tiers.where((F.col("tier") == tier) & ~F.col("label").isin(*EXCLUDED)).orderBy("pos").select("label").collect()]


def relevance_gate(rows: DataFrame, tiers: DataFrame, allowed: list[str] | None, least: float) -> DataFrame:
    """rows (label, score) -> verdict, the first that holds: excluded, context-only, not-whitelisted, below-min-score (also without a score), record."""
    r = class_tier(rows, tiers)
    outside = F.lit(False) if allowed is None else ~F.coalesce(F.col("label").isin(*allowed), F.lit(False)) if allowed else F.lit(True)
    weak = ~F.coalesce((F.col("score") >= least) & ~F.isnan("score"), F.lit(False))
    verdict = F.when(F.col("excluded"), "excluded").when(F.col("tier") == "context", "context-only").when((F.col("tier") == "ignored") | outside, "not-whitelisted").when(weak, "below-min-score").otherwise("record")
    return r.withColumn("verdict", verdict).drop("excluded", "pos")


def can_testify(readings: DataFrame, words: int = 3, least: float = 0.30) -> DataFrame:
    """readings (id, text, confidence) -> id, testifies: at least `words` tokens of two characters or more, and that confidence; a missing one is 0."""
    n = F.size(F.filter(tokenise(F.col("text")), lambda w: F.length(w) >= 2))
    return readings.select("id", ((n >= words) & (F.coalesce("confidence", F.lit(0.0)) >= least)).alias("testifies"))


# ---- fits and means


def weighted_geomean(rows: DataFrame, floor: float = 0.05) -> DataFrame:
    """rows (g, weight, x) -> g, value: exp of the weighted mean of ln(x clipped to floor..1) over positive weights with an x; 1 where nothing is weighted."""
    used = F.coalesce((F.col("weight") > 0) & F.col("x").isNotNull(), F.lit(False))
    w = F.when(used, F.col("weight"))
    mean = F.sum(w * F.log(F.greatest(F.least("x", F.lit(1.0)), F.lit(floor)))) / F.nullif(F.sum(w), F.lit(0.0))
    return rows.groupBy("g").agg(F.coalesce(F.exp(mean), F.lit(1.0)).alias("value"))


def linear_fit(rows: DataFrame) -> DataFrame:
    """rows (g, x, y) -> slope, intercept, r by least squares; NaN for all three under two rows or if x or y doesn't vary."""
    f = rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), (F.regr_sxy("y", "x") / F.nullif(F.sqrt(F.regr_sxx("y", "x") * F.regr_syy("y", "x")), F.lit(0.0))).alias("r"), (F.min("x") < F.max("x")).alias("_x"), (F.min("y") < F.max("y")).alias("_y"))
    ok = (F.col("n") >= 2) & F.col("_x") & F.col("_y")
    return f.select("g", "n", *(F.when(ok, F.col(c)).otherwise(F.lit(float("nan"))).alias(c) for c in ("slope", "intercept", "r")))


def span_over_depth(cameras: DataFrame, points: DataFrame) -> DataFrame:
    """cameras, points (g, x, y, z) -> g, ratio: the largest distance between cameras over the points' median distance from the
    cameras' centroid; 0 under two cameras, without points or at no depth.

    Both ends of the largest distance D are at least D - R from the centroid, R being the largest distance from it, and D is at
    least the span along any axis; so only cameras that far out are paired.
    """
    c = cameras.select(F.col("g").alias("_g"), *(F.col(k).alias(f"c{k}") for k in "xyz"))
    mid = c.groupBy("_g").agg(F.count("*").alias("n"), *(F.avg(f"c{k}").alias(f"m{k}") for k in "xyz"), F.greatest(*(F.max(f"c{k}") - F.min(f"c{k}") for k in "xyz")).alias("wide"))
    away = lambda a, b: F.sqrt(sum((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in "xyz"))
    out = c.join(mid, "_g").withColumn("far", away("c", "m"))
    rim = out.join(out.groupBy("_g").agg(F.max("far").alias("most")), "_g").where(F.col("far") >= (F.col("wide") - F.col("most")) * (1 - 1e-9)).select("_g", *(f"c{k}" for k in "xyz")).distinct()
    other = rim.select(F.col("_g").alias("_h"), *(F.col(f"c{k}").alias(f"d{k}") for k in "xyz"))
    span = rim.join(other, F.col("_g") == F.col("_h")).groupBy("_g").agg(F.max(away("c", "d")).alias("span"))
    p = points.select(F.col("g").alias("_g"), *(F.col(k).alias(f"p{k}") for k in "xyz")).join(mid, "_g").groupBy("_g").agg(F.median(away("p", "m")).alias("depth"))
    good = (F.col("n") >= 2) & F.coalesce(F.col("depth") > 1e-9, F.lit(False))
    return mid.join(span, "_g").join(p, "_g", "left").select(F.col("_g").alias("g"), F.when(good, F.col("span") / F.col("depth")).otherwise(0.0).alias("ratio"))


# ---- windows


def rolling_median(rows: DataFrame, width: int = 30) -> DataFrame:
    """rows (key, seq, value) -> med: the median of the `width` values before, this one left out; itself where there is none."""
    w = f"PARTITION BY key ORDER BY seq ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING"
    return rows.selectExpr("key", "seq", "value", f"coalesce(percentile(value, 0.5) OVER ({w}), value) AS med")


def estimate_expiry(rows: DataFrame, longest: float = 6.0) -> DataFrame:
    """rows (key, seq, at, state: null where nothing was estimated) -> state, age: of the key's last estimate so far; `unknown` if it is
    older than `longest` or there is none; a clock that goes back gives age 0."""
    w = "PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    r = rows.selectExpr("*", f"last(CASE WHEN state IS NOT NULL THEN named_struct('s', state, 'at', at) END) IGNORE NULLS OVER ({w}) AS e")
    age = F.greatest(F.col("at") - F.col("e.at"), F.lit(0.0))
    return r.select("key", "seq", F.when(F.col("e").isNotNull() & (age <= longest), F.col("e.s")).otherwise("unknown").alias("state"), F.when(F.col("e").isNotNull(), age).alias("age"))


# ---- text, keys, places


def token_shares(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b) -> id, jaccard (shared tokens of the union), contained (of the smaller side); 0 if a side has no token."""
    p = pairs.select("id", F.array_distinct(tokenise(F.col("a"))).alias("a"), F.array_distinct(tokenise(F.col("b"))).alias("b"))
    jaccard, contained = shares_of(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))
    return p.select("id", jaccard.alias("jaccard"), contained.alias("contained"))


def key_formats(rows: DataFrame) -> DataFrame:
    """rows (id, capture, seq) -> id, frame_key `capture:00000042`, file `00000042.jpg`: at least eight digits, never cut; null where a part is."""
    eight = F.when(F.col("seq").isNotNull(), F.format_string("%08d", "seq"))
    return rows.select("id", F.concat(F.col("capture").cast("string"), F.lit(":"), eight).alias("frame_key"), F.concat(eight, F.lit(".jpg")).alias("file"))


def spatial_relations(objects: DataFrame, frames: DataFrame, share: float = 0.08) -> DataFrame:
    """objects (frame, id, x, y: centres of counted tracks), frames (frame, w, h) -> frame, subject, relation, object.

    left_of and right_of of the smaller id from `share` of the width on, higher_in_view of the upper one from `share` of the
    height on; nothing in a frame of unknown size.
    """
    f = frames.where((F.col("w") > 0) & (F.col("h") > 0)).select(F.col("frame").alias("_f"), "w", "h")
    a = objects.join(f, F.col("frame") == F.col("_f")).drop("_f")
    b = objects.select(F.col("frame").alias("_f"), F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    p = a.join(b, (F.col("frame") == F.col("_f")) & (F.col("id") < F.col("other")))
    rel = lambda s, r, o: F.struct(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    me, you = F.col("id"), F.col("other")
    side = F.when(F.abs(F.col("x") - F.col("ox")) >= share * F.col("w"), F.when(F.col("x") < F.col("ox"), rel(me, "left_of", you)).otherwise(rel(me, "right_of", you)))
    above = F.when(F.abs(F.col("y") - F.col("oy")) >= share * F.col("h"), F.when(F.col("y") < F.col("oy"), rel(me, "higher_in_view", you)).otherwise(rel(you, "higher_in_view", me)))
    return p.select("frame", F.explode(F.array_compact(F.array(side, above))).alias("r")).select("frame", "r.*")


# ---- bindings

_TIERS = [("purchase", "remembered", 1), ("signup", "remembered", 2), ("view", "verify", 3), ("click", "context", 4), ("person", "remembered", 5)]


def _tiers(s):
    return s.createDataFrame(_TIERS, "label string, tier string, pos int")


def _labels(s, d):
    return events(s, d).selectExpr("seq", "CASE WHEN seq % 19 = 0 THEN 'person' ELSE label END AS label", "CASE WHEN seq % 7 > 0 THEN score END AS score")


_D_TIERS = "tiers(label, tier) AS (VALUES ('purchase', 'remembered'), ('signup', 'remembered'), ('view', 'verify'), ('click', 'context'))"
_D_LABELS = "ls AS (SELECT event_id AS seq, CASE WHEN event_id % 19 = 0 THEN 'person' ELSE event_type END AS label, CASE WHEN event_id % 7 > 0 THEN value / 500 END AS score FROM events)"
_LINES = """CASE seq % 8 WHEN 0 THEN '{"schema_version": 1, "id": 5}' WHEN 1 THEN '{"schema_version": "1", "id": 5}' WHEN 2 THEN '{"schema_version": tr' WHEN 3 THEN '[1]' WHEN 4 THEN '{"schema_version": true, "id": 5}' WHEN 5 THEN '{"schema_version": 2, "id": null}' WHEN 6 THEN '{"schema_version": 3, "id": 0}' END"""
_R = lambda df, *cs: df.select(*(F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns))
_CENTRES = "l_orderkey AS frame", "l_linenumber AS id", "CAST(l_partkey AS DOUBLE) AS x", "CAST(l_suppkey AS DOUBLE) AS y"
_SHARES = "SELECT conv_id, turn, lag(text) OVER w AS a, text AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"

OPS = {
    "retention_window": (
        lambda s, d: retention_filter(events(s, d).selectExpr("seq AS event_id", "parse_json(CASE seq % 6 WHEN 0 THEN 'true' WHEN 1 THEN '\"9999999999\"' WHEN 2 THEN NULL WHEN 3 THEN 'null' WHEN 4 THEN CAST(t DIV 1000000 AS STRING) ELSE CAST(CAST(t / 1000000 AS DECIMAL(20, 3)) AS STRING) END) AS recorded_at"), 1704672000.0).select("event_id"),
        "SELECT event_id FROM events WHERE event_id % 6 = 4 AND epoch_us(ts) // 1000000 >= 1704672000 OR event_id % 6 = 5 AND round(epoch_us(ts)::DECIMAL(20, 0) / 1000000, 3) >= 1704672000",
    ),
    "schema_version_filter": (
        lambda s, d: schema_version_filter(events(s, d).selectExpr("seq AS id", f"{_LINES} AS line"), [1, 2, 3], ["id"]).select(F.col("id").alias("event_id"), "version"),
        "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 1 ELSE 3 END AS version FROM events WHERE event_id % 8 IN (0, 6)",
    ),
    "class_tier": (
        lambda s, d: class_tier(_labels(s, d).groupBy("label").agg(F.count("*").alias("n")), _tiers(s)).select("label", "tier", "excluded", "n"),
        f"WITH {_D_TIERS}, {_D_LABELS} SELECT l.label, coalesce(tier, 'ignored') AS tier, l.label = 'person' AS excluded, count(*) AS n FROM ls l LEFT JOIN tiers t ON t.label = l.label GROUP BY ALL",
    ),
    "relevance_gate_counts": (
        lambda s, d: relevance_gate(_labels(s, d), _tiers(s), ["purchase", "view"], 0.02).groupBy("verdict").agg(F.count("*").alias("n")),
        f"WITH {_D_LABELS} SELECT CASE WHEN label = 'person' THEN 'excluded' WHEN label = 'click' THEN 'context-only' WHEN label NOT IN ('purchase', 'view') THEN 'not-whitelisted' WHEN score IS NULL OR score < 0.02 THEN 'below-min-score' ELSE 'record' END AS verdict, count(*) AS n FROM ls GROUP BY 1",
    ),
    "can_testify": (
        lambda s, d: can_testify(table(s, d, "benchmark").selectExpr("item_id AS id", "CASE WHEN item_id % 5 = 0 THEN substr(text, 1, 9) ELSE text END AS text", "CASE item_id % 3 WHEN 0 THEN 0.3D WHEN 1 THEN 0.29D END AS confidence").unionByName(table(s, d, "documents").selectExpr("doc_id + 1000000000 AS id", "text", "doc_id % 10 / 10 AS confidence"))),
        """WITH r AS (SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN left(text, 9) ELSE text END AS t, item_id % 3 = 0 AS sure FROM benchmark UNION ALL SELECT doc_id + 1000000000, text, doc_id % 10 >= 3 FROM documents)
           SELECT id, sure AND len(list_filter(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(string_split('a an and are as at be by for from has have in is it its of on or that the this to was were will with', ' '), w))) > 2 AS testifies FROM r""",
    ),
    "weighted_geomean": (
        lambda s, d: _R(weighted_geomean(events(s, d).selectExpr("capture AS g", "CASE WHEN capture % 4 = 0 THEN 0D ELSE CAST(seq % 5 AS DOUBLE) - 1 END AS weight", "CASE WHEN seq % 11 > 0 THEN score * 4 END AS x")), "value"),
        "WITH e AS (SELECT user_id AS g, CASE WHEN user_id % 4 > 0 AND event_id % 5 > 1 AND event_id % 11 > 0 THEN event_id % 5 - 1 END AS w, ln(CASE WHEN value < 6.25 THEN 0.05::DOUBLE WHEN value > 125 THEN 1 ELSE value / 125 END) AS x FROM events) SELECT g, CASE WHEN count(w) = 0 THEN 1 ELSE round(exp(sum(w * x) FILTER (w IS NOT NULL) / sum(w)), 6) END AS value FROM e GROUP BY g",
    ),
    "linear_fit": (
        lambda s, d: _R(linear_fit(events(s, d).selectExpr("capture AS g", "CASE WHEN capture % 6 = 0 THEN 1D ELSE CAST(seq AS DOUBLE) END AS x", "CASE WHEN capture % 7 = 0 THEN 1D ELSE score END AS y")), "slope", "intercept", "r"),
        """WITH e AS (SELECT user_id AS g, event_id::DOUBLE AS x, value / 500 AS y FROM events), m AS (SELECT g, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM e GROUP BY g), c AS (SELECT e.g, n, mx, my, sum((x - mx) * (y - my)) AS xy, sum((x - mx) ** 2) AS xx, sum((y - my) ** 2) AS yy FROM e JOIN m USING (g) GROUP BY ALL)
           SELECT g, n, CASE WHEN ok THEN round(xy / xx, 6) ELSE 'nan' END::DOUBLE AS slope, CASE WHEN ok THEN round(my - xy / xx * mx, 6) ELSE 'nan' END::DOUBLE AS intercept, CASE WHEN ok THEN round(xy / sqrt(xx * yy), 6) ELSE 'nan' END::DOUBLE AS r FROM (SELECT *, g % 6 > 0 AND g % 7 > 0 AND n > 1 AS ok FROM c) x""",
    ),
    "span_over_depth": (
        lambda s, d: _R(span_over_depth(*((lambda e: (e.where("id % 3 = 0 AND NOT (g % 5 = 0 AND id % 2 = 0)"), e.where("id % 3 > 0 AND g % 4 > 0")))(table(s, d, "embeddings").selectExpr("label AS g", "vec_id AS id", *(f"CAST(embedding[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz")))))), "ratio"),
        """WITH e AS (SELECT label AS g, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), c AS (SELECT * FROM e WHERE id % 3 = 0 AND NOT (g % 5 = 0 AND id % 2 = 0)), m AS (SELECT g, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM c GROUP BY g),
           w AS (SELECT a.g, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS span FROM c a JOIN c b ON a.g = b.g GROUP BY a.g), p AS (SELECT m.g, median(sqrt((e.x - m.x) ** 2 + (e.y - m.y) ** 2 + (e.z - m.z) ** 2)) AS depth FROM e JOIN m ON m.g = e.g WHERE e.id % 3 > 0 AND e.g % 4 > 0 GROUP BY m.g)
           SELECT m.g, CASE WHEN n < 2 OR depth IS NULL THEN 0 ELSE round(span / depth, 6) END AS ratio FROM m JOIN w USING (g) LEFT JOIN p USING (g)""",
    ),
    "rolling_median": (
        lambda s, d: _R(rolling_median(events(s, d).selectExpr("capture AS key", "seq", "score AS value")).select("seq", "med"), "med"),
        f"WITH {DUCK_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq) AS i FROM ev) SELECT a.seq, round(coalesce(median(b.score), any_value(a.score)), 6) AS med FROM n a LEFT JOIN n b ON a.capture = b.capture AND b.i >= a.i - 30 AND b.i < a.i GROUP BY a.seq",
    ),
    "estimate_expiry": (
        lambda s, d: _R(estimate_expiry(events(s, d).selectExpr("capture AS key", "seq", "t / 1000000 + CASE WHEN seq % 23 = 0 THEN -90000 ELSE 0 END AS at", "CASE WHEN label IN ('view', 'click') THEN label END AS state"), 21600.0), "age"),
        """WITH e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1000000 - 90000 * (event_id % 23 = 0)::INT AS t, event_type AS l FROM events), b AS (SELECT e.*, (SELECT max(x.seq) FROM e x WHERE x.key = e.key AND x.seq <= e.seq AND x.l IN ('view', 'click')) AS s FROM e)
           SELECT b.key, b.seq, CASE WHEN x.t IS NOT NULL AND b.t - x.t <= 21600 THEN x.l ELSE 'unknown' END AS state, round(CASE WHEN x.t > b.t THEN 0 ELSE b.t - x.t END, 6) AS age FROM b LEFT JOIN e x ON x.seq = s AND x.key = b.key""",
    ),
    "token_jaccard": (
        lambda s, d: token_shares(table(s, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "CASE WHEN turn % 5 = 0 THEN '' ELSE substr(text, 5) END AS a", "text AS b")).select("id", F.round("jaccard", 6).alias("jaccard")),
        """WITH s(w) AS (SELECT unnest(string_split('a an and are as at be by for from has have in is it its of on or that the this to was were will with', ' '))), p AS (SELECT row_number() OVER () AS n, conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 0 THEN '' ELSE substr(text, 5) END AS x, text AS y FROM conversations),
           a AS (SELECT DISTINCT n, t FROM (SELECT n, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS t FROM p) WHERE t NOT IN (SELECT w FROM s)), b AS (SELECT DISTINCT n, t FROM (SELECT n, unnest(regexp_extract_all(lower(y), '[a-z0-9]+')) AS t FROM p) WHERE t NOT IN (SELECT w FROM s)),
           u AS (SELECT coalesce(a.n, b.n) AS n, count(*) FILTER (a.t IS NOT NULL AND b.t IS NOT NULL) / count(*) AS j FROM a FULL JOIN b ON a.n = b.n AND a.t = b.t GROUP BY 1) SELECT id, round(coalesce(j, 0), 6) AS jaccard FROM p LEFT JOIN u USING (n)""",
    ),
    "containment": (
        lambda s, d: token_shares(table(s, d, "conversations").selectExpr("conv_id * 1000 + turn AS id", "CASE WHEN turn % 5 = 0 THEN '' ELSE substr(text, 5) END AS a", "text AS b")).select("id", F.round("contained", 6).alias("contained")),
        """WITH s(w) AS (SELECT unnest(string_split('a an and are as at be by for from has have in is it its of on or that the this to was were will with', ' '))), p AS (SELECT row_number() OVER () AS n, conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 0 THEN '' ELSE substr(text, 5) END AS x, text AS y FROM conversations),
           a AS (SELECT DISTINCT n, t FROM (SELECT n, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS t FROM p) WHERE t NOT IN (SELECT w FROM s)), b AS (SELECT DISTINCT n, t FROM (SELECT n, unnest(regexp_extract_all(lower(y), '[a-z0-9]+')) AS t FROM p) WHERE t NOT IN (SELECT w FROM s)),
           m AS (SELECT n, least(x.k, y.k) AS k FROM (SELECT n, count(*) AS k FROM a GROUP BY n) x JOIN (SELECT n, count(*) AS k FROM b GROUP BY n) y USING (n)), i AS (SELECT n, count(*) AS c FROM a JOIN b USING (n, t) GROUP BY n) SELECT id, round(coalesce(c / k, 0), 6) AS contained FROM p LEFT JOIN m USING (n) LEFT JOIN i USING (n)""",
    ),
    "key_formats": (
        lambda s, d: key_formats(events(s, d).selectExpr("seq AS id", "capture", "CASE WHEN seq % 9 > 0 THEN seq * CASE WHEN seq % 4 = 0 THEN 987654 ELSE 1 END END AS seq")).withColumnRenamed("id", "event_id"),
        "SELECT event_id, user_id || ':' || k AS frame_key, k || '.jpg' AS file FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN printf('%08d', event_id * CASE WHEN event_id % 4 = 0 THEN 987654 ELSE 1 END) END AS k FROM events) x",
    ),
    "spatial_relations": (
        lambda s, d: spatial_relations(table(s, d, "lineitem").selectExpr(*_CENTRES).groupBy("frame", "id").agg(F.min("x").alias("x"), F.max("y").alias("y")), table(s, d, "orders").selectExpr("o_orderkey AS frame", "CASE WHEN o_orderkey % 6 > 0 THEN 200 ELSE 0 END AS w", "CASE WHEN o_orderkey % 5 > 0 THEN 25 END AS h")),
        """WITH o AS (SELECT l_orderkey AS frame, l_linenumber AS id, min(l_partkey) AS x, max(l_suppkey) AS y FROM lineitem GROUP BY ALL), p AS (SELECT a.frame, a.id AS i, b.id AS j, a.x - b.x AS dx, a.y - b.y AS dy FROM o a JOIN o b ON a.frame = b.frame AND a.id < b.id WHERE a.frame % 6 > 0 AND a.frame % 5 > 0)
           SELECT frame, i AS subject, CASE WHEN dx < 0 THEN 'left_of' ELSE 'right_of' END AS relation, j AS object FROM p WHERE abs(dx) >= 16 UNION ALL SELECT frame, CASE WHEN dy < 0 THEN i ELSE j END, 'higher_in_view', CASE WHEN dy < 0 THEN j ELSE i END FROM p WHERE abs(dy) >= 2""",
    ),
}
