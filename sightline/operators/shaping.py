"""Scalar functions of geometry, text and payloads as column expressions, bound to the driver's tables; oracles are texts of their own."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import table


# ---- boxes


def box_geometry(df: DataFrame, pad: float = 0.35) -> DataFrame:
    """Boxes ax0, ay0, ax1, ay1 and bx0 ... by1 of fractions of a frame of w x h -> iou, area of a's part within the frame, the crop of a
    padded by 0.35 on each side in whole pixels (null if empty)."""
    c = F.col
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    inter = side(F.greatest("ax0", "bx0"), F.least("ax1", "bx1")) * side(F.greatest("ay0", "by0"), F.least("ay1", "by1"))
    area = lambda k: side(c(f"{k}x0"), c(f"{k}x1")) * side(c(f"{k}y0"), c(f"{k}y1"))
    inside = side(F.greatest(c("ax0"), F.lit(0.0)), F.least(c("ax1"), F.lit(1.0))) * side(F.greatest(c("ay0"), F.lit(0.0)), F.least(c("ay1"), F.lit(1.0)))
    bw, bh = F.greatest((c("ax1") - c("ax0")) * c("w"), F.lit(1.0)), F.greatest((c("ay1") - c("ay0")) * c("h"), F.lit(1.0))
    cut = {
        "cx0": F.floor(F.greatest(F.lit(0.0), c("ax0") * c("w") - pad * bw)), "cx1": F.floor(F.least(c("w").cast("double"), c("ax1") * c("w") + pad * bw)),
        "cy0": F.floor(F.greatest(F.lit(0.0), c("ay0") * c("h") - pad * bh)), "cy1": F.floor(F.least(c("h").cast("double"), c("ay1") * c("h") + pad * bh)),
    }
    some = (cut["cx1"] > cut["cx0"]) & (cut["cy1"] > cut["cy0"])
    return df.select("*", F.coalesce(inter / F.nullif(area("a") + area("b") - inter, F.lit(0.0)), F.lit(0.0)).alias("iou"), inside.alias("inside"), *(F.when(some, x).alias(k) for k, x in cut.items()))


def obscured_fraction(boxes: DataFrame, filled: DataFrame) -> DataFrame:
    """boxes, filled (frame, x0, y0, x1, y1; boxes with id) -> id, obscured: the largest share of the box that a single filled region hides, rounded to 4."""
    f = filled.select("frame", *(F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")))
    side = lambda lo, hi: F.greatest(hi - lo, F.lit(0.0))
    part = side(F.greatest("x0", "fx0"), F.least("x1", "fx1")) * side(F.greatest("y0", "fy0"), F.least("y1", "fy1"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.join(f, "frame", "left").groupBy("id").agg(F.round(F.coalesce(F.max(F.when(own > 0, part / F.when(own > 0, own))), F.lit(0.0)), 4).alias("obscured"))


# ---- rotations, similarities, cameras


def matrix(q: list[Column]) -> list[Column]:
    """Nine entries, by rows, of a quaternion w, x, y, z of any length; null for a zero one."""
    n = F.nullif(sum(c * c for c in q), F.lit(0.0))
    w, x, y, z = (c / F.sqrt(n) for c in q)
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def quaternion(m: list[Column]) -> list[Column]:
    """w, x, y, z of a rotation, w not below 0: the largest part from the diagonal, the others from it."""
    sq = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    d, e, f = m[3] + m[1], m[2] + m[6], m[7] + m[5]
    rows = [[sq[0], a, b, c], [a, sq[1], d, e], [b, d, sq[2], f], [c, e, f, sq[3]]]
    big = F.greatest(*sq)
    pick = lambda k: F.when(sq[0] == big, rows[0][k]).when(sq[1] == big, rows[1][k]).when(sq[2] == big, rows[2][k]).otherwise(rows[3][k])
    sign = F.when(pick(0) < 0, -1.0).otherwise(1.0)
    return [sign * pick(k) / (2 * F.sqrt(big)) for k in range(4)]


def quaternion_matrix(df: DataFrame) -> DataFrame:
    """w, x, y, z -> m00 ... m22 and back qw, qx, qy, qz."""
    out = df.select("*", *(c.alias(f"m{i // 3}{i % 3}") for i, c in enumerate(matrix([F.col(k) for k in "wxyz"]))))
    return out.select("*", *(c.alias(f"q{k}") for k, c in zip("wxyz", quaternion([F.col(f"m{i // 3}{i % 3}") for i in range(9)]))))


def sim3_apply(s: Column, r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    return [s * sum(r[3 * i + k] * p[k] for k in range(3)) + t[i] for i in range(3)]


def sim3_compose(a: tuple, b: tuple) -> tuple:
    """a after b."""
    return a[0] * b[0], [sum(a[1][3 * i + k] * b[1][3 * k + j] for k in range(3)) for i in range(3) for j in range(3)], sim3_apply(a[0], a[1], a[2], b[2])


def sim3_inverse(s: Column, r: list[Column], t: list[Column]) -> tuple:
    back = [r[3 * j + i] for i in range(3) for j in range(3)]
    return 1 / s, back, [-sum(back[3 * i + k] * t[k] for k in range(3)) / s for i in range(3)]


def sim3(df: DataFrame) -> DataFrame:
    """s, quaternion w, x, y, z, shift tx, ty, tz, point px, py, pz -> the point moved (x, y, z), moved twice (x2 ...), and moved back (bx ...)."""
    one = (F.col("s"), [F.col(f"_m{i}") for i in range(9)], [F.col(f"t{c}") for c in "xyz"])
    p = [F.col(f"p{c}") for c in "xyz"]
    df = df.select("*", *(c.alias(f"_m{i}") for i, c in enumerate(matrix([F.col(k) for k in ("qw", "qx", "qy", "qz")]))))
    moved = sim3_apply(*one, p)
    out = df.select("*", *(c.alias(k) for k, c in zip("xyz", moved)), *(c.alias(f"{k}2") for k, c in zip("xyz", sim3_apply(*sim3_compose(one, one), p))))
    back = sim3_apply(*sim3_inverse(*one), [F.col(c) for c in "xyz"])
    return out.select("*", *(c.alias(f"b{k}") for k, c in zip("xyz", back))).drop(*(f"_m{i}" for i in range(9)))


def camera_projection(df: DataFrame) -> DataFrame:
    """x, y, z, f, cx, cy, prediction a * inverse depth + b -> u, v (null behind the camera), the point of (u, v, z) back, depth from the prediction (null outside its domain)."""
    z = F.when(F.col("z") > 0, F.col("z"))
    u, v = F.col("f") * F.col("x") / z + F.col("cx"), F.col("f") * F.col("y") / z + F.col("cy")
    inverse = (F.col("prediction") - F.col("b")) / F.nullif("a", F.lit(0.0))
    return df.select("*", u.alias("u"), v.alias("v"), ((u - F.col("cx")) * z / F.col("f")).alias("bx"), ((v - F.col("cy")) * z / F.col("f")).alias("by"), F.when(inverse > 0, 1 / F.when(inverse > 0, inverse)).alias("depth"))


def min_parallax(focal: Column, noise: float = 1.0, fallback: float = 0.5) -> Column:
    """Degrees below which two views carry no depth: noise over focal length; the fallback for none."""
    ok = ~F.isnan(focal) & (focal > 0) & (focal < float("inf"))
    return F.when(F.coalesce(ok, F.lit(False)), F.degrees(F.lit(noise) / F.when(ok, focal))).otherwise(fallback)


def parallax_angles(df: DataFrame) -> DataFrame:
    """g, point p*, camera centres a*, b*, focal -> of each group the median angle at its points, how many lie below what the noise allows."""
    ray = {k: [F.col(f"{k}{c}") - F.col(f"p{c}") for c in "xyz"] for k in "ab"}
    size = F.sqrt(sum(c * c for c in ray["a"]) * sum(c * c for c in ray["b"]))
    cosine = sum(p * q for p, q in zip(ray["a"], ray["b"])) / F.nullif(size, F.lit(0.0))
    angle = F.coalesce(F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))), F.lit(0.0))
    return df.withColumn("_angle", angle).groupBy("g").agg(F.median("_angle").alias("median"), F.count_if(F.col("_angle") < min_parallax(F.col("focal"))).alias("too_small"))


# ---- keys and numbers

OFFSET, SPAN = 1 << 20, 1 << 21


def block_key(x: Column, y: Column, z: Column) -> Column:
    """Three whole numbers in one; those outside the range raise instead of taking another's key."""
    q = [c + OFFSET for c in (x, y, z)]
    inside = (F.least(*q) >= 0) & (F.greatest(*q) < SPAN)
    return F.when(inside, (q[0] * SPAN + q[1]) * SPAN + q[2]).otherwise(F.raise_error(F.lit("block coordinates outside the range of keys")).cast("bigint"))


def block_coords(key: Column) -> list[Column]:
    return [F.floor(key / (SPAN * SPAN)) - OFFSET, F.floor(key / SPAN) % SPAN - OFFSET, key % SPAN - OFFSET]


def occupied_tiles(blocks: DataFrame, size: int) -> DataFrame:
    """blocks (x, y, z from 0) -> tiles (i, j, k) that hold a block, or border on one: a block on a tile's lower face is read by the tile before too."""
    axis = lambda c: F.when(F.col(c) % size == 0, F.array(F.floor(F.col(c) / size), F.floor(F.col(c) / size) - 1)).otherwise(F.array(F.floor(F.col(c) / size)))
    out = blocks
    for c, n in zip("xyz", "ijk"):
        out = out.withColumn(n, F.explode(axis(c)))
    return out.where("i >= 0 AND j >= 0 AND k >= 0").select("i", "j", "k").distinct()


def normalisers(df: DataFrame) -> DataFrame:
    """frame, id, value -> by the frame's range, by p1 to p99 cut, and (value - median) / 6 MAD + 0.5 cut; 0 where the frame is flat."""
    per = df.groupBy("frame").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile("value", 0.01).alias("p1"), F.percentile("value", 0.99).alias("p99"), F.median("value").alias("med"))
    d = df.join(per, "frame")
    mad = d.groupBy("frame").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    d = d.join(mad, "frame")
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    flat = lambda w, c: F.when(w < 1e-9, 0.0).otherwise(c / F.when(w < 1e-9, 1.0).otherwise(w))
    lo, p1, mad6 = F.col("hi") - F.col("lo"), F.col("p99") - F.col("p1"), F.col("mad")
    return d.select("frame", "id", flat(lo, F.col("value") - F.col("lo")).alias("minmax"), unit(flat(p1, F.col("value") - F.col("p1"))).alias("percentile"), F.when(mad6 < 1e-9, 0.0).otherwise(unit(flat(6 * mad6, F.col("value") - F.col("med")) + 0.5)).alias("mad"))


def intrinsics_scale(df: DataFrame) -> DataFrame:
    """w, h, fx, fy, cx, cy, to_w, to_h, allowed -> the four scaled to the new size; another size without leave raises, unknown ones stay unknown."""
    known = F.col("fx").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0)
    same = (F.col("w") == F.col("to_w")) & (F.col("h") == F.col("to_h"))
    ok = F.when(~F.coalesce(known, F.lit(False)), F.lit(None).cast("boolean")).when(same | F.col("allowed"), F.lit(True)).otherwise(F.raise_error(F.lit("intrinsics of another size")).cast("boolean"))
    by = {"x": F.col("to_w") / F.nullif("w", F.lit(0)), "y": F.col("to_h") / F.nullif("h", F.lit(0))}
    return df.select("*", *(F.when(ok, F.col(c) * by[c[1]]).alias(f"{c}2") for c in ("fx", "fy", "cx", "cy")))


def format_distance(value: Column, state: Column) -> Column:
    """Three decimals, halves to the even one; metres only of a measured scale, else world units; null stays null."""
    return F.when(value.isNotNull(), F.concat(F.format_string("%.3f", F.bround(value, 3)), F.when(state == "measured", " m").otherwise(" world units")))


# ---- payloads and text


def without(df: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """The struct column less dotted paths; those that aren't there do nothing."""
    for path in paths:
        kind, parts, there = df.schema[column].dataType, path.split("."), True
        for p in parts:
            there = there and hasattr(kind, "names") and p in kind.names
            kind = kind[p].dataType if there else kind
        if there:
            df = df.withColumn(column, F.col(column).dropFields(path))
    return df


def clip_text(text: Column, most: int) -> Column:
    """Up to `most` characters, the last an ellipsis where it was cut, no space before it."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before a space; else all of it."""
    at = F.instr(text, ". ")
    return F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text)


def backend_selection(df: DataFrame) -> DataFrame:
    """asked (auto, classical, unposed), intrinsics (known, unknown ...) -> backend, downgraded_from, reason; another name raises."""
    known = F.col("intrinsics") == "known"
    name = F.when(F.col("asked").isin("auto", "classical", "unposed"), F.col("asked")).otherwise(F.raise_error(F.concat(F.lit("unknown backend "), F.coalesce("asked", F.lit("null")))))
    down = (name != "unposed") & ~F.coalesce(known, F.lit(False))
    return df.select("*", F.when((name == "unposed") | down, "unposed").otherwise("classical").alias("backend"), F.when(down, "classical").alias("downgraded_from"), F.when(down, F.concat(F.lit("intrinsics are "), F.coalesce("intrinsics", F.lit("absent")))).alias("reason"))


# ---- bindings

_E = lambda i, k=1.0, o=0.0: f"CAST(embedding[{i}] AS DOUBLE) * {k}D + {o}D"
_R = lambda df, *cs: df.select(*(F.round(c, 6).alias(c) if c in cs else F.col(c) for c in df.columns))


def _boxes(s, d):
    return table(s, d, "embeddings").selectExpr("vec_id", f"{_E(0)} AS ax0", f"{_E(1)} AS ay0", f"{_E(0)} + abs({_E(2)}) + 0.1D AS ax1", f"{_E(1)} + abs({_E(3)}) + 0.1D AS ay1", f"{_E(4)} AS bx0", f"{_E(5)} AS by0", f"{_E(4)} + abs({_E(6)}) + 0.1D AS bx1", f"{_E(5)} + abs({_E(7)}) + 0.1D AS by1", "640 AS w", "360 AS h")


def _kernel(s, d):
    from sightline.plans.kernels import REGISTRY

    frames = table(s, d, "embeddings").selectExpr("vec_id AS frame_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS pixels")
    return REGISTRY.run("brightness", frames).selectExpr("frame_id", "label", "round(value, 6) AS value", "round(metrics['contrast'], 6) AS contrast")


def _grey(s, d):
    """Vectors as pictures of 8 x 8 grey values of 0 to 255."""
    return table(s, d, "embeddings").selectExpr("vec_id AS frame_id", "transform(embedding, x -> CAST(greatest(0, least(255, floor(CAST(x AS DOUBLE) * 500 + 128))) AS DOUBLE)) AS pixels", "8 AS width")


def _quality(s, d):
    from sightline.plans.kernels import REGISTRY

    names = ("mean", "deviation", "underexposed", "overexposed", "entropy")
    return REGISTRY.run("frame_quality", _grey(s, d)).selectExpr("frame_id", "label", *(f"round(metrics['{n}'], 6) AS {n}" for n in names))


def _edges(s, d):
    from sightline.plans.kernels import REGISTRY

    return REGISTRY.run("edges", _grey(s, d)).selectExpr("frame_id", "label", "round(value, 6) AS value")


_D_GREY = "g AS (SELECT vec_id AS frame_id, i - 1 AS i, greatest(0, least(255, floor(embedding[i]::DOUBLE * 500 + 128))) AS v FROM embeddings, range(1, 65) r(i))"

OPS = {
    "experiment_quality": (
        _quality,
        f"""WITH {_D_GREY}, p AS (SELECT frame_id, v, count(*) / 64 AS p FROM g GROUP BY ALL), e AS (SELECT frame_id, sum(p * log2(1 / p)) AS bits FROM p GROUP BY 1)
            SELECT frame_id, CASE WHEN avg((v <= 10)::INT) > 0.25 THEN 'underexposed' WHEN avg((v >= 245)::INT) > 0.25 THEN 'overexposed' ELSE 'fair' END AS label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(avg((v <= 10)::INT), 6) AS underexposed, round(avg((v >= 245)::INT), 6) AS overexposed, round(any_value(bits), 6) AS entropy FROM g JOIN e USING (frame_id) GROUP BY frame_id""",
    ),
    "experiment_edges": (
        _edges,
        f"""WITH {_D_GREY}, d AS (SELECT a.frame_id, sqrt((r.v - l.v) ** 2 + (b.v - t.v) ** 2) / 2 AS m FROM g a JOIN g l ON l.frame_id = a.frame_id AND l.i = a.i - 1 JOIN g r ON r.frame_id = a.frame_id AND r.i = a.i + 1 JOIN g t ON t.frame_id = a.frame_id AND t.i = a.i - 8 JOIN g b ON b.frame_id = a.frame_id AND b.i = a.i + 8 WHERE a.i % 8 BETWEEN 1 AND 6 AND a.i // 8 BETWEEN 1 AND 6)
            SELECT frame_id, CASE WHEN avg((m > 40)::INT) >= 0.5 THEN 'busy' ELSE 'calm' END AS label, round(avg((m > 40)::INT), 6) AS value FROM d GROUP BY frame_id""",
    ),
    "box_geometry": (
        lambda s, d: _R(box_geometry(_boxes(s, d)).select("vec_id", "iou", "inside", "cx0", "cx1", "cy0", "cy1"), "iou", "inside"),
        """WITH b AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) + 0.1 AS w, abs(embedding[4]::DOUBLE) + 0.1 AS h, embedding[5]::DOUBLE AS p, embedding[6]::DOUBLE AS q, abs(embedding[7]::DOUBLE) + 0.1 AS r, abs(embedding[8]::DOUBLE) + 0.1 AS t FROM embeddings),
           i AS (SELECT *, greatest(0, least(x + w, p + r) - greatest(x, p)) * greatest(0, least(y + h, q + t) - greatest(y, q)) AS i FROM b), c AS (SELECT *, floor(greatest(0, 640 * (x - 0.35 * w)))::BIGINT AS x0, floor(least(640, 640 * (x + 1.35 * w)))::BIGINT AS x1, floor(greatest(0, 360 * (y - 0.35 * h)))::BIGINT AS y0, floor(least(360, 360 * (y + 1.35 * h)))::BIGINT AS y1 FROM i)
           SELECT vec_id, round(i / (w * h + r * t - i), 6) AS iou, round(greatest(0, least(x + w, 1) - greatest(x, 0)) * greatest(0, least(y + h, 1) - greatest(y, 0)), 6) AS inside, CASE WHEN ok THEN x0 END AS cx0, CASE WHEN ok THEN x1 END AS cx1, CASE WHEN ok THEN y0 END AS cy0, CASE WHEN ok THEN y1 END AS cy1 FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM c) z""",
    ),
    "obscured_fraction": (
        lambda s, d: obscured_fraction(_boxes(s, d).selectExpr("vec_id AS id", "vec_id DIV 10 AS frame", "ax0 AS x0", "ay0 AS y0", "ax1 AS x1", "ay1 AS y1"), _boxes(s, d).where("vec_id % 3 > 0").selectExpr("vec_id DIV 10 AS frame", "bx0 AS x0", "by0 AS y0", "bx1 AS x1", "by1 AS y1")),
        """WITH b AS (SELECT vec_id, vec_id // 10 AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, abs(embedding[3]::DOUBLE) + 0.1 AS w, abs(embedding[4]::DOUBLE) + 0.1 AS h, embedding[5]::DOUBLE AS p, embedding[6]::DOUBLE AS q, abs(embedding[7]::DOUBLE) + 0.1 AS r, abs(embedding[8]::DOUBLE) + 0.1 AS t FROM embeddings)
           SELECT vec_id AS id, round(coalesce((SELECT max(greatest(0, least(a.x + a.w, c.p + c.r) - greatest(a.x, c.p)) * greatest(0, least(a.y + a.h, c.q + c.t) - greatest(a.y, c.q)) / (a.w * a.h)) FROM b c WHERE c.f = a.f AND c.vec_id % 3 > 0), 0), 4) AS obscured FROM b a""",
    ),
    "quaternion_matrix": (
        lambda s, d: _R(quaternion_matrix(table(s, d, "embeddings").selectExpr("vec_id", *(f"{_E(i)} AS {c}" for i, c in enumerate("wxyz")))).selectExpr("vec_id", "m00", "m12", "m21", "m22", "qw", "qx", "qy", "qz"), "m00", "m12", "m21", "m22", "qw", "qx", "qy", "qz"),
        """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings), n AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) * sign(a) AS n FROM e)
           SELECT vec_id, round((a * a + b * b - c * c - d * d) / n / n, 6) AS m00, round(2 * (c * d - a * b) / n / n, 6) AS m12, round(2 * (c * d + a * b) / n / n, 6) AS m21, round((a * a - b * b - c * c + d * d) / n / n, 6) AS m22, round(a / n, 6) AS qw, round(b / n, 6) AS qx, round(c / n, 6) AS qy, round(d / n, 6) AS qz FROM n""",
    ),
    "sim3": (
        lambda s, d: _R(sim3(table(s, d, "embeddings").selectExpr("vec_id", f"abs({_E(0)}) + 0.5D AS s", f"cos({_E(1)}) AS qw", "0D AS qx", "0D AS qy", f"sin({_E(1)}) AS qz", f"{_E(2)} AS tx", f"{_E(3)} AS ty", f"{_E(4)} AS tz", f"{_E(5)} AS px", f"{_E(6)} AS py", f"{_E(7)} AS pz")).select("vec_id", "x", "y", "z", "x2", "y2", "z2", "bx", "by", "bz"), "x", "y", "z", "x2", "y2", "z2", "bx", "by", "bz"),
        """WITH e AS (SELECT vec_id, abs(embedding[1]::DOUBLE) + 0.5 AS s, 2 * embedding[2]::DOUBLE AS w, embedding[3]::DOUBLE AS a, embedding[4]::DOUBLE AS b, embedding[5]::DOUBLE AS c, embedding[6]::DOUBLE AS p, embedding[7]::DOUBLE AS q, embedding[8]::DOUBLE AS r FROM embeddings),
           m AS (SELECT *, s * (cos(w) * p - sin(w) * q) + a AS x, s * (sin(w) * p + cos(w) * q) + b AS y, s * r + c AS z FROM e) SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(s * (cos(w) * x - sin(w) * y) + a, 6) AS x2, round(s * (sin(w) * x + cos(w) * y) + b, 6) AS y2, round(s * z + c, 6) AS z2, round(p, 6) AS bx, round(q, 6) AS by, round(r, 6) AS bz FROM m""",
    ),
    "camera_projection": (
        lambda s, d: _R(camera_projection(table(s, d, "embeddings").selectExpr("vec_id", f"{_E(0)} AS x", f"{_E(1)} AS y", f"{_E(2)} AS z", "500D AS f", "320D AS cx", "180D AS cy", f"{_E(3)} AS prediction", "CAST(vec_id % 3 AS DOUBLE) AS a", "0.05D AS b")).select("vec_id", "u", "v", "bx", "by", "depth"), "u", "v", "bx", "by", "depth"),
        """SELECT vec_id, CASE WHEN z > 0 THEN round(320 + 500 * x / z, 6) END AS u, CASE WHEN z > 0 THEN round(180 + 500 * y / z, 6) END AS v, CASE WHEN z > 0 THEN round(x, 6) END AS bx, CASE WHEN z > 0 THEN round(y, 6) END AS by, CASE WHEN vec_id % 3 > 0 AND p > 0.05 THEN round(vec_id % 3 / (p - 0.05), 6) END AS depth
           FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS p FROM embeddings) e""",
    ),
    "parallax_angles": (
        lambda s, d: _R(parallax_angles(table(s, d, "embeddings").selectExpr("label AS g", f"{_E(0)} AS px", f"{_E(1)} AS py", f"{_E(2, 30, 12)} AS pz", f"{_E(3, 0.2)} AS ax", "0D AS ay", "0D AS az", f"{_E(4, 0.2)} AS bx", "0D AS by", "0D AS bz", "CASE WHEN label % 3 > 0 THEN 438D ELSE 0D END AS focal")), "median"),
        """WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE * 30 + 12 AS z, embedding[4]::DOUBLE * 0.2 AS a, embedding[5]::DOUBLE * 0.2 AS b FROM embeddings), r AS (SELECT label, degrees(atan2(abs(a - b) * sqrt(y * y + z * z), (a - x) * (b - x) + y * y + z * z)) AS w FROM e)
           SELECT label AS g, round(median(w), 6) AS median, count_if(w < CASE WHEN label % 3 = 0 THEN 0.5 ELSE degrees(1 / 438.0) END) AS too_small FROM r GROUP BY label""",
    ),
    "spatial_keys": (
        lambda s, d: (lambda k: k.select("vec_id", "key", *(c.alias(n) for n, c in zip("xyz", block_coords(F.col("key"))))))(table(s, d, "embeddings").selectExpr("vec_id", *(f"CAST(floor({_E(i, 1000)}) AS BIGINT) AS b{i}" for i in range(3))).select("vec_id", block_key(F.col("b0"), F.col("b1"), F.col("b2")).alias("key"))),
        "WITH b AS (SELECT vec_id, floor(embedding[1]::DOUBLE * 1000)::BIGINT AS x, floor(embedding[2]::DOUBLE * 1000)::BIGINT AS y, floor(embedding[3]::DOUBLE * 1000)::BIGINT AS z FROM embeddings) SELECT vec_id, ((x + 1048576) << 42) + ((y + 1048576) << 21) + z + 1048576 AS key, x, y, z FROM b",
    ),
    "block_key_lookup": (
        lambda s, d: (lambda k: k.join(k.where("vec_id % 2 = 0").groupBy("key").agg(F.min("vec_id").alias("holder")), "key").select("vec_id", "holder"))(table(s, d, "embeddings").selectExpr("vec_id", *(f"CAST(floor({_E(i, 8)}) AS BIGINT) AS b{i}" for i in range(3))).select("vec_id", block_key(F.col("b0"), F.col("b1"), F.col("b2")).alias("key"))),
        "WITH b AS (SELECT vec_id, [floor(embedding[1]::DOUBLE * 8), floor(embedding[2]::DOUBLE * 8), floor(embedding[3]::DOUBLE * 8)] AS c FROM embeddings) SELECT a.vec_id, min(h.vec_id) AS holder FROM b a JOIN b h ON a.c = h.c WHERE h.vec_id % 2 = 0 GROUP BY a.vec_id",
    ),
    "occupied_tiles": (
        lambda s, d: occupied_tiles(table(s, d, "embeddings").selectExpr(*(f"CAST(floor({_E(i, 40, 20)}) AS BIGINT) AS {c}" for i, c in enumerate("xyz"))), 4),
        "WITH b AS (SELECT floor(embedding[1]::DOUBLE * 40 + 20)::BIGINT AS x, floor(embedding[2]::DOUBLE * 40 + 20)::BIGINT AS y, floor(embedding[3]::DOUBLE * 40 + 20)::BIGINT AS z FROM embeddings), h(o) AS (VALUES (0), (1)) SELECT DISTINCT (x - i.o) // 4 AS i, (y - j.o) // 4 AS j, (z - k.o) // 4 AS k FROM b, h i, h j, h k WHERE x - i.o >= 0 AND y - j.o >= 0 AND z - k.o >= 0",
    ),
    "normalisers": (
        lambda s, d: _R(normalisers(table(s, d, "embeddings").selectExpr("label AS frame", "vec_id AS id", f"CASE WHEN label = 3 THEN 1D ELSE {_E(0)} END AS value")), "minmax", "percentile", "mad"),
        """WITH e AS (SELECT label AS f, vec_id AS id, CASE WHEN label = 3 THEN 1 ELSE embedding[1]::DOUBLE END AS v FROM embeddings), p AS (SELECT f, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b, median(v) AS m, mad(v) AS d FROM e GROUP BY f)
           SELECT f AS frame, id, CASE WHEN f = 3 THEN 0 ELSE round((v - lo) / (hi - lo), 6) END AS minmax, CASE WHEN f = 3 THEN 0 ELSE round(greatest(0, least(1, (v - a) / (b - a))), 6) END AS percentile, CASE WHEN f = 3 THEN 0 ELSE round(greatest(0, least(1, (v - m) / (6 * d) + 0.5)), 6) END AS mad FROM e JOIN p USING (f)""",
    ),
    "intrinsics_scale": (
        lambda s, d: intrinsics_scale(table(s, d, "part").selectExpr("p_partkey", "640 AS w", "CASE WHEN p_partkey % 9 > 0 THEN 360 ELSE 0 END AS h", "CASE WHEN p_partkey % 5 > 0 THEN 500D END AS fx", "500D AS fy", "320D AS cx", "180D AS cy", "CASE WHEN p_partkey % 2 = 0 THEN 640 ELSE 1280 END AS to_w", "CASE WHEN p_partkey % 2 = 0 THEN 360 ELSE 720 END AS to_h", "p_partkey % 2 = 1 AS allowed")).select("p_partkey", "fx2", "cy2"),
        "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 9 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 500.0::DOUBLE ELSE 1000.0 END END AS fx2, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 9 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 180.0::DOUBLE ELSE 360.0 END END AS cy2 FROM part",
    ),
    "format_distance": (
        lambda s, d: table(s, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 7 > 0 THEN p_partkey / 16 END AS v", "CASE p_partkey % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'assumed' END AS state").select("p_partkey", format_distance(F.col("v"), F.col("state")).alias("distance")),
        """WITH t AS (SELECT p_partkey AS k, p_partkey * 125 // 2 AS q FROM part), r AS (SELECT k, q + CASE WHEN k % 2 = 1 AND q % 2 = 1 THEN 1 ELSE 0 END AS q FROM t)
           SELECT k AS p_partkey, CASE WHEN k % 7 > 0 THEN (q // 1000) || '.' || lpad((q % 1000)::VARCHAR, 3, '0') || CASE WHEN k % 3 = 0 THEN ' m' ELSE ' world units' END END AS distance FROM r""",
    ),
    "json_path_drop": (
        lambda s, d: without(table(s, d, "events").selectExpr("event_id", "named_struct('served_at', event_id, 'body', named_struct('age', value, 'kind', event_type, 'deep', named_struct('z', user_id, 'y', 1))) AS p"), "p", ["served_at", "body.age", "body.deep.z", "body.absent", "nothing.at.all"]).select("event_id", F.to_json("p").alias("payload")),
        "SELECT event_id, '{\"body\":{\"kind\":\"' || event_type || '\",\"deep\":{\"y\":1}}}' AS payload FROM events",
    ),
    "clip_text": (
        lambda s, d: table(s, d, "documents").select("doc_id", clip_text(F.col("text"), 60).alias("clipped"), first_sentence(F.col("text")).alias("sentence")),
        "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(left(text, 59), ' ') || chr(8230) END AS clipped, CASE WHEN contains(text, '. ') THEN split_part(text, '. ', 1) || '.' ELSE text END AS sentence FROM documents",
    ),
    "backend_selection": (
        lambda s, d: backend_selection(table(s, d, "part").selectExpr("p_partkey", "element_at(array('auto', 'classical', 'unposed'), CAST(p_partkey % 3 + 1 AS INT)) AS asked", "element_at(array('known', 'unknown', NULL), CAST(p_partkey % 4 % 3 + 1 AS INT)) AS intrinsics")).select("p_partkey", "backend", "downgraded_from", "reason"),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND p_partkey % 4 % 3 = 0 THEN 'classical' ELSE 'unposed' END AS backend, CASE WHEN down THEN 'classical' END AS downgraded_from, CASE WHEN down THEN 'intrinsics are ' || CASE p_partkey % 4 % 3 WHEN 1 THEN 'unknown' ELSE 'absent' END END AS reason FROM (SELECT *, p_partkey % 3 < 2 AND p_partkey % 4 % 3 > 0 AS down FROM part) x",
    ),
    "experiment_protocol": (_kernel, "SELECT vec_id AS frame_id, CASE WHEN avg(v) > 0 THEN 'bright' ELSE 'dark' END AS label, round(avg(v), 6) AS value, round(max(v) - min(v), 6) AS contrast FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) x GROUP BY vec_id"),
}
