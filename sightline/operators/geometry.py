"""Points, boxes, voxels, relations and graphs."""
_P = "p AS (SELECT vec_id, label, @AT(1) AS x, @AT(2) AS y, @AT(3) AS z FROM {embeddings})"
PLANS = {
    "bounds3d": f"WITH {_P} SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p GROUP BY label",
    "voxel_count": f"WITH {_P} SELECT label, count(*) AS cells FROM (SELECT DISTINCT label, CAST(floor(x / 0.1) AS BIGINT) AS i, CAST(floor(y / 0.1) AS BIGINT) AS j, CAST(floor(z / 0.1) AS BIGINT) AS k FROM p) v GROUP BY label",
    "bbox_blowup": f"WITH {_P} SELECT label, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / nullif(greatest(@PCT(x, 0.98) - @PCT(x, 0.02), @PCT(y, 0.98) - @PCT(y, 0.02), @PCT(z, 0.98) - @PCT(z, 0.02)), 0), 6) AS blowup FROM p GROUP BY label",
    "rank_in_view": f"WITH {_P} SELECT vec_id, rank() OVER (PARTITION BY label ORDER BY x DESC) AS place FROM p",
}
