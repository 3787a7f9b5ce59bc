"""Binary buffers of points and meshes as columns; lengths are checked, a buffer that doesn't fit raises with its path.

A point has 16 bytes: x, y, z as little-endian float32, then red, green, blue and confidence. A mesh, the confidence of its
vertices and a chunk of texture pictures are containers of a fixed layout: mark, version and counts, then arrays whose lengths
the header implies.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Fixed value: a point of the buffers.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("confidence", "u1")])
PART = 1 << 16


def pack_points(points: DataFrame) -> DataFrame:
    """points (path, index, x, y, z, r, g, b, confidence) -> (path, part, content): buffers in parts of at most 65,536 points, 1 MB, in order."""
    from pyspark.sql import functions as F

    def pack(t):
        import pandas as pd

        t = t.sort_values("index")
        out = np.empty(len(t), POINT)
        for c in POINT.names:
            out[c] = t[c].to_numpy()
        return pd.DataFrame({"path": [t["path"].iloc[0]], "part": [t["part"].iloc[0]], "content": [out.tobytes()]})

    return points.withColumn("part", F.floor(F.col("index") / PART)).groupBy("path", "part").applyInPandas(pack, "path string, part long, content binary")


def unpack_points(buffers: DataFrame) -> DataFrame:
    """(path, part, content) -> points; part may be 0 for a whole buffer."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, part, blob in zip(batch["path"], batch["part"], batch["content"]):
                if len(blob) % POINT.itemsize:
                    raise ValueError(f"{name}: {len(blob)} bytes are no whole number of points")
                p = np.frombuffer(blob, POINT)
                for at in range(0, len(p), PART):
                    own = p[at : at + PART]
                    yield pd.DataFrame({"path": name, "index": part * PART + np.arange(at, at + len(own)), **{c: own[c].astype("int32" if own[c].dtype == np.uint8 else "float32") for c in POINT.names}})

    return buffers.select("path", "part", "content").mapInPandas(run, "path string, index long, x float, y float, z float, r int, g int, b int, confidence int")


#: The containers' marks and versions, the flags of a mesh, the codes of a chunk's pictures.
MESH_MARK, MESH_VERSION, HAS_NORMALS, SHORT_INDEX = b"WBSURF01", 1, 1, 2
SURE_MARK, SURE_VERSION = b"WBCONF01", 1
CHUNK_MARK, CHUNK_VERSION, PICTURES = b"WBAPCK01", 1, {"astc-6x6-rgba": 1, "webp-rgba": 2}
MESH_HEAD = np.dtype([("mark", "S8"), ("vertices", "<u4"), ("indices", "<u4"), ("flags", "<u4"), ("version", "<u4"), ("low", "<f4", 3), ("high", "<f4", 3)])
SURE_HEAD = np.dtype([("mark", "S8"), ("count", "<u4"), ("version", "<u4"), ("flags", "<u4")])
CHUNK_HEAD = np.dtype([("mark", "S8"), ("version", "<u4"), ("picture", "<u4"), ("slots", "<u4"), ("width", "<u4"), ("height", "<u4"), ("spare", "<u4")])


def _head(name: str, blob: bytes, kind: np.dtype, mark: bytes, version: int) -> np.void:
    """A container's header, if the buffer is one of that kind and version."""
    if len(blob) < kind.itemsize:
        raise ValueError(f"{name}: no header")
    head = np.frombuffer(blob, kind, 1)[0]
    if head["mark"] != mark:
        raise ValueError(f"{name}: another kind of buffer")
    if head["version"] != version:
        raise ValueError(f"{name}: version {head['version']}, not {version}")
    return head


def pack_mesh(vertices: np.ndarray, colours: np.ndarray | None, faces: np.ndarray, normals: np.ndarray | None = None) -> bytes:
    """Positions as 16-bit steps of the bounding box, a colour of three bytes (black if none is given), normals of three signed bytes, indices of 16 bits up to
    65,535 vertices, else of 32."""
    v, f = np.asarray(vertices, "<f4").reshape(-1, 3), np.asarray(faces, np.int64).reshape(-1, 3)
    low, high = (v.min(axis=0), v.max(axis=0)) if len(v) else (np.zeros(3, "<f4"), np.zeros(3, "<f4"))
    short = len(v) < 1 << 16
    flags = HAS_NORMALS * (normals is not None) + SHORT_INDEX * short
    body = [np.array([(MESH_MARK, len(v), f.size, flags, MESH_VERSION, low, high)], MESH_HEAD)]
    if len(v):
        steps = (v - low) / np.maximum(high - low, 1e-9) * 65535.0
        body += [np.clip(steps, 0, 65535).astype("<u2"), np.zeros((len(v), 3), "u1") if colours is None else np.asarray(colours, "u1").reshape(-1, 3)]
        body += [] if normals is None else [np.clip(np.asarray(normals, "<f4") * 127.0, -127, 127).astype("i1")]
    body.append(f.astype("<u2" if short else "<u4"))
    return b"".join(x.tobytes() for x in body)


def read_mesh(name: str, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """vertices, colours, normals or None, faces; raises unless every length fits."""
    head = _head(name, blob, MESH_HEAD, MESH_MARK, MESH_VERSION)
    n, m = int(head["vertices"]), int(head["indices"])
    if m % 3:
        raise ValueError(f"{name}: {m} indices are no whole number of triangles")
    parts = [("at", "<u2", 3 * n), ("colour", "u1", 3 * n), ("normal", "i1", 3 * n if head["flags"] & HAS_NORMALS else 0), ("index", "<u2" if head["flags"] & SHORT_INDEX else "<u4", m)]
    need = MESH_HEAD.itemsize + sum(np.dtype(kind).itemsize * k for _, kind, k in parts)
    if len(blob) != need:
        raise ValueError(f"{name}: {len(blob)} bytes for {n} vertices and {m} indices, not {need}")
    got, place = {}, MESH_HEAD.itemsize
    for part, kind, k in parts:
        got[part] = np.frombuffer(blob, kind, k, place).reshape(-1, 3)
        place += np.dtype(kind).itemsize * k
    if m and int(got["index"].max()) >= n:
        raise ValueError(f"{name}: a triangle names a vertex that isn't there")
    low, high = (np.array(head[k], np.float32) for k in ("low", "high"))
    places = low + got["at"].astype(np.float32) / 65535.0 * np.maximum(high - low, 1e-9)
    return places, got["colour"], got["normal"].astype(np.float32) / 127.0 if head["flags"] & HAS_NORMALS else None, got["index"].astype(np.int64)


def pack_confidence(values: np.ndarray) -> bytes:
    v = np.asarray(values, "u1").reshape(-1)
    return np.array([(SURE_MARK, len(v), SURE_VERSION, 0)], SURE_HEAD).tobytes() + v.tobytes()


def read_confidence(name: str, blob: bytes, vertices: int | None = None) -> np.ndarray:
    """A byte a vertex, of exactly `vertices` where that is known."""
    n = int(_head(name, blob, SURE_HEAD, SURE_MARK, SURE_VERSION)["count"])
    if len(blob) != SURE_HEAD.itemsize + n:
        raise ValueError(f"{name}: {len(blob)} bytes for {n} confidences")
    if vertices is not None and n != vertices:
        raise ValueError(f"{name}: {n} confidences for {vertices} vertices")
    return np.frombuffer(blob, "u1", n, SURE_HEAD.itemsize)


def pack_chunk(picture: str, width: int, height: int, slots: list[bytes]) -> bytes:
    """Pictures of one kind and size behind a table of (offset, length)."""
    sizes = np.array([len(s) for s in slots], "<u4")
    table = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u4") if len(slots) else np.zeros((0, 2), "<u4")
    head = np.array([(CHUNK_MARK, CHUNK_VERSION, PICTURES[picture], len(slots), width, height, 0)], CHUNK_HEAD)
    return head.tobytes() + table.tobytes() + b"".join(slots)


def read_chunk(name: str, blob: bytes) -> tuple[str, int, int, list[bytes]]:
    head = _head(name, blob, CHUNK_HEAD, CHUNK_MARK, CHUNK_VERSION)
    kinds = {code: kind for kind, code in PICTURES.items()}
    if int(head["picture"]) not in kinds:
        raise ValueError(f"{name}: unknown picture code {head['picture']}")
    n, base = int(head["slots"]), CHUNK_HEAD.itemsize + 8 * int(head["slots"])
    if len(blob) < base:
        raise ValueError(f"{name}: shorter than its table")
    table = np.frombuffer(blob, "<u4", 2 * n, CHUNK_HEAD.itemsize).reshape(-1, 2).astype(np.int64)
    ends = base + table.sum(axis=1)
    if n and int(ends.max()) > len(blob):
        raise ValueError(f"{name}: a slot runs past the end")
    if int(ends.max(initial=base)) != len(blob):
        raise ValueError(f"{name}: the length disagrees with the table")
    return kinds[int(head["picture"])], int(head["width"]), int(head["height"]), [blob[base + a : base + a + k] for a, k in table.tolist()]


def pack_meshes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertices (path, id from 0, x, y, z, r, g, b, confidence, and nx, ny, nz if there are normals), faces (path, id, a, b, c) -> path, content, confidence: a mesh
    is one buffer, so it is one group."""
    normals = "nx" in vertices.columns

    def pack(v, f):
        import pandas as pd

        v, f = v.sort_values("id"), f.sort_values("id")
        if v["id"].tolist() != list(range(len(v))):
            raise ValueError(f"{v['path'].iloc[0] if len(v) else f['path'].iloc[0]}: vertices aren't numbered from 0")
        blob = pack_mesh(v[["x", "y", "z"]].to_numpy(), v[["r", "g", "b"]].to_numpy(), f[["a", "b", "c"]].to_numpy(), v[["nx", "ny", "nz"]].to_numpy() if normals else None)
        return pd.DataFrame({"path": [(v if len(v) else f)["path"].iloc[0]], "content": [blob], "confidence": [pack_confidence(v["confidence"].to_numpy())]})

    return vertices.groupBy("path").cogroup(faces.groupBy("path")).applyInPandas(pack, "path string, content binary, confidence binary")


def unpack_mesh(buffers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content, confidence: its buffer or null) -> vertices (path, id, x, y, z, r, g, b, nx, ny, nz, confidence; null normals and confidence where there are none), faces (path, id, a, b, c)."""

    def vertices(batches):
        import pandas as pd

        for batch in batches:
            for name, blob, sure in zip(batch["path"], batch["content"], batch["confidence"]):
                v, c, n, _ = read_mesh(name, blob)
                sure = pd.array([pd.NA] * len(v), "Int32") if sure is None else pd.array(read_confidence(name, sure, len(v)), "Int32")
                for at in range(0, len(v), PART):
                    w = slice(at, at + PART)
                    own = {"path": name, "id": np.arange(at, at + len(v[w])), **{k: v[w, i] for i, k in enumerate("xyz")}, **{k: c[w, i].astype("int32") for i, k in enumerate("rgb")}}
                    yield pd.DataFrame(own | {k: None if n is None else n[w, i] for i, k in enumerate(("nx", "ny", "nz"))} | {"confidence": sure[w]})

    def faces(batches):
        import pandas as pd

        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                f = read_mesh(name, blob)[3]
                for at in range(0, len(f), PART):
                    w = f[at : at + PART]
                    yield pd.DataFrame({"path": name, "id": np.arange(at, at + len(w)), "a": w[:, 0], "b": w[:, 1], "c": w[:, 2]})

    v = buffers.select("path", "content", "confidence").mapInPandas(vertices, "path string, id long, x float, y float, z float, r int, g int, b int, nx float, ny float, nz float, confidence int")
    return v, buffers.select("path", "content").mapInPandas(faces, "path string, id long, a long, b long, c long")


def unpack_chunks(buffers: DataFrame) -> DataFrame:
    """(path, content) -> path, slot, picture, width, height, content: the pictures of each chunk."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                kind, width, height, slots = read_chunk(name, blob)
                yield pd.DataFrame({"path": name, "slot": range(len(slots)), "picture": kind, "width": width, "height": height, "content": slots})

    return buffers.select("path", "content").mapInPandas(run, "path string, slot int, picture string, width int, height int, content binary")
