"""Arrow-batched functions for what built-in expressions lack."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .assignment import assign


@F.pandas_udf(T.StringType())
def observation_id(session: pd.Series, label: pd.Series, observed_at: pd.Series) -> pd.Series:
    """BLAKE2b of 8 bytes, hex, of session, class and time (a double, as Python writes it) joined by ` | `; a missing session is empty, without a class or a time it is null."""
    parts = zip(session, label, observed_at)
    return pd.Series([None if pd.isna(k) or pd.isna(t) else hashlib.blake2b(f"{'' if pd.isna(s) else s} | {k} | {float(t)!r}".encode(), digest_size=8).hexdigest() for s, k, t in parts])


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


@F.pandas_udf(T.StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """Hex of 63 bits of 1,024 grey values, row by row: low 8 x 8 cosine terms without the first, above their median or not; null for other sizes."""
    basis = _cosines(32)[:8]

    def one(v):
        if v is None or len(v) != 1024:
            return None
        terms = (basis @ np.asarray(v, float).reshape(32, 32) @ basis.T).ravel()[1:]
        return f"{int(''.join('1' if t else '0' for t in terms > np.median(terms)), 2):016x}"

    return pixels.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("track", T.LongType()), T.StructField("detection", T.LongType())])))
def best_pairs(candidates: pd.Series) -> pd.Series:
    """Lists of (track, detection, iou) -> the assignment of most pairs, of these the most overlap."""
    return candidates.map(lambda rows: [{"track": i, "detection": j} for i, j in sorted(assign({(r["track"], r["detection"]): r["iou"] for r in rows}).items())])
