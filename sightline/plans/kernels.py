"""Named kernels over batches of frames: the plug-in surface for what built-in expressions can't compute.

A kernel is registered with the kinds of the metrics it declares and a factory of its backend. run() loads the backend
once a task, hands it Arrow batches as pandas frames and checks what comes back: an undeclared metric raises. A backend
that says it isn't available is refused with its reason before any task starts.
"""
from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: How a metric folds over frames.
KINDS = ("rate", "count", "constant", "unaggregated")
RESULT = "frame_id long, value double, label string, metrics map<string,double>, stage_ms map<string,double>"


@dataclass(frozen=True)
class Kernel:
    """factory() gives an object with run(row: dict) -> (value, label, metrics), and optionally release()."""

    name: str
    factory: Callable
    metrics: dict[str, str] = field(default_factory=dict)
    available: Callable[[], str | None] = lambda: None


class Registry:
    def __init__(self):
        self.kernels: dict[str, Kernel] = {}

    def register(self, kernel: Kernel) -> None:
        if kernel.name in self.kernels:
            raise ValueError(f"{kernel.name} is registered already")
        wrong = {m: k for m, k in kernel.metrics.items() if k not in KINDS}
        if wrong:
            raise ValueError(f"unknown kinds {wrong}")
        self.kernels[kernel.name] = kernel

    def find(self, name: str) -> Kernel:
        if name not in self.kernels:
            raise KeyError(f"unknown kernel {name!r}; there are {sorted(self.kernels)}")
        kernel = self.kernels[name]
        reason = kernel.available()
        if reason:
            raise RuntimeError(f"{name} isn't available: {reason}")
        return kernel

    def kinds(self, frames: DataFrame) -> DataFrame:
        """The declared metrics as a table (experiment, metric, kind), for the fold of metrics."""
        rows = [(k.name, m, kind) for k in self.kernels.values() for m, kind in sorted(k.metrics.items())]
        return frames.sparkSession.createDataFrame(rows, "experiment string, metric string, kind string")

    def run(self, name: str, frames: DataFrame) -> DataFrame:
        """frames with frame_id -> RESULT, a row a frame; nulls in a frame reach the kernel as None."""
        kernel = self.find(name)
        factory, declared = kernel.factory, set(kernel.metrics)

        def work(batches):
            import pandas as pd

            backend = factory()
            try:
                for batch in batches:
                    out = []
                    for row in batch.to_dict("records"):
                        began = time.perf_counter()
                        value, label, metrics = backend.run(row)
                        if set(metrics) - declared:
                            raise ValueError(f"undeclared metrics {sorted(set(metrics) - declared)}")
                        out.append((row["frame_id"], value, label, metrics, {"run": (time.perf_counter() - began) * 1000}))
                    yield pd.DataFrame(out, columns=["frame_id", "value", "label", "metrics", "stage_ms"])
            finally:
                getattr(backend, "release", lambda: None)()

        return frames.mapInPandas(work, RESULT)


class Brightness:
    """Mean and contrast of a frame's grey values."""

    def run(self, row):
        pixels = row["pixels"]
        if pixels is None or not len(pixels):
            return None, "unknown", {}
        mean = float(sum(pixels)) / len(pixels)
        return mean, "bright" if mean > 0 else "dark", {"contrast": float(max(pixels)) - float(min(pixels)), "brightness": mean}


class FrameQuality:
    """Exposure and information of grey values of 0 to 255, from their histogram."""

    dark, bright, most = 10, 245, 0.25

    def run(self, row):
        import numpy as np

        pixels = row["pixels"]
        if pixels is None or not len(pixels):
            return None, "unknown", {}
        counts = np.bincount(np.clip(np.asarray(pixels, float), 0, 255).astype(int), minlength=256)
        level, share = np.arange(256), counts / counts.sum()
        mean, some = float(share @ level), share[share > 0]
        under, over = float(share[: self.dark + 1].sum()), float(share[self.bright :].sum())
        label = "underexposed" if under > self.most else "overexposed" if over > self.most else "fair"
        return mean, label, {"mean": mean, "deviation": float(np.sqrt(share @ (level - mean) ** 2)), "underexposed": under, "overexposed": over, "entropy": float(-(some * np.log2(some)).sum())}


class Edges:
    """The share of inner pixels whose central difference is above a limit."""

    limit = 40.0

    def run(self, row):
        import numpy as np

        pixels, width = row["pixels"], row["width"]
        if pixels is None or width is None or len(pixels) < 3 * width or width < 3 or len(pixels) % width:
            return None, "unknown", {}
        p = np.asarray(pixels, float).reshape(-1, width)
        size = np.hypot(p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]) / 2
        share = float((size > self.limit).mean())
        return share, "busy" if share >= 0.5 else "calm", {"edge_share": share, "edge_mean": float(size.mean())}


class FixedRows:
    """Answers from a table of rows by frame: detections, text regions, verdicts or estimates computed elsewhere."""

    def __init__(self, answers: dict):
        self.answers = answers

    def run(self, row):
        value, label = self.answers.get(row["frame_id"], (None, "unknown"))
        return value, label, {}


REGISTRY = Registry()
REGISTRY.register(Kernel("brightness", Brightness, {"contrast": "rate", "brightness": "rate"}))
REGISTRY.register(Kernel("frame_quality", FrameQuality, dict.fromkeys(("mean", "deviation", "underexposed", "overexposed", "entropy"), "rate")))
REGISTRY.register(Kernel("edges", Edges, {"edge_share": "rate", "edge_mean": "rate"}))


def attach_rows(frames: DataFrame, rows: DataFrame, key: str = "frame_id") -> DataFrame:
    """The table form of detector, recogniser, verifier and estimator: all of a frame's rows as one array, in their order; a frame without any has an empty one.

    rows: key, pos, and what the kernel gave.
    """
    from pyspark.sql import functions as F

    rest = [c for c in rows.columns if c != key]
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in rest if c != "pos")))).alias("found"))
    return frames.join(per, key, "left").withColumn("found", F.coalesce("found", F.array().cast(per.schema["found"].dataType)))
