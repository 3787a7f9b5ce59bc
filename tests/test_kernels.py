"""Registered kernels on pictures of a few pixels."""
import pytest

from sightline.plans.kernels import REGISTRY, Edges, FrameQuality


def test_frame_quality():
    value, label, m = FrameQuality().run({"pixels": [0.0, 10.0, 100.0, 245.0]})
    assert (value, label) == (88.75, "underexposed") and (m["underexposed"], m["overexposed"], m["entropy"]) == (0.5, 0.25, 2.0)
    assert FrameQuality().run({"pixels": [128.0] * 9})[1:] == ("fair", {"mean": 128.0, "deviation": 0.0, "underexposed": 0.0, "overexposed": 0.0, "entropy": pytest.approx(0.0)})
    assert FrameQuality().run({"pixels": [300.0, 250.0]})[1] == "overexposed"
    assert FrameQuality().run({"pixels": None}) == FrameQuality().run({"pixels": []}) == (None, "unknown", {})


def test_edges():
    flat, step = [5.0] * 16, [0.0, 0.0, 200.0, 200.0] * 4
    assert Edges().run({"pixels": flat, "width": 4}) == (0.0, "calm", {"edge_share": 0.0, "edge_mean": 0.0})
    assert Edges().run({"pixels": step, "width": 4}) == (1.0, "busy", {"edge_share": 1.0, "edge_mean": 100.0})
    for row in ({"pixels": None, "width": 4}, {"pixels": [1.0] * 7, "width": 4}, {"pixels": [1.0] * 8, "width": 4}, {"pixels": flat, "width": None}):
        assert Edges().run(row) == (None, "unknown", {})


def test_what_a_kernel_gives_is_declared():
    pixels = [float(i % 256) for i in range(64)]
    for name in ("frame_quality", "edges"):
        kernel = REGISTRY.find(name)
        assert set(kernel.factory().run({"pixels": pixels, "width": 8})[2]) == set(kernel.metrics)
