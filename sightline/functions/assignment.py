"""Exact assignment of tracks to detections: most pairs first, then most overlap."""
from __future__ import annotations


def iou(a: list, b: list) -> float:
    """Of two boxes (x0, y0, x1, y1); 0 for empty ones."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def assign(weights: dict) -> dict:
    """{(i, j): weight of 0 to 1} -> {i: j}. Best paths are augmented one pair at a time, so each size is optimal."""
    adj: dict = {}
    for (i, j), w in sorted(weights.items()):
        adj.setdefault(i, []).append((j, w))
    left: dict = {}
    right: dict = {}
    while True:
        gain = {i: (0.0, [i]) for i in adj if i not in left}  # best alternating path to each left node
        best = None
        for _ in range(len(adj) + 1):
            moved = False
            for i in list(gain):
                g, path = gain[i]
                for j, w in adj[i]:
                    if j not in right:
                        if best is None or g + w > best[0] + 1e-12:
                            best = (g + w, [*path, j])
                    elif right[j] != i and right[j] not in path[::2]:
                        k, back = right[j], g + w - weights[(right[j], j)]
                        if k not in gain or back > gain[k][0] + 1e-12:
                            gain[k], moved = (back, [*path, j, k]), True
            if not moved:
                break
        if best is None:
            return left
        path = best[1]
        for i, j in zip(path[::2], path[1::2]):
            left[i], right[j] = j, i


def associate(tracks: list, boxes: list, least: float = 0.25) -> dict:
    """Index of track -> index of detection, both (label, x0, y0, x1, y1), for equal labels and IoU of least or more."""
    pairs = {(i, j): v for i, t in enumerate(tracks) for j, d in enumerate(boxes) if t[0] == d[0] and (v := iou(t[1:], d[1:])) >= least}
    return assign(pairs)
