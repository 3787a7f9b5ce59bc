"""Folds for keyed.fold_table and keyed.fold_stream; rows carry `at` in seconds."""
from __future__ import annotations

import json

from sightline.functions.assignment import associate


def multi_object_tracker(latch: int = 3, counted: int = 6, patience: int = 12, least: float = 0.25):
    """boxes: JSON list of objects label, x0, y0, x1, y1, facing (null: none). Out: a row a track and frame.

    A track is confirmed from `latch` hits in a row on, counted while it is and misses at most `counted` in a row, and
    expires after more than `patience` of them. What it faces is the last estimate, forgotten when it comes back after a miss.
    """

    def step(state, row):
        state = state or {"next": 0, "tracks": []}
        found = [[b["label"], b["x0"], b["y0"], b["x1"], b["y1"]] for b in json.loads(row["boxes"] or "[]")]
        facing = [b.get("facing") for b in json.loads(row["boxes"] or "[]")]
        pairs, out, kept = associate([t["box"] for t in state["tracks"]], found, least), [], []
        for i, t in enumerate(state["tracks"]):
            if i in pairs:
                old = t["facing"] if t["misses"] == 0 else None
                new = facing[pairs[i]]
                t |= {"box": found[pairs[i]], "hits": t["hits"] + 1, "streak": t["streak"] + 1, "misses": 0, "facing": old if new is None else new}
                t["confirmed"] = t["confirmed"] or t["streak"] >= latch
                event = "seen"
            else:
                t |= {"streak": 0, "misses": t["misses"] + 1}
                event = "expired" if t["misses"] > patience else "missed"
            if event != "expired":
                kept.append(t)
            out.append((t, event))
        for j in sorted(set(range(len(found))) - set(pairs.values())):
            t = {"id": state["next"], "box": found[j], "hits": 1, "streak": 1, "misses": 0, "confirmed": latch <= 1, "facing": facing[j]}
            state["next"] += 1
            kept.append(t)
            out.append((t, "born"))
        state["tracks"] = kept
        return state, [{"at": row["at"], "track_id": t["id"], "label": t["box"][0], "hits": t["hits"], "misses": t["misses"], "confirmed": t["confirmed"], "counted": t["confirmed"] and t["misses"] <= counted, "facing": t["facing"], "event": e} for t, e in out]

    return step


TRACKS = "at double, track_id long, label string, hits long, misses long, confirmed boolean, counted boolean, facing string, event string"


def dwell_tracker(gap: float = 5.0, moved: float = 0.18, missing: float = 1.5, misses: int = 60, longest: float = 180.0, least_frames: int = 4, least_s: float = 1.0):
    """Row: at, visible, x, y (of the diagonal), area. Returns (step, close); out: started, ended, frames, reason."""

    def ended(s, reason):
        held = s and s["frames"] >= least_frames and s["last"] - s["first"] >= least_s
        return [{"started": s["first"], "ended": s["last"], "frames": s["frames"], "reason": reason}] if held else []

    def step(s, row):
        out = []
        if s and row["at"] - s["last"] > gap:
            out, s = ended(s, "gap"), None
        if not row["visible"] or row["x"] is None or row["y"] is None or row["area"] is None:
            if s:
                s["misses"] += 1
                if s["misses"] > misses or row["at"] - s["last"] > missing:
                    return None, out + ended(s, "region_lost")
            return s, out
        if s:
            far = ((row["x"] - s["x"]) ** 2 + (row["y"] - s["y"]) ** 2) ** 0.5 > moved
            if far or not 0.5 * s["area"] <= row["area"] <= 2 * s["area"]:
                out, s = out + ended(s, "region_moved"), None
            elif row["at"] - s["first"] > longest:
                out, s = out + ended(s, "max_duration"), None
        if s is None:
            s = {"first": row["at"], "frames": 0, "x": row["x"], "y": row["y"], "area": row["area"]}
        s |= {"last": row["at"], "frames": s["frames"] + 1, "misses": 0}
        return s, out

    return step, lambda s: ended(s, "stream_stopped")


DWELLS = "started double, ended double, frames long, reason string"


def frame_gate(cadence: float = 0.25, carry: float = 1.5):
    """Row: at, found (detector's answer or null). Out: at, ran, found; an answer is carried forward for up to carry seconds."""

    def step(s, row):
        s = s or {"ran": None, "found": None, "when": None}
        run = s["ran"] is None or row["at"] - s["ran"] >= cadence
        if run:
            s["ran"] = row["at"]
            if row["found"] is not None:
                s |= {"found": row["found"], "when": row["at"]}
        fresh = s["when"] is not None and row["at"] - s["when"] <= carry
        return s, [{"at": row["at"], "ran": run, "found": s["found"] if fresh else None}]

    return step


def keyframe_gates(blur: float = 0.25, lost: float = 0.2, grace: int = 3, degraded: float = 0.4, gap: int = 3, floor: float = 0.75, least: float = 0.02, target: float = 0.05):
    """Row: seq, sharp (ratio), survival, moved (displacement over the diagonal, null: no evidence), overlap. Out: seq, decision, segment.

    Gates in their order: blur, seed, loss held or final after `grace` in a row, degraded, no evidence, too soon, overlap
    about to end, too little motion, enough parallax. A loss ends the segment; the next sharp frame seeds another.
    """

    def step(s, row):
        s = s or {"has": False, "losses": 0, "since": 0, "segment": 0}
        sharp, survival, moved = row["sharp"] or 0.0, row["survival"] or 0.0, row["moved"]
        if sharp < blur:
            verdict = "reject:blurred"
        elif not s["has"]:
            verdict = "accept:session_seed"
        elif survival < lost:
            s["losses"] += 1
            verdict = "lost:tracking_lost" if s["losses"] >= grace else "reject:tracking_held"
        else:
            s["losses"] = 0
            if survival < degraded:
                verdict = "reject:tracking_degraded"
            elif moved is None:
                verdict = "skip:no_motion_evidence"
            elif s["since"] < gap:
                verdict = "skip:rate_limited"
            elif (row["overlap"] or 0.0) < floor:
                verdict = "accept:overlap_floor"
            else:
                verdict = "accept:parallax" if moved >= max(least, target) else "skip:insufficient_motion"
        out = [{"seq": row["seq"], "decision": verdict, "segment": s["segment"]}]
        if verdict.startswith("accept"):
            s |= {"has": True, "since": 0}
        else:
            s["since"] += 1
        if verdict.startswith("lost"):
            s |= {"has": False, "losses": 0, "segment": s["segment"] + 1}
        return s, out

    return step


def bounded_queue(capacity: int = 8):
    """Row: kind (offer or take), item. Out, for each take: item (null: empty queue) and items dropped so far, oldest first."""

    def step(s, row):
        s = s or {"q": [], "dropped": 0}
        if row["kind"] == "offer":
            s["q"].append(row["item"])
            if len(s["q"]) > capacity:
                s["q"].pop(0)
                s["dropped"] += 1
            return s, []
        return s, [{"item": s["q"].pop(0) if s["q"] else None, "dropped": s["dropped"]}]

    return step


def change_feed(heartbeat: float = 2.0, volatile: tuple = ("served_at", "age")):
    """Row: at, payload (JSON object). Out: at, kind (change or heartbeat), revision; volatile fields count for neither."""

    def step(s, row):
        body = json.loads(row["payload"] or "{}")
        seen = json.dumps({k: v for k, v in body.items() if k not in volatile}, sort_keys=True)
        if s is None or seen != s["seen"]:
            s = {"seen": seen, "sent": row["at"], "revision": s["revision"] + 1 if s else 1}
            return s, [{"at": row["at"], "kind": "change", "revision": s["revision"]}]
        if row["at"] - s["sent"] >= heartbeat:
            s["sent"] = row["at"]
            return s, [{"at": row["at"], "kind": "heartbeat", "revision": s["revision"]}]
        return s, []

    return step


def side_hysteresis(low: float = 0.35, high: float = 0.65, margin: float = 0.03):
    """Row: at, x (null: unknown). Out: at, side; to leave a side takes margin more than to stay."""

    def step(s, row):
        x, side = row["x"], s or "centre"
        if x is None:
            return s, [{"at": row["at"], "side": "unknown"}]
        left, right = low + (margin if side == "left" else -margin), high - (margin if side == "right" else -margin)
        side = "left" if x < left else "right" if x > right else "centre"
        return side, [{"at": row["at"], "side": side}]

    return step


def sighting_updates(gap: float = 3.0, mature: int = 3, every: float = 10.0):
    """Row: at, score of one class in one capture. Returns (step, close); out: kind, first_at, last_at, frames, best.

    `record` at the frame that makes a sighting mature, then `update` when the score is better or `every` seconds after the
    last word, and `close` with its final form after a pause over `gap` or at the end. Immature ones say nothing.
    """

    def show(s, kind):
        return {"kind": kind, "first_at": s["first"], "last_at": s["last"], "frames": s["frames"], "best": s["best"]}

    def close(s):
        return [show(s, "close")] if s and s["frames"] >= mature else []

    def step(s, row):
        at, score, out = row["at"], row["score"], []
        if s and at - s["last"] > gap:
            out, s = close(s), None
        if s is None:
            s = {"first": at, "last": at, "frames": 1, "best": score, "said": None}
        else:
            better = score is not None and (s["best"] is None or score > s["best"])
            s |= {"last": at, "frames": s["frames"] + 1, "best": score if better else s["best"]}
            if s["frames"] == mature:
                out.append(show(s, "record"))
                s["said"] = at
            elif s["frames"] > mature and (better or at - s["said"] >= every):
                out.append(show(s, "update"))
                s["said"] = at
        return s, out

    return step, close


UPDATES = "kind string, first_at double, last_at double, frames long, best double"


def publish_slot(heartbeat: float = 2.0):
    """Row: at, what (offer or take), revision. Out, at a take: at, kind (change or heartbeat), revision, coalesced.

    The newest offer replaces one that wasn't taken; it counts as coalesced only if the revision changed. An offer of what
    was sent last is nothing new. A take without news gives a heartbeat, if the last word was long ago.
    """

    def step(s, row):
        s = s or {"pending": None, "coalesced": 0, "sent": None, "said": None}
        if row["what"] == "offer":
            now = s["pending"] if s["pending"] is not None else s["sent"]
            if row["revision"] != now:
                s["coalesced"] += s["pending"] is not None
                s["pending"] = row["revision"]
            return s, []
        if s["pending"] is not None:
            out = [{"at": row["at"], "kind": "change", "revision": s["pending"], "coalesced": s["coalesced"]}]
            return {"pending": None, "coalesced": 0, "sent": s["pending"], "said": row["at"]}, out
        if s["sent"] is not None and row["at"] - s["said"] >= heartbeat:
            s["said"] = row["at"]
            return s, [{"at": row["at"], "kind": "heartbeat", "revision": s["sent"], "coalesced": 0}]
        return s, []

    return step


def segment_index(budget: int = 1):
    """Row: seq, lost, broken (the chain breaks after this keyframe), keyframe. Out: seq, segment.

    A loss opens a segment with its row, a break with the next one; but once `budget` segments without a keyframe were
    opened in a row, no further one is until a keyframe comes.
    """

    def step(s, row):
        s = s or {"segment": 0, "bare": True, "spent": 0, "due": False}
        if (row["lost"] or s["due"]) and (not s["bare"] or s["spent"] < budget):
            s |= {"segment": s["segment"] + 1, "spent": s["spent"] + 1 if s["bare"] else 0, "bare": True}
        if row["keyframe"]:
            s["bare"] = False
        s["due"] = bool(row["broken"])
        return s, [{"seq": row["seq"], "segment": s["segment"]}]

    return step


def content_segments(least: float = 0.45, turn: int = 3, most: int = 6):
    """Row: seq, alike (correlation with the segment's reference; null: no verdict). Returns (step, close); out at the end: segment, first_seq, frames.

    `turn` frames that disagree, with no agreement between, turn the page: they seed the next segment. A frame without a verdict belongs to
    the open segment and neither agrees nor disagrees. Of more than `most` segments the oldest go.
    """

    def step(s, row):
        s = s or {"n": 0, "first": row["seq"], "frames": 0, "pending": [], "closed": []}
        if s["frames"] and row["alike"] is not None and row["alike"] < least:
            s["pending"].append(row["seq"])
            if len(s["pending"]) >= turn:
                s = {"n": s["n"] + 1, "first": s["pending"][0], "frames": len(s["pending"]), "pending": [], "closed": (s["closed"] + [show(s)])[1 - most :] if most > 1 else []}
        elif row["alike"] is None and s["frames"]:
            s["frames"] += 1
        else:
            s["frames"] += 1 + len(s["pending"])
            s["pending"] = []
        return s, []

    def show(s):
        return {"segment": s["n"], "first_seq": s["first"], "frames": s["frames"]}

    def close(s):
        s["frames"] += len(s["pending"])
        return [*s["closed"], show(s)] if s["frames"] else s["closed"]

    return step, close


CONTENT = "segment long, first_seq long, frames long"
