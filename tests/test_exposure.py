"""The exposure fit finds planted gains, and equals a plain loop over arrays."""
import math
import random

import numpy as np
import pytest

from sightline.operators.exposure import exposure_gains

SCHEMA = "scene string, point int, frame int, r double, g double"


def loop(rows, rounds, delta=0.15, least=3):
    """The same rounds with numpy, one scene."""
    count = {}
    for _, p, *_ in rows:
        count[p] = count.get(p, 0) + 1
    rows = [r for r in rows if count[r[1]] >= least]
    points, frames = sorted({r[1] for r in rows}), sorted({r[2] for r in rows})
    p, f = np.array([points.index(r[1]) for r in rows]), np.array([frames.index(r[2]) for r in rows])
    level = np.log(np.maximum(np.array([r[3:] for r in rows]), 1e-4))
    gain, colour = np.zeros((len(frames), 2)), None
    huber = lambda x: np.where(np.abs(x) <= delta, 1.0, delta / np.maximum(np.abs(x), 1e-30))

    def mean(w, x, at, n):
        top, under = np.zeros((n, 2)), np.zeros((n, 2))
        np.add.at(top, at, w * x), np.add.at(under, at, w)
        return top / under

    for _ in range(rounds):
        rest = level - gain[f]
        colour = mean(np.ones_like(rest) if colour is None else huber(rest - colour[p]), rest, p, len(points))
        rest = level - colour[p]
        gain = mean(huber(rest - gain[f]), rest, f, len(frames))
        gain -= gain.mean(axis=0)
    return {x: np.exp(g) for x, g in zip(frames, gain)}


def made(seed, wrong=0.0):
    rnd = random.Random(seed)
    true = {f: math.exp(rnd.uniform(-0.5, 0.5)) for f in range(8)}
    rows = []
    for p in range(60):
        own = rnd.uniform(0.1, 0.5)
        for f in rnd.sample(range(8), rnd.randint(2, 6)):
            c = own * true[f] * (5.0 if rnd.random() < wrong else 1.0)
            rows.append(("s", p, f, min(c, 3.0), min(own * true[f] ** 0.5, 3.0)))
    return true, rows


def test_planted_gains_are_found(spark):
    for wrong, near in ((0.0, 1e-6), (0.05, 0.05)):  # a twentieth of the observations five times too bright
        true, rows = made(1, wrong)
        gains, report = exposure_gains(spark.createDataFrame(rows, SCHEMA), ("r", "g"), rounds=12)
        got = {r.frame: (r.gain_r, r.gain_g) for r in gains.collect()}
        mid = math.exp(sum(map(math.log, true.values())) / len(true))
        assert all(abs(math.log(got[f][0] * mid / true[f])) < near + 0.02 for f in true)
        r = report.first()
        assert r.after < 0.3 * r.before


def test_rounds_equal_a_loop_and_odd_rows(spark):
    _, rows = made(2, 0.1)
    odd = [("s", 900, 77, 0.5, 0.5), ("s", None, 1, 0.5, 0.5), ("s", 901, None, 0.5, 0.5), ("s", 902, 1, None, 0.5), ("t", 1, 1, 0.2, 0.2)]
    gains, _ = exposure_gains(spark.createDataFrame(rows + odd, SCHEMA), ("r", "g"), rounds=3)
    got = {(r.scene, r.frame): (r.gain_r, r.gain_g) for r in gains.collect()}
    for f, g in loop(rows, 3).items():
        assert got["s", f] == pytest.approx(tuple(g), rel=1e-9)
    assert got["s", 77] == got["t", 1] == got["s", None] == (1.0, 1.0)  # nothing that counts: as it is


def test_cells_are_units_of_their_own(spark):
    rows = [("s", p, f, c, 0.3 * (2.0 if c else 1.0), 0.3) for p in range(20) for f in range(3) for c in range(2)]
    gains, _ = exposure_gains(spark.createDataFrame(rows, "scene string, point int, frame int, cell int, r double, g double"), ("r", "g"), ("frame", "cell"), rounds=6)
    got = {(r.frame, r["cell"]): r.gain_r for r in gains.collect()}
    assert all(got[f, 1] / got[f, 0] == pytest.approx(2.0, rel=1e-6) for f in range(3))
