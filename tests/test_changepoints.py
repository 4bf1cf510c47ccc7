"""Sparse slope changes: planted ones, none on a line, and the path beside its optimality conditions."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import month
from tidemill.operators import additive, gram
from tidemill.operators.calendar_effects import hinge_positions

PLAIN = additive.AdditiveConfig(yearly=False, extra={})


def series(spark, curves):
    rows = [(k, month(i, (2000, 1)), float(v)) for k, values in curves.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts date, y double")


def test_planted_breaks_are_found_and_lines_have_none(spark):
    rng = np.random.default_rng(7)
    t = np.arange(120)
    season = 12 * np.sin(2 * np.pi * t / 12)
    curves = {
        "line": 5 + 3 * t,
        "noisy line": 5 + 3 * t + rng.normal(size=120) * 8,
        "flat": np.full(120, 4.0),
        "one": np.where(t < 60, 10 * t, 600 - 6 * (t - 60)) + rng.normal(size=120) * 4,
        "two": 2 * t + np.where(t > 40, 9 * (t - 40), 0) - np.where(t > 80, 14 * (t - 80), 0) + rng.normal(size=120) * 3,
        None: np.where(t < 60, 10 * t, 600 - 6 * (t - 60)) + season + rng.normal(size=120) * 3,
    }
    got = {}
    for r in additive.sparse_changepoints(series(spark, curves), ["k"]).collect():
        got.setdefault(r.k, []).append(r)
    assert all(len(rows) == 25 and all(r.selected == (r.delta != 0) for r in rows) for rows in got.values())
    bends = {k: sorted((r.position, r.delta) for r in rows if r.selected) for k, rows in got.items()}
    assert bends["line"] == bends["noisy line"] == bends["flat"] == []
    for k, planted in {"one": [(0.5, -16)], "two": [(1 / 3, 9), (2 / 3, -14)], None: [(0.5, -16)]}.items():
        for place, change in planted:
            near = [d for p, d in bends[k] if abs(p - place) < 0.07]
            assert near and sum(near) == pytest.approx(change * 119, rel=0.25), (k, bends[k])
        assert all(any(abs(p - place) < 0.07 for place, _ in planted) for p, _ in bends[k])
        assert len(bends[k]) <= 2 * len(planted)


def test_path_meets_its_conditions_and_equals_a_fit_on_rows():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 90)
    spots = hinge_positions(25)
    hinges = np.maximum(t[:, None] - np.array(spots)[None], 0)
    y = 3 + 5 * t + 20 * np.maximum(t - spots[9], 0) + rng.normal(size=90) * 0.1
    z = np.column_stack([np.ones(90), t, hinges, y])
    sparse = gram.Sparse((z.T @ z).ravel(), range(1, 26), [0])
    base = np.column_stack([np.ones(90), t])
    off = lambda v: v - base @ np.linalg.lstsq(base, v, rcond=None)[0]
    x, r = off(hinges), off(y)
    unit = x / np.sqrt((x**2).mean(0))
    for alpha, b in sparse.path()[::6]:
        level = np.sqrt((y**2).mean())
        pull = unit.T @ (r / level - unit @ b) / 90
        assert np.all(np.abs(pull) <= alpha * (1 + 1e-3) + 1e-6) and np.allclose(pull[b != 0], alpha * np.sign(b[b != 0]), atol=1e-4)
    best = sparse.best()
    own = np.flatnonzero(best)
    assert 9 in own or {8, 10} & set(own.tolist())
    assert best[own] == pytest.approx(np.linalg.lstsq(x[:, own], r, rcond=None)[0], rel=1e-5)


def test_edges(spark):
    df = series(spark, {"short": [1.0, 2.0], "one": [3.0], "none": []})
    got = additive.sparse_changepoints(df, ["k"], PLAIN).collect()
    assert len(got) == 50 and not any(r.selected for r in got)
    assert additive.sparse_changepoints(df.where("false"), ["k"]).count() == 0
    factors = series(spark, {"a": np.exp(np.where(np.arange(80) < 40, 0.05 * np.arange(80), 2 - 0.05 * (np.arange(80) - 40)))})
    bent = [r for r in additive.sparse_changepoints(factors, [], additive.AdditiveConfig(yearly=False, extra={}, mode="multiplicative")).collect() if r.selected]
    assert bent and all(abs(r.position - 0.5) < 0.07 for r in bent)
