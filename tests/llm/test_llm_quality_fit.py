"""The solver of the ordinal classifier against plain coordinate descent, without Spark."""

import numpy as np
import pytest

from textreuse.llm import quality


def case(seed, n=150, width=12):
    rng = np.random.default_rng(seed)
    x = [np.flatnonzero(rng.random(width) < 0.4) for _ in range(n)]
    truth = rng.normal(size=width) * 2
    z = np.array([truth[r].sum() for r in x])
    return x, (z + rng.logistic(size=n) > -1).astype(int) + (z + rng.logistic(size=n) > 1.5)


def loss(x, grades, v, l1=1e-3, width=12):
    s = np.array([v[r].sum() for r in x])
    edges = np.column_stack([np.ones(len(x)), *(1 / (1 + np.exp(-(s - t))) for t in v[width:]), np.zeros(len(x))])
    p = edges[np.arange(len(x)), grades] - edges[np.arange(len(x)), grades + 1]
    return -np.log(p).mean() + l1 * np.abs(v[:width]).sum() if (p > 0).all() else np.inf


def point(model, width=12):
    v = np.concatenate([np.zeros(width), model.thresholds])
    v[model.buckets] = model.weights
    return v


@pytest.mark.parametrize("seed", range(20))
def test_the_loss_never_rises(seed):
    x, grades = case(seed)
    run = [loss(x, grades, point(quality.fit(x, grades, 3, 20, l1=1e-3, turns=t))) for t in (1, 2, 5, 10, 30, 60, 200, 2000)]
    assert all(b <= a + 1e-12 for a, b in zip(run, run[1:], strict=False)) and run[-2] - run[-1] < 1e-4
    rng, best = np.random.default_rng(seed), point(quality.fit(x, grades, 3, 20, l1=1e-3, turns=2000))
    for size in (0.1, 0.01, 0.001):
        for _ in range(50):
            assert loss(x, grades, best + rng.normal(size=14) * size) > run[-1] - 1e-8


@pytest.mark.parametrize("seed", [2, 4])
def test_coordinate_descent_ends_at_the_same_loss(seed):
    x, grades = case(seed)
    v, best = np.concatenate([np.zeros(12), [-1.0, 1.0]]), np.inf
    while True:
        before = best
        for k in range(14):
            lo, hi = v[k] - 1, v[k] + 1
            for _ in range(30):  # the loss is convex along a coordinate
                a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
                one, two = (np.where(np.arange(14) == k, y, v) for y in (a, b))
                lo, hi = (lo, b) if loss(x, grades, one) < loss(x, grades, two) else (a, hi)
            for y in ((lo + hi) / 2, 0.0):
                there = np.where(np.arange(14) == k, y, v)
                if (now := loss(x, grades, there)) < best:
                    best, v = now, there
        if before - best < 1e-8:
            break
    assert loss(x, grades, point(quality.fit(x, grades, 3, 20, l1=1e-3, turns=4000))) == pytest.approx(best, abs=1e-6)


def test_grades_that_nobody_has():
    x, grades = case(3)
    model = quality.fit(x, np.where(grades == 1, 2, grades), 3, 20)
    assert model.thresholds[0] <= model.thresholds[1] and np.isfinite(model.tails(x)).all()
    assert np.isfinite(quality.fit(x, np.minimum(grades, 1), 3, 20).tails(x)).all()
    assert quality.ordered(np.array([3.0, 1.0, 2.0, 5.0])).tolist() == [2.0, 2.0, 2.0, 5.0]
