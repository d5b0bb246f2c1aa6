"""The vocabulary against plain NumPy loops, on a ragged panel with ties, gaps and levels."""

import math
import random

import numpy as np
import pytest

from panelspark.functions.vocabulary import Formula
from panelspark.plans import audits

BARS, SYMBOLS = 150, "abcd"


def panel():
    rng = random.Random(21)
    out = {}
    for s in SYMBOLS:
        level = {"a": 0.0, "b": 100.0, "c": 1e6, "d": 5.0}[s]
        xs = np.array([level + (rng.choice([1, 2, 2, 3]) if s == "a" else rng.uniform(-1, 1) * (1e-4 if s == "c" else 1)) for _ in range(BARS)])
        ys = np.array([0.3 * x % 7 + rng.uniform(-1, 1) for x in xs])
        gaps = rng.sample(range(BARS), 12) if s in "bd" else []
        xs[gaps] = np.nan
        ys[[t + 1 for t in gaps if t + 1 < BARS]] = np.nan
        if s == "d":
            xs[90:110] = 4.0  # constant for a while
        out[s] = (xs, ys)
    return out


PANEL = panel()


@pytest.fixture(scope="module")
def grid(spark):
    none = lambda v: None if math.isnan(v) else float(v)
    rows = [(t, s, none(x[t]), none(y[t])) for s, (x, y) in PANEL.items() for t in range(BARS)]
    return spark.createDataFrame(rows, "bar_idx long, symbol string, close double, volume double").repartition(3)


def got(grid, build):
    g = Formula()
    name = build(g)
    out = {s: np.full(BARS, np.nan) for s in SYMBOLS}
    for r in g.apply(grid).select("symbol", "bar_idx", name).collect():
        out[r[0]][r[1]] = np.nan if r[2] is None else float(r[2])
    return out


def along(n, reduce):
    """``reduce`` of the last n values of each symbol (first argument close, second volume)."""
    return {s: np.array([np.nan if t < n - 1 else reduce(x[t - n + 1 : t + 1], y[t - n + 1 : t + 1]) for t in range(BARS)]) for s, (x, y) in PANEL.items()}


def valid(x):
    return x[~np.isnan(x)]


def two_pass(x, y, n):
    """Covariance and correlation of n full pairs, in exact fractions of the level."""
    if np.isnan(x).any() or np.isnan(y).any() or len(x) < n:
        return np.nan, np.nan
    dx, dy = [v - math.fsum(x) / n for v in x], [v - math.fsum(y) / n for v in y]
    xx, yy, xy = math.fsum(d * d for d in dx), math.fsum(d * d for d in dy), math.fsum(a * b for a, b in zip(dx, dy, strict=True))
    return xy / (n - 1), np.nan if xx == 0 or yy == 0 else xy / math.sqrt(xx * yy)


def place(x):
    if np.isnan(x[-1]):
        return np.nan
    v = valid(x)
    return ((v < x[-1]).sum() + ((v == x[-1]).sum() + 1) / 2) / len(v)


def since(x, best):
    v = valid(x)
    return np.nan if not len(v) else len(x) - 1 - int(np.flatnonzero(x == best(v))[0])


CASES = {
    "mean": (lambda g, n: g.ts_mean("close", n), lambda n: lambda x, _: np.mean(valid(x)) if len(valid(x)) else np.nan),
    "sum": (lambda g, n: g.ts_sum("close", n), lambda n: lambda x, _: math.fsum(valid(x))),
    "std": (lambda g, n: g.ts_std("close", n), lambda n: lambda x, _: np.std(valid(x) - valid(x)[0], ddof=1) if len(valid(x)) > 1 else np.nan),
    "max": (lambda g, n: g.ts_max("close", n), lambda n: lambda x, _: max(valid(x), default=np.nan)),
    "min": (lambda g, n: g.ts_min("close", n), lambda n: lambda x, _: min(valid(x), default=np.nan)),
    "argmax": (lambda g, n: g.ts_argmax("close", n), lambda n: lambda x, _: since(x, max)),
    "argmin": (lambda g, n: g.ts_argmin("close", n), lambda n: lambda x, _: since(x, min)),
    "rank": (lambda g, n: g.ts_rank("close", n), lambda n: lambda x, _: place(x)),
    "cov": (lambda g, n: g.ts_cov("close", "volume", n), lambda n: lambda x, y: two_pass(x, y, n)[0]),
    "corr": (lambda g, n: g.ts_corr("close", "volume", n), lambda n: lambda x, y: two_pass(x, y, n)[1]),
    "decay": (lambda g, n: g.decay_linear("close", n), lambda n: lambda x, _: float(np.dot(x, np.arange(1, n + 1)) / (n * (n + 1) / 2))),
}


@pytest.mark.parametrize("n", [2, 7, 64, 100])
def test_along_symbols(grid, n):
    """Short frames as windows, long ones (from 64 on) from two runs, as the plain loops; also on a level of a million with steps of 1e-4."""
    g, names = Formula(), {}
    for name, (build, _) in CASES.items():
        names[name] = build(g, n)
    rows = g.apply(grid).select("symbol", "bar_idx", *names.values()).collect()
    for k, (name, (_, reduce)) in enumerate(CASES.items()):
        want = along(n, reduce(n))
        for r in rows:
            mine, plain = r[2 + k], want[r[0]][r[1]]
            if name == "rank" and r[0] == "c":
                continue  # places compare twelve digits
            close = dict(rel=1e-6 if r[0] == "c" else 1e-9, abs=1e-9)
            assert (mine is None) == bool(np.isnan(plain)), (name, n, r[0], r[1], mine, plain)
            assert mine is None or mine == pytest.approx(plain, **close), (name, n, r[0], r[1])


def test_across_symbols(grid):
    x = np.array([PANEL[s][1] for s in SYMBOLS])
    ranks, z, scaled = got(grid, lambda g: g.rank("volume")), got(grid, lambda g: g.zscore("volume")), got(grid, lambda g: g.scale("volume", 2.0))
    for t in range(BARS):
        v = valid(x[:, t])
        for i, s in enumerate(SYMBOLS):
            if np.isnan(x[i, t]):
                assert np.isnan([ranks[s][t], z[s][t], scaled[s][t]]).all()
                continue
            assert ranks[s][t] == pytest.approx(((v < x[i, t]).sum() + ((v == x[i, t]).sum() + 1) / 2) / len(v))
            assert z[s][t] == pytest.approx((x[i, t] - v.mean()) / v.std(ddof=1))
            assert scaled[s][t] == pytest.approx(2 * x[i, t] / np.abs(v).sum())


def test_several_ranks_are_one_sort(spark, grid):
    """The narrow form of a batch with several ranks has the values of the plain one."""
    g = Formula()
    names = [g.rank("close"), g.rank("volume"), g.rank("close + volume"), g.zscore("volume"), g.rank(g.delta("close", 2))]
    grid.createOrReplaceTempView("ranked_grid")
    steps, last = g.steps("ranked_grid", ("bar_idx", "symbol", "close", "volume"), names)
    sql = ", ".join(f"{n} AS ({t})" for n, t in steps)
    assert "stack(" in sql
    rows = lambda df: sorted(str([None if v is None else f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert rows(spark.sql(f"WITH {sql} SELECT symbol, bar_idx, {', '.join(names)} FROM {last}")) == rows(g.apply(grid).select("symbol", "bar_idx", *names))


def test_sides_change_seldom():
    """All alphas need four layouts: by symbol, by bar, by symbol, by bar."""
    g, _ = audits._all_alphas()
    sides = [("symbol" if "PARTITION BY symbol" in e else "bar") for batch in g.levels() for _, e in batch if "PARTITION BY" in e]
    assert 1 + sum(a != b for a, b in zip(sides, sides[1:], strict=False)) <= 4
