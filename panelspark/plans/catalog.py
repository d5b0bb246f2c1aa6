"""The queries of the panel engine as SQL over the fixture panels.

Values are rounded to six digits so that the order in which an engine adds
floats does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from panelspark.functions.vocabulary import Formula
from panelspark.operators import book
from panelspark.plans import alphas
from panelspark.sources.panels import PanelQuery, steps_sql

VALUE = "SELECT bar_idx, symbol, CAST(round(CAST(value AS DOUBLE), 6) AS DOUBLE) AS value FROM {last}"


def formula_sql(build: Callable[[Formula], str], panel: str = "w") -> PanelQuery:
    """The value of a formula in every cell."""
    g = Formula()
    g.columns.append(("value", f"({build(g)}) * 1e0"))
    steps, last = g.steps()
    return steps_sql(panel, steps, VALUE.format(last=last))


#: Factor operators, on the ragged daily panel where nulls matter and on the weekly one.
FACTORS: dict[str, tuple[str, Callable[[Formula], str]]] = {
    "d01_rank": ("d", lambda g: g.rank("close")),
    "d02_zscore": ("d", lambda g: g.zscore("volume")),
    "d03_scale": ("d", lambda g: g.scale("close - open")),
    "d04_ts_mean": ("d", lambda g: g.ts_mean("close", 10)),
    "d05_ts_sum": ("d", lambda g: g.ts_sum("volume", 5)),
    "d06_ts_std": ("d", lambda g: g.ts_std("close", 10)),
    "d07_ts_max": ("d", lambda g: g.ts_max("high", 20)),
    "d08_ts_min": ("d", lambda g: g.ts_min("low", 20)),
    "d09_ts_argmax": ("w", lambda g: g.ts_argmax("volume", 10)),
    "d10_ts_argmin": ("w", lambda g: g.ts_argmin("volume", 10)),
    "d11_ts_rank": ("d", lambda g: g.ts_rank("close", 8)),
    "d12_ts_corr": ("w", lambda g: g.ts_corr("close", "volume", 10)),
    "d13_ts_cov": ("w", lambda g: g.ts_cov("close", "volume", 10)),
    "d14_delay": ("d", lambda g: g.delay("close", 3)),
    "d15_delta": ("d", lambda g: g.delta("close", 3)),
    "d16_decay_linear": ("w", lambda g: g.decay_linear("close", 10)),
    "d17_signed_power": ("d", lambda g: g.signed_power("close - open", 0.5)),
    "d18_safe_div": ("d", lambda g: g.safe_div("close - low", "high - low")),
    "d19_returns": ("d", lambda g: g.returns("close", 1)),
    "d20_vwap": ("d", lambda g: g.vwap()),
    "d21_adv": ("d", lambda g: g.adv(20)),
    "d22_finite": ("d", lambda g: g.finite("exp(CASE WHEN close > 6500 THEN 100 * close ELSE close / 100 END)")),
    "d23_elementwise": ("d", lambda g: "least(greatest(ln(1 + volume), 1), 5) + sqrt(abs(close - open)) + sign(close - open) + log10(close)"),
}

#: Score producers: panel, bars needed, score.
STRATEGIES: dict[str, Callable[[Formula], str]] = {
    "g01_reversal": lambda g: f"-{g.returns('close', 1)}",
    "g02_momentum": lambda g: g.returns("close", 20),
    "g03_funding_carry": lambda g: "-10000 * avg(coalesce(discount - 0.05, 0.0) / 100) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "g04_low_vol": lambda g: f"CASE WHEN bar_idx > 20 THEN -{g.full('stddev_pop', g.returns(), 20)} END",
    "g05_value": lambda g: f"CASE WHEN bar_idx >= 30 THEN -(close / nullif({g.full_mean('close', 30)}, 0) - 1) END",
    "g06_size": lambda g: f"-ln(greatest({g.full_mean('close * volume', 30)}, 1e-9))",
    "g07_max_return": lambda g: f"CASE WHEN bar_idx > 20 THEN -{g.full('max', g.returns(), 20)} END",
    "g08_residual_momentum": lambda g: f"CASE WHEN bar_idx > 20 THEN {g.full('sum', _residual(g), 20)} END",
    "g09_illiquidity": lambda g: f"CASE WHEN bar_idx > 20 THEN {g.full_mean(f'abs({g.returns()}) / greatest(close * volume, 1e-9)', 20)} END * 1000000",
    "g10_overlay_momentum": lambda g: f"CASE WHEN {g.delay(_overlay(g), 8)} > 0 THEN {_overlay(g)} / {g.delay(_overlay(g), 8)} - 1 END",
    "g11_overlay_divergence": lambda g: f"CASE WHEN {g.delay(_overlay(g), 8)} > 0 THEN {_overlay(g)} / {g.delay(_overlay(g), 8)} - 1 END - {g.returns('close', 8)}",
    "g12_trend": lambda g: f"sign({g.returns('close', 20)})",
    "g13_trend_ensemble": lambda g: f"CASE WHEN bar_idx >= 30 THEN (sign({g.returns('close', 10)}) + sign({g.returns('close', 20)}) + sign({g.returns('close', 30)})) / 3 WHEN bar_idx >= 20 THEN (sign({g.returns('close', 10)}) + sign({g.returns('close', 20)})) / 2 WHEN bar_idx >= 10 THEN sign({g.returns('close', 10)}) END",
    "g14_ma_crossover": lambda g: _crossover(g, 10, 30, False),
    "g14_ma_crossover_short": lambda g: _crossover(g, 10, 30, True),
    "g15_buy_and_hold": lambda g: "1.0",
    "g16_equal_weight": lambda g: "CASE WHEN close IS NOT NULL THEN 1.0 END",
    "g17_formulaic": lambda g: f"CASE WHEN bar_idx >= 8 THEN {alphas.ALPHAS['academic_strev'].build(g)} END",
}


def _crossover(g: Formula, fast: int, slow: int, allow_short: bool) -> str:
    """1 where the fast mean is above the slow one, else 0 or -1; flat before ``slow`` bars."""
    long, short = g.full_mean("close", slow), "-1.0" if allow_short else "0.0"
    return f"CASE WHEN {long} IS NULL THEN 0.0 WHEN round({g.full_mean('close', fast)} - {long}, 9) > 0 THEN 1.0 ELSE {short} END"


def _residual(g: Formula) -> str:
    """Return less the mean return of the bar; missing where one symbol is."""
    r = g.returns()
    return g.let(f"CASE WHEN count({r}) OVER (PARTITION BY bar_idx) = count(*) OVER (PARTITION BY bar_idx) THEN {r} - avg({r}) OVER (PARTITION BY bar_idx) END")


def _overlay(g: Formula) -> str:
    """A sparse overlay: seen every third bar, carried forward, used one bar later."""
    seen = g.let("CASE WHEN bar_idx % 3 = 0 THEN traded END")
    block = g.let(f"count({seen}) OVER (PARTITION BY symbol ORDER BY bar_idx)")
    filled = g.let(f"max({seen}) OVER (PARTITION BY symbol, {block})")
    return g.delay(filled, 1)


def all_sql() -> dict[str, PanelQuery | str]:
    out = {name: formula_sql(build, panel) for name, (panel, build) in FACTORS.items()}
    for number, name in enumerate(alphas.ALPHAS, 1):
        steps, last = alphas.formula(name).steps()
        out[f"e{number:02d}_{name}"] = steps_sql("d" if alphas.ALPHAS[name].warmup > 357 else "w", steps, VALUE.format(last=last))
    out |= {name: formula_sql(build) for name, build in STRATEGIES.items()}
    return out | book.all_sql()
