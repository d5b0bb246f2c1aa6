"""The registered alphas: formulas over the vocabulary, with themes and warm-ups."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from panelspark.functions.vocabulary import Formula


class Alpha(NamedTuple):
    name: str
    build: Callable[[Formula], str]
    warmup: int
    theme: tuple[str, ...]


ALPHAS: dict[str, Alpha] = {}


def alpha(name: str, warmup: int, *theme: str) -> Callable:
    """Register a formula builder; a name can be taken once."""

    def register(build: Callable[[Formula], str]) -> Callable[[Formula], str]:
        if name in ALPHAS:
            raise ValueError(f"alpha {name} is registered already")
        ALPHAS[name] = Alpha(name, build, warmup, theme)
        return build

    return register


def _slope(g: Formula) -> str:
    """Change of the slope of the close over ten bars."""
    c10, c20 = g.delay("close", 10), g.delay("close", 20)
    return g.let(f"({c20} - {c10}) / 10 - ({c10} - close) / 10")


def _product_of_sums(g: Formula) -> str:
    return g.let(f"{g.ts_sum('open', 5)} * {g.ts_sum(g.returns(), 5)}")


def _one_bar_trend(g: Formula) -> str:
    d = g.delta("close", 1)
    return g.where(f"{g.ts_min(d, 5)} > 0 OR {g.ts_max(d, 5)} < 0", d, f"-{d}")


def _long_slope(g: Formula) -> str:
    slow = g.safe_div(g.delta(g.ts_mean("close", 100), 100), g.delay("close", 100))
    return g.where(f"{slow} <= 0.05", f"-(close - {g.ts_min('close', 100)})", f"-{g.delta('close', 3)}")


_FORMULAS: list[tuple[str, int, str, Callable[[Formula], str]]] = [
    ("alpha101_001", 30, "reversal volatility", lambda g: f"{g.rank(g.ts_argmax(g.signed_power(g.let(g.where(f'{g.returns()} < 0', g.ts_std(g.returns(), 20), 'close')), 2), 5))} - 0.5"),
    ("alpha101_002", 12, "volume", lambda g: f"-{g.ts_corr(g.rank(g.delta('CASE WHEN volume > 0 THEN ln(volume) END', 2)), g.rank(g.safe_div('close - open', 'open')), 6)}"),
    ("alpha101_003", 12, "volume", lambda g: f"-{g.ts_corr(g.rank('open'), g.rank('volume'), 10)}"),
    ("alpha101_004", 12, "reversal", lambda g: f"-{g.ts_rank(g.rank('low'), 9)}"),
    ("alpha101_006", 12, "volume", lambda g: f"-{g.ts_corr('open', 'volume', 10)}"),
    ("alpha101_008", 20, "reversal", lambda g: f"-{g.rank(g.delta(_product_of_sums(g), 10))}"),
    ("alpha101_009", 10, "momentum reversal", _one_bar_trend),
    ("alpha101_012", 3, "volume reversal", lambda g: f"sign({g.delta('volume', 1)}) * -{g.delta('close', 1)}"),
    ("alpha101_013", 8, "volume", lambda g: f"-{g.rank(g.ts_cov(g.rank('close'), g.rank('volume'), 5))}"),
    ("alpha101_014", 14, "volume reversal", lambda g: f"-{g.rank(g.delta(g.returns(), 3))} * {g.ts_corr('open', 'volume', 10)}"),
    ("alpha101_016", 8, "volume", lambda g: f"-{g.rank(g.ts_cov(g.rank('high'), g.rank('volume'), 5))}"),
    ("alpha101_018", 14, "reversal", lambda g: f"-{g.rank(g.ts_std('abs(close - open)', 5) + ' + (close - open) + ' + g.ts_corr('close', 'open', 10))}"),
    ("alpha101_019", 260, "momentum", lambda g: f"-sign((close - {g.delay('close', 7)}) + {g.delta('close', 7)}) * (1 + {g.rank('1 + ' + g.ts_sum(g.returns(), 250))})"),
    ("alpha101_023", 25, "reversal", lambda g: g.where(f"{g.ts_mean('high', 20)} < high", f"-{g.delta('high', 2)}", "0.0")),
    ("alpha101_024", 110, "reversal", _long_slope),
    ("alpha101_026", 16, "volume", lambda g: f"-{g.ts_max(g.ts_corr(g.ts_rank('volume', 5), g.ts_rank('high', 5), 5), 3)}"),
    ("alpha101_028", 28, "volume", lambda g: g.scale(f"{g.ts_corr(g.adv(20), 'low', 5)} + (high + low) / 2 - close")),
    ("alpha101_032", 240, "reversal", lambda g: f"{g.scale(g.ts_mean('close', 7) + ' - close')} + 20 * {g.scale(g.ts_corr(g.vwap(), g.delay('close', 5), 230))}"),
    ("alpha101_033", 3, "reversal", lambda g: g.rank(f"-(1 - {g.safe_div('open', 'close')})")),
    ("alpha101_034", 10, "volatility reversal", lambda g: g.rank(f"2 - {g.rank(g.safe_div(g.ts_std(g.returns(), 2), g.ts_std(g.returns(), 5)))} - {g.rank(g.delta('close', 1))}")),
    ("alpha101_035", 36, "volume", lambda g: f"{g.ts_rank('volume', 32)} * (1 - {g.ts_rank('close + high - low', 16)}) * (1 - {g.ts_rank(g.returns(), 32)})"),
    ("alpha101_038", 14, "reversal", lambda g: f"-{g.rank(g.ts_rank('close', 10))} * {g.rank(g.safe_div('close', 'open'))}"),
    ("alpha101_040", 14, "volatility volume", lambda g: f"-{g.rank(g.ts_std('high', 10))} * {g.ts_corr('high', 'volume', 10)}"),
    ("alpha101_041", 3, "price", lambda g: f"CASE WHEN high * low > 0 THEN sqrt(high * low) END - {g.vwap()}"),
    ("alpha101_043", 30, "volume reversal", lambda g: f"{g.ts_rank(g.safe_div('volume', g.ts_mean('volume', 20)), 20)} * {g.ts_rank('-' + g.delta('close', 7), 8)}"),
    ("alpha101_044", 8, "volume", lambda g: f"-{g.ts_corr('high', g.rank('volume'), 5)}"),
    ("alpha101_046", 25, "reversal", lambda g: f"CASE WHEN {_slope(g)} > 0.25 THEN -1.0 WHEN {_slope(g)} < 0 THEN 1.0 ELSE -{g.delta('close', 1)} END"),
    ("alpha101_049", 25, "reversal", lambda g: g.where(f"{_slope(g)} < -0.1", "1.0", f"-{g.delta('close', 1)}")),
    ("alpha101_051", 25, "reversal", lambda g: g.where(f"{_slope(g)} < -0.05", "1.0", f"-{g.delta('close', 1)}")),
    ("alpha101_053", 12, "price", lambda g: f"-{g.delta(g.safe_div('(close - low) - (high - close)', 'close - low'), 9)}"),
    ("alpha101_054", 3, "price", lambda g: g.safe_div("-(low - close) * power(open, 5)", "(low - high) * power(close, 5)")),
    ("alpha101_101", 2, "price", lambda g: "(close - open) / ((high - low) + 0.001)"),
    ("academic_strev", 8, "reversal", lambda g: f"-{g.returns('close', 5)}"),
    ("academic_mom", 35, "momentum", lambda g: g.safe_div(f"{g.delay('close', 7)} - {g.delay('close', 30)}", g.delay("close", 30))),
    ("academic_illiq", 25, "liquidity", lambda g: g.ts_mean(g.safe_div(f"abs({g.returns()})", "close * volume"), 20)),
    ("academic_high52w", 370, "momentum", lambda g: g.safe_div("close", g.ts_max("high", 365))),
    ("academic_ivol", 35, "volatility", lambda g: f"-{g.ts_std(g.returns(), 30)}"),
    ("academic_maxret", 25, "lottery", lambda g: f"-{g.ts_max(g.returns(), 20)}"),
    ("academic_decay_mom", 25, "momentum", lambda g: g.decay_linear(g.returns(), 20)),
    ("academic_argmin_low", 35, "reversal", lambda g: g.ts_argmin("low", 30)),
    ("academic_volume_trend", 35, "volume", lambda g: g.rank(g.safe_div(g.adv(5), g.adv(30)))),
]

for _name, _warmup, _theme, _build in _FORMULAS:
    alpha(_name, _warmup, *_theme.split())(_build)


def formula(name: str, column: str = "value") -> Formula:
    """The columns of an alpha; the last, named ``column``, is its finite score."""
    g = Formula()
    last = g.finite(ALPHAS[name].build(g))
    g.columns.append((column, last))
    return g
