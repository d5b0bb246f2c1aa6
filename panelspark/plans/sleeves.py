"""A book of several sleeves, each a strategy on a universe of its own.

A sleeve has scores, a kind of weights, limits, and spans of bars in which a
symbol belongs to its universe; weights are those among its members. Each is a
run of one accounting job. The book takes the sleeves at equal risk (by the
inverse of their volatilities), and a symbol in several sleeves gets the sum.
"""

from __future__ import annotations

from typing import NamedTuple

from panelspark.functions.vocabulary import Formula
from panelspark.operators import book
from panelspark.operators.book import CELL, Steps, unpivot
from panelspark.plans.catalog import STRATEGIES
from panelspark.plans.studies import OVERLAY, vol_target
from panelspark.sources.panels import PanelQuery, steps_sql


class Sleeve(NamedTuple):
    """``score``: over the columns of a formula. ``members``: (pattern of symbols, first
    bar, bar before which it ends). ``target``: volatility; ``least``: traded value
    below which a symbol is not held short."""

    score: str
    members: tuple[tuple[str, int, int], ...]
    directional: bool = False
    top_k: int = 5
    target: float | None = None
    least: float = 0.0


def _by_run(values: list, of: str = "run_id") -> str:
    return f"(CASE {of} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else v}" for k, v in enumerate(values, 1)) + " END)"


def sleeve_book(formula: Formula, sleeves: list[Sleeve], source: str = "grid", every: int = 7, cost: float = 0.001, short_rate: float = 0.1 / 52, suffix: str = "") -> Steps:
    """``sleeve_shares``: run_id, vol, share; ``sleeve_weights``: run_id, bar_idx, symbol, w
    of each sleeve; ``alpha_book``: symbol, weight, n_sleeves at the last bar.
    ``suffix`` is cut from symbols where the sleeves meet."""
    steps, last = formula.steps(source)
    spans = ", ".join(f"({k}, '{pattern}', {lo}, {hi})" for k, s in enumerate(sleeves, 1) for pattern, lo, hi in s.members)
    name = f"CASE WHEN w.symbol LIKE '%{suffix}' THEN substring(w.symbol, 1, length(w.symbol) - {len(suffix)}) ELSE w.symbol END" if suffix else "w.symbol"
    everywhere = ("all_scores", unpivot(last, CELL, {k: f"({s.score}) * 1e0" for k, s in enumerate(sleeves, 1)}))
    return [
        *steps,
        everywhere,
        ("spans", f"SELECT * FROM (VALUES {spans}) AS v(sleeve, pattern, lo, hi)"),
        ("members", "SELECT DISTINCT s.sleeve, c.bar_idx AS member_bar, n.symbol AS member FROM spans s JOIN (SELECT DISTINCT symbol FROM grid) n ON n.symbol LIKE s.pattern JOIN calendar c ON c.bar_idx >= s.lo AND c.bar_idx < s.hi"),
        ("scored", f"SELECT a.run_id, {', '.join(f'a.{c.strip()}' for c in CELL.split(','))}, CASE WHEN m.member IS NOT NULL THEN a.score END AS score FROM all_scores a LEFT JOIN members m ON m.sleeve = a.run_id AND m.member_bar = a.bar_idx AND m.member = a.symbol"),
        *book.weights("top", _by_run([s.top_k for s in sleeves]), directional=_by_run([str(s.directional).lower() for s in sleeves])),
        *book.limits(_by_run([s.least for s in sleeves])),
        ("ungated", "SELECT run_id, bar_idx, ts, symbol, close, volume, score, w FROM limited"),
        *[(n, t if n == "engine_returns" else _over(t)) for n, t in vol_target(_by_run([s.target for s in sleeves], "g.run_id"), 30, every, 3.0)],
        ("sleeve_weights", f"SELECT t.run_id, t.bar_idx, t.ts, t.symbol, t.close, t.volume, t.score, t.w FROM targeted t WHERE t.bar_idx % {every} = 0 UNION ALL SELECT u.run_id, u.bar_idx, u.ts, u.symbol, u.close, u.volume, u.score, u.w FROM ungated u WHERE u.bar_idx % {every} <> 0"),
        *book.accounting("sleeve_weights", every, cost, short_rate),
        ("sleeve_returns", "SELECT run_id, equity / nullif(lag(equity) OVER (PARTITION BY run_id ORDER BY bar_idx), 0) - 1 AS r FROM equity"),
        ("risks", "SELECT run_id, greatest(stddev_pop(r), 1e-9) AS vol FROM sleeve_returns GROUP BY run_id"),
        ("sleeve_shares", "SELECT run_id, vol, (1 / vol) / sum(1 / vol) OVER () AS share FROM risks"),
        # the book holds what was set at the last rebalance
        ("set_at", f"SELECT max(bar_idx) AS set_bar FROM calendar WHERE bar_idx % {every} = 0"),
        ("alpha_book", f"SELECT {name} AS symbol, sum(s.share * w.w) AS weight, sum(CASE WHEN abs(w.w) > 1e-9 THEN 1 ELSE 0 END) AS n_sleeves FROM sleeve_weights w JOIN sleeve_shares s ON s.run_id = w.run_id JOIN set_at a ON a.set_bar = w.bar_idx GROUP BY {name} HAVING abs(sum(s.share * w.w)) > 1e-6"),
    ]


def _over(text: str) -> str:
    """A step of the volatility target, on the gated weights."""
    return text.replace("FROM weighted", "FROM ungated")


def _fixture() -> tuple[Formula, list[Sleeve]]:
    """Trend and size on a broad universe, and two divergences from an overlay on
    universes that change; they share symbols."""
    g = Formula()
    trend = STRATEGIES["g13_trend_ensemble"](g)
    known = g.delay("tvl", 1)
    size = f"-ln(greatest({g.full_mean('close * volume', 20)}, 1e-9))"
    diverging = lambda n: f"CASE WHEN {g.delay(known, n)} > 0 THEN {known} / {g.delay(known, n)} - 1 END - {g.returns('close', n)}"
    broad, fine = (("%", 0, 10**6),), (("Brand#1%", 0, 200), ("Brand#2%", 100, 10**6), ("Brand#31", 150, 300))
    return g, [Sleeve(trend, broad, True, target=0.3, least=3_500_000), Sleeve(size, broad, least=3_500_000), Sleeve(diverging(20), fine, top_k=3), Sleeve(diverging(10), (*fine, ("Brand#4%", 0, 10**6)), top_k=3)]


def all_sql() -> dict[str, PanelQuery]:
    g, sleeves = _fixture()
    steps = [*OVERLAY, *sleeve_book(g, sleeves, "aligned", every=4, suffix="1")]
    return {
        "l03_alpha_book": steps_sql("w", steps, "SELECT symbol, round(weight, 6) AS weight, n_sleeves FROM alpha_book"),
        "l03_sleeve_weights": steps_sql("w", steps, "SELECT run_id, bar_idx, symbol, round(w, 6) AS w FROM sleeve_weights WHERE bar_idx % 4 = 0"),
    }
