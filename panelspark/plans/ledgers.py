"""Accounts of single assets: many settings by many symbols through one ledger.

Spark takes the ledger in closed form (``operators/paths.py``); the oracle holds
one row of state for each account and walks the bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.vocabulary import Formula
from panelspark.operators import book
from panelspark.operators.paths import ledger
from panelspark.plans.studies import crossover
from panelspark.sources.panels import Both, PanelQuery, steps_sql

SLIP, FEE = 0.0005, 0.001
#: Settings of the study (fixed values): fast and slow mean (0: always long), shorts, share of equity, slippage, commission.
STUDY = {1: (5, 20, False, 1.0, 0.0005, 0.001), 2: (5, 20, True, 1.0, 0.0005, 0.001), 3: (10, 30, True, 0.5, 0.0005, 0.001), 4: (4, 12, False, 0.6, 0.002, 0.0), 5: (0, 0, False, 1.0, 0.0005, 0.001), 6: (8, 21, True, 1.0, 0.0, 0.0)}


def crossover_targets(settings: dict[int, tuple] = STUDY, source: str = "bars") -> book.Steps:
    """``targets``: run_id, bar_idx, symbol, open, close, target for each setting, on each
    symbol's own bars. The sign of fast less slow mean, from the slow mean's first full bar on."""
    mean = lambda n: f"avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    columns, runs = [], {}
    for k, (fast, slow, short, share, *_) in settings.items():
        if fast:
            columns.append(f"round({mean(fast)} - {mean(slow)}, 9) AS s{k}")
            low = -share if short else 0.0
            runs[k] = f"CASE WHEN i < {slow} OR s{k} = 0 THEN 0e0 WHEN s{k} > 0 THEN {share} ELSE {low} END * 1e0"
        else:
            runs[k] = f"{share} * 1e0"
    crossed = f"SELECT symbol, open, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i{''.join(f', {c}' for c in columns)} FROM {source}"
    return [("crossed", crossed), ("targets_by_i", book.unpivot("crossed", "i, symbol, open, close", runs, "target")), ("targets", "SELECT run_id, i AS bar_idx, symbol, open, close, target FROM targets_by_i")]


def _fractions() -> book.Steps:
    """Fractional targets, long and short, from the trend of each symbol."""
    g = Formula()
    trend = g.returns("close", 20)
    steps, last = g.steps()
    return [*steps, ("targets", f"SELECT 1 AS run_id, bar_idx, symbol, open, close, round(4 * {trend}, 6) AS target FROM {last}")]


def _walked(slip: str, fee: str) -> book.Steps:
    """``ledger_rows`` of ``targets`` in the oracle's words."""
    fills = """SELECT t.run_id, t.symbol, t.i, b.pending IS NOT NULL AND b.pending <> b.cur AS fills, CASE WHEN b.pending IS NOT NULL AND b.pending <> b.cur THEN b.pending * (b.money + b.units * t.open) / t.open - b.units ELSE 0e0 END AS delta, b.money, b.units, b.cur, b.pending, t.bar_idx, t.open, t.close, t.target
    FROM fill_path b JOIN placed_targets t ON t.run_id = b.run_id AND t.symbol = b.symbol AND t.i = b.i + 1"""
    path = f"""SELECT DISTINCT run_id, symbol, 0::BIGINT AS i, -1::BIGINT AS bar_idx, 10000e0 AS money, 0e0 AS units, 0e0 AS cur, NULL::DOUBLE AS pending, 10000e0 AS equity, false AS filled FROM targets
  UNION ALL
  SELECT run_id, symbol, i, bar_idx, money1, units1, CASE WHEN fills THEN pending ELSE cur END, CASE WHEN target IS NOT NULL THEN least(greatest(target, -1), 1) END, money1 + units1 * close, fills FROM (
    SELECT *, money - d * open * (1 + {slip} * sign(d)) - abs(d) * open * (1 + {slip} * sign(d)) * {fee} AS money1, units + d AS units1 FROM (
      SELECT *, CASE WHEN abs(delta) < 1e-12 THEN 0e0 ELSE delta END AS d FROM ({fills}) s1) s2) s3"""
    placed = "SELECT *, row_number() OVER (PARTITION BY run_id, symbol ORDER BY bar_idx) AS i FROM targets WHERE open IS NOT NULL AND close IS NOT NULL"
    return [("placed_targets", Both("SELECT 1 AS unused", placed)), ("fill_path", Both("SELECT 1 AS unused", path)), ("ledger_rows", Both("SELECT * FROM targets", "SELECT * FROM fill_path WHERE i > 0"))]


def _setting(at: int) -> str:
    return "(CASE run_id " + " ".join(f"WHEN {k} THEN {v[at]!r}" for k, v in STUDY.items()) + " END)"


_STUDIED = """SELECT run_id, symbol, count(*) AS n_bars, sum(CASE WHEN filled THEN 1 ELSE 0 END) AS n_fills, round(max(CASE WHEN back = 1 THEN equity END), 4) AS equity,
  round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 0e0), 6) AS sharpe, round(min(equity / top - 1), 6) AS max_drawdown
  FROM (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY run_id, symbol ORDER BY bar_idx), 0) - 1 AS r, row_number() OVER (PARTITION BY run_id, symbol ORDER BY bar_idx DESC) AS back,
          max(equity) OVER (PARTITION BY run_id, symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM ledger_rows) x GROUP BY run_id, symbol"""
_SINGLE = "SELECT run_id, bar_idx, symbol, round(units, 6) AS units, round(equity, 4) AS equity FROM ledger_rows"
#: Round trips of long or flat books are the entries; the oracle multiplies the trips' factors instead.
_TRIPS = "SELECT run_id, symbol, n_trips, equity FROM (SELECT run_id, symbol, sum(CASE WHEN filled AND units > 0 THEN 1 ELSE 0 END) AS n_trips, round(max_by(equity, bar_idx), 4) AS equity FROM ledger_rows GROUP BY run_id, symbol) x WHERE n_trips > 0"


def _named() -> dict[str, tuple[PanelQuery, str | float, str | float]]:
    """Name: steps to ``targets`` (and the oracle's ledger) with the result, slippage and commission."""
    trips = steps_sql("w", [*crossover(), ("targets", "SELECT run_id, i AS bar_idx, symbol, open, close, target FROM signals")], _TRIPS)
    return {
        "i10_single_asset": (steps_sql("w", [*_fractions(), *_walked(str(SLIP), str(FEE))], _SINGLE), SLIP, FEE),
        "i11_ledger_study": (steps_sql("w", [*crossover_targets(), *_walked(_setting(4), _setting(5))], _STUDIED), _setting(4), _setting(5)),
        "i11_crossover_study": (trips, SLIP, FEE),
    }


def _query(query: PanelQuery, slip: str | float, fee: str | float) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ledger(PanelQuery(query.steps, "SELECT * FROM targets").run(spark, sf_dir), slip, fee)
        return spark.sql(query.result.replace("FROM ledger_rows", "FROM {rows}"), rows=rows)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*query) for name, query in _named().items()}


def oracle_sql() -> dict[str, str]:
    out = {name: query.duckdb() for name, (query, *_) in _named().items() if name != "i11_crossover_study"}
    trips = f"SELECT run_id, symbol, count(*) AS n_trips, round(10000 * {book.product('f')}, 4) AS equity FROM trips GROUP BY run_id, symbol"
    return out | {"i11_crossover_study": steps_sql("w", crossover(), trips).duckdb()}
