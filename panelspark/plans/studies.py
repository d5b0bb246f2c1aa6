"""Queries on sources, joins, measures, validation, sleeves, accounts and fills.

One SQL text is the query and its oracle. Where the two dialects name a
function differently the text has a token (``MILLIS[x]``, ``DAYS[a|b]``,
``MATCHES[x|pattern]``) that is replaced for each.
"""

from __future__ import annotations

import re

from panelspark.functions.vocabulary import Formula
from panelspark.operators import book
from panelspark.operators.book import CELL, LAST, RATE, Steps, product, strategy_scores, unpivot
from panelspark.plans import alphas
from panelspark.sources.panels import Both, PanelQuery, steps_sql

SYMBOL = "PARTITION BY symbol ORDER BY bar_idx"

#: An overlay seen every third bar, filled forward on the bar timeline: in Spark by the last valid value, so
#: that the window before and after it have one sort.
OVERLAY: Steps = [
    ("sparse", "SELECT *, CASE WHEN bar_idx % 3 = 0 THEN traded END AS seen FROM grid"),
    ("blocks", f"SELECT *, count(seen) OVER ({SYMBOL}) AS block FROM sparse"),
    ("aligned", Both(f"SELECT *, last_value(seen, true) OVER ({SYMBOL} {LAST}) AS tvl FROM sparse", "SELECT *, max(seen) OVER (PARTITION BY symbol, block) AS tvl FROM blocks")),
]

#: Return of each symbol, and of the market on bars where all have one.
MARKET: Steps = [
    ("symbol_returns", f"SELECT bar_idx, ts, symbol, close / nullif(lag(close) OVER ({SYMBOL}), 0) - 1 AS r FROM grid"),
    ("market", "SELECT bar_idx, ts, avg(r) AS m FROM symbol_returns GROUP BY bar_idx, ts HAVING count(r) = count(*)"),
]


def _values(name: str, columns: str, rows: list[tuple]) -> tuple[str, str]:
    return name, f"SELECT * FROM (VALUES {', '.join(map(str, rows)) if len(rows[0]) > 1 else ', '.join(f'({r[0]})' for r in rows)}) AS v({columns})"


def _base(lookback: int = 1, sign: int = -1) -> Steps:
    """The scores of one lookback, under the name ``base``."""
    *steps, (_, last) = book.scores((lookback,), sign)
    return [*steps, ("base", last)]


def bench() -> tuple[Steps, dict[int, str]]:
    """``scored`` for all alphas, with the following return: layouts by symbol and by bar alternate, the last is by bar."""
    g, columns = Formula(), {}
    for k, a in enumerate(alphas.ALPHAS.values(), 1):
        columns[k] = f"CASE WHEN bar_idx >= {a.warmup} THEN {g.finite(a.build(g))} END"
    fields = ("bar_idx", "symbol", "open", "high", "low", "close", "volume", "fwd")
    steps, last = g.steps("ahead_grid", fields, ["fwd", *columns.values()])
    wide = ("wide", f"SELECT bar_idx, fwd, {', '.join(f'{x} AS s{k}' for k, x in columns.items())} FROM {last}")
    scored = ("scored", unpivot("wide", "bar_idx, fwd", {k: f"s{k} * 1e0" for k in columns}))
    return [("ahead_grid", f"SELECT *, {book.AHEAD.format(1, '')} FROM grid"), *steps, wide, scored], {k: a.name for k, a in enumerate(alphas.ALPHAS.values(), 1)}


def vol_target(target: float | str = 0.10, lookback: int = 20, every: int = 4, most: float = 2.0, per_year: int = 52) -> Steps:
    """``targeted``: weights scaled to a volatility (an SQL expression of ``run_id``; null:
    as they are). The variance w'Cw of a book is that of its past returns under
    today's weights, so no covariance is built."""
    return [
        ("engine_returns", f"SELECT bar_idx, symbol, coalesce(close / nullif(lag(close) OVER ({SYMBOL}), 0) - 1, 0.0) AS r FROM grid"),
        _values("offsets", "back", [(k,) for k in range(lookback)]),
        ("reached", f"SELECT w.run_id, w.bar_idx, w.symbol, w.w, w.bar_idx - o.back AS s FROM weighted w CROSS JOIN offsets o WHERE w.bar_idx % {every} = 0"),
        ("past", "SELECT w.run_id, w.bar_idx, w.s, sum(w.w * r.r) AS b FROM reached w JOIN engine_returns r ON r.symbol = w.symbol AND r.bar_idx = w.s WHERE w.s >= 1 GROUP BY w.run_id, w.bar_idx, w.s"),
        ("vols", f"SELECT run_id, bar_idx, count(*) AS n, sqrt(var_samp(b) * {per_year}) AS vol FROM past GROUP BY run_id, bar_idx HAVING count(*) > 1"),
        ("grossed", "SELECT *, sum(abs(w)) OVER (PARTITION BY run_id, bar_idx) AS book_gross FROM weighted"),
        ("targeted", f"SELECT g.run_id, g.bar_idx, g.ts, g.symbol, g.close, g.volume, g.score, g.w * CASE WHEN v.n >= 5 AND v.vol > 1e-9 AND ({target}) IS NOT NULL THEN least(({target}) / nullif(v.vol, 0), {most} / nullif(g.book_gross, 0)) ELSE 1.0 END AS w FROM grossed g LEFT JOIN vols v ON v.run_id = g.run_id AND v.bar_idx = g.bar_idx"),
    ]


def crossover(params: tuple[tuple[int, int], ...] = ((5, 20), (10, 30), (4, 12)), slip: float = 0.0005, fee: float = 0.001) -> Steps:
    """``trips``: round trips of a long or flat moving-average book, filled at the
    open after the signal; each multiplies the equity by its factor."""
    key = "PARTITION BY run_id, symbol ORDER BY i"
    mean = lambda n: f"avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    signal = " UNION ALL ".join(f"SELECT {k} AS run_id, i, symbol, ts, open, close, CASE WHEN i >= {slow} AND round({mean(fast)} - {mean(slow)}, 9) > 0 THEN 1 ELSE 0 END AS target FROM own_bars" for k, (fast, slow) in enumerate(params, 1))
    return [
        ("own_bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars"),
        ("signals", signal),
        ("positions", f"SELECT *, coalesce(lag(target) OVER ({key}), 0) AS pos, coalesce(lag(target, 2) OVER ({key}), 0) AS pos0 FROM signals"),
        ("entered", f"SELECT *, sum(CASE WHEN pos = 1 AND pos0 = 0 THEN 1 ELSE 0 END) OVER ({key} {LAST}) AS trip, row_number() OVER (PARTITION BY run_id, symbol ORDER BY i DESC) AS back FROM positions"),
        ("legs", "SELECT run_id, symbol, trip, max(CASE WHEN pos = 1 AND pos0 = 0 THEN open END) AS p_in, max(CASE WHEN pos = 0 AND pos0 = 1 THEN open END) AS p_out, max(CASE WHEN back = 1 THEN close END) AS p_last FROM entered WHERE trip >= 1 GROUP BY run_id, symbol, trip"),
        ("trips", f"SELECT *, CASE WHEN p_out IS NOT NULL THEN p_out / p_in * (1 - {slip}) * (1 - {fee}) ELSE p_last / p_in END - ({slip} + (1 + {slip}) * {fee}) AS f FROM legs"),
    ]


def reversal_of(k: int) -> str:
    """Reversal score over k bars of a slice."""
    return f"-(close / nullif(lag(close, {k}) OVER (PARTITION BY slice, symbol ORDER BY bar_idx), 0) - 1)"


def walk(train: int = 120, test: int = 40, step: int = 40, grid: dict[int, str] | None = None, per: int = 100, weigh: Steps | None = None, **settings: object) -> Steps:
    """``judged``: for each window the setting that is best in sample, and its
    result out of sample. All windows, sides and settings are runs of one job,
    each on its own timeline, so that every test starts flat.

    ``grid`` has a number below 100 and a score (an SQL expression over the
    columns of the grid, windows by ``slice, symbol``) for each setting of any
    strategy; each ``per`` settings are one study (``config``) that chooses among
    its own. ``weigh`` are the steps from ``scored`` to ``weighted``."""
    grid = grid or {k: reversal_of(k) for k in (1, 2, 4, 8)}
    if not all(0 <= k < 100 for k in grid):
        raise ValueError("settings are numbered from 0 to 99")
    names = {x: f"s{i}" for i, x in enumerate(dict.fromkeys(grid.values()))}
    columns = ", ".join(f"({x}) * 1e0 AS {name}" for x, name in names.items())
    return [
        ("windows", f"SELECT bar_idx AS lo FROM calendar WHERE bar_idx % {step} = 0 AND bar_idx + {train + test} <= (SELECT count(*) FROM calendar)"),
        ("sides", f"SELECT lo, 0 AS side, lo AS a, lo + {train} AS b FROM windows UNION ALL SELECT lo, 1 AS side, lo + {train} AS a, lo + {train + test} AS b FROM windows"),
        book.within("cut", "grid", "sides", "w.lo * 2 + w.side AS slice, g.bar_idx - w.a AS bar_idx, g.ts, g.symbol, g.close, g.volume, g.discount, g.tax", "a", "b"),
        ("lagged", f"SELECT *, {columns} FROM cut"),
        ("scored", unpivot("lagged", CELL, {f"slice * 100 + {k}": names[x] for k, x in grid.items()})),
        *(weigh or book.weights()),
        *book.accounting(**settings),
        *book.performance(),
        ("sided", f"SELECT floor(run_id / 200) AS lo, floor(run_id / 100) % 2 AS side, run_id % 100 AS lookback, floor(run_id % 100 / {per}) AS config, run_id, round(sharpe, 8) AS sharpe FROM metrics"),
        ("chosen", "SELECT *, row_number() OVER (PARTITION BY lo, config ORDER BY sharpe DESC, lookback) AS place FROM sided WHERE side = 0"),
        ("judged", "SELECT c.lo, c.config, c.lookback, c.sharpe AS train_sharpe, t.sharpe AS test_sharpe, t.run_id FROM chosen c JOIN sided t ON t.lo = c.lo AND t.lookback = c.lookback AND t.side = 1 WHERE c.place = 1"),
    ]


#: ``tested``: the bar returns out of sample of what was chosen.
TESTED = ("tested", "SELECT j.config, j.lo, b.bar_idx, b.r FROM judged j JOIN bar_returns b ON b.run_id = j.run_id WHERE b.r IS NOT NULL")
STITCHED = "SELECT config, count(*) AS n, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 0e0) AS oos_sharpe FROM tested GROUP BY config"


def carry_of(k: int) -> str:
    """Carry score: the mean funding rate of k bars of a slice, short where it is high."""
    return f"-avg({RATE}) OVER (PARTITION BY slice, symbol ORDER BY bar_idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def carry_sweep() -> tuple[Steps, str]:
    """Walk-forward of carry for each rebalance, number of names and cost."""
    cell = "floor(run_id % 100 / 3)"  # 18 cells of three smoothings
    every = f"(CASE WHEN {cell} < 9 THEN 4 ELSE 13 END)"
    names = f"(CASE floor({cell} % 9 / 3) WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 1000 END)"
    cost = f"(CASE {cell} % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 5e-4 ELSE 1e-3 END)"
    grid = {3 * c + i: carry_of(k) for c in range(18) for i, k in enumerate((1, 3, 8))}
    steps = [*walk(grid=grid, per=3, weigh=book.weights("top", names), every=every, cost=cost, funding=RATE), TESTED, ("stitched", STITCHED)]
    return steps, "SELECT CASE WHEN config < 9 THEN 4 ELSE 13 END AS rebalance, CASE floor(config % 9 / 3) WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE NULL END AS top_k, CASE config % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 10 END AS cost_bps, n, round(oos_sharpe, 5) AS oos_sharpe FROM stitched"


def subsets(draws: int = 30, size: int = 12) -> Steps:
    """``scored`` on random subsets of the symbols, one run for each draw."""
    return [
        *_base(),
        _values("draws", "id", [(k,) for k in range(draws)]),
        ("picked", f"SELECT id, symbol FROM (SELECT id, symbol, row_number() OVER (PARTITION BY id ORDER BY md5(concat(id, '-', symbol))) AS k FROM draws CROSS JOIN (SELECT DISTINCT symbol FROM bars) n) q WHERE k <= {size}"),
        ("scored", "SELECT p.id AS run_id, b.bar_idx, b.ts, b.symbol, b.close, b.volume, b.score FROM base b JOIN picked p ON p.symbol = b.symbol"),
    ]


def sleeves() -> Steps:
    """``weighted`` for three sleeves: 1 trend (directional), 2 size, 3 reversal."""
    g = Formula()
    trend, size, rev = g.returns("close", 20), g.full_mean("close * volume", 30), g.returns("close", 1)
    steps, last = g.steps()
    x = "PARTITION BY run_id, bar_idx"
    return [
        *steps,
        ("scored", unpivot(last, CELL, {1: f"sign({trend}) * 1e0", 2: f"-ln(greatest({size}, 1e-9))", 3: f"-{rev} * 1e0"})),
        ("centred", f"SELECT *, CASE WHEN run_id = 1 THEN score ELSE score - avg(score) OVER ({x}) END AS c, count(score) OVER ({x}) AS n_scores FROM scored"),
        ("weighted", f"SELECT run_id, bar_idx, ts, symbol, close, volume, score, CASE WHEN n_scores < 2 THEN 0.0 ELSE coalesce(c / nullif(sum(abs(c)) OVER ({x}), 0), 0.0) END AS w FROM centred"),
    ]


#: ``streams``: the sleeves' returns on bars where all have one, and their inverse-volatility shares.
STREAMS: Steps = [
    ("all_streams", "SELECT run_id, bar_idx, r, count(r) OVER (PARTITION BY bar_idx) AS n_streams FROM bar_returns"),
    ("streams", "SELECT run_id, bar_idx, r FROM all_streams WHERE n_streams = 3"),
    ("inverse", "SELECT run_id, 1 / greatest(stddev_pop(r), 1e-9) AS inv FROM streams GROUP BY run_id"),
    ("shares", "SELECT run_id, inv / sum(inv) OVER () AS share FROM inverse"),
]


def carry(lookback: int = 8, cost: float = 0.00001) -> Steps:
    """``carried``: equal-weight return of the pairs whose mean funding over the
    bars before is positive, less a cost; 0 where none is held."""
    return [
        ("pairs", "SELECT bar_idx, ts, symbol, close, high, (discount - 0.05) / 100 AS funding, tax - 0.04 AS basis FROM grid"),
        ("pair_returns", f"SELECT *, funding - coalesce(basis - lag(basis) OVER ({SYMBOL}), 0.0) AS ret, round(avg(funding) OVER ({SYMBOL} ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING), 12) AS lately, round(avg(funding) OVER ({SYMBOL} ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW), 12) AS upto FROM pairs"),
        ("held_pairs", "SELECT bar_idx, avg(ret) AS ret, count(*) AS n_held FROM pair_returns WHERE lately > 0 AND ret IS NOT NULL GROUP BY bar_idx"),
        ("carried", f"SELECT c.bar_idx, c.ts, coalesce(h.ret, 0.0) - {cost} AS carry, coalesce(h.n_held, 0) AS n_held FROM calendar c LEFT JOIN held_pairs h ON h.bar_idx = c.bar_idx WHERE c.bar_idx >= {lookback}"),
    ]


def ledger(every: int = 13, cost: float = 0.001, cash: float = 10_000.0) -> Steps:
    """``ledgers``: accounts marked forward at their updates. An account earns on
    the weights it last set, and pays for the change of its targets."""
    key = "PARTITION BY run_id, symbol ORDER BY bar_idx"
    return [
        ("updates", f"SELECT run_id, bar_idx, symbol, close, w, lag(close) OVER ({key}) AS close0, coalesce(lag(w) OVER ({key}), 0.0) AS w0 FROM weighted WHERE bar_idx % {every} = 0 AND bar_idx >= 26"),
        ("marked", "SELECT run_id, bar_idx, coalesce(sum(w0 * (close / nullif(close0, 0) - 1)), 0.0) AS growth, sum(abs(w - w0)) AS turnover FROM updates GROUP BY run_id, bar_idx"),
        ("ledgers", f"SELECT *, {cash} * {product(f'((1 + growth) * (1 - {cost} * turnover))', f' OVER (PARTITION BY run_id ORDER BY bar_idx {LAST})')} AS equity FROM marked"),
    ]


#: Customers as accounts, their orders as updates; the newest order of all is now.
ACCOUNTS = """updated AS (SELECT DISTINCT o_custkey AS account, CAST(o_orderdate AS DATE) AS day FROM orders),
latest AS (SELECT account, max(day) AS day, count(*) AS n_updates FROM updated GROUP BY account),
health AS (
  SELECT c.c_custkey AS account, l.n_updates, CASE WHEN l.day IS NULL THEN NULL ELSE DAYS[l.day|n.day] END AS stale
  FROM customer c LEFT JOIN latest l ON l.account = c.c_custkey CROSS JOIN (SELECT max(day) AS day FROM updated) n),
statuses AS (
  SELECT *, CASE WHEN stale IS NULL THEN 'MISSING' WHEN stale > 45 THEN 'BROKEN' WHEN stale >= 30 THEN 'CRITICAL' WHEN stale >= 8 THEN 'STALE' ELSE 'OK' END AS status FROM health)"""

_LEVELS = ("levels", "SELECT ts, l_linestatus AS side, round(price, 0) AS price, sum(qty) AS qty FROM ticks GROUP BY ts, l_linestatus, round(price, 0)")

#: The first fill of each side in a symbol's week, against the week's mean price and the next one's.
FILLS: Steps = [
    ("mids", "SELECT symbol, ts, sum(price * qty) / sum(qty) AS mid FROM ticks GROUP BY symbol, ts"),
    ("next_mids", "SELECT *, lead(mid) OVER (PARTITION BY symbol ORDER BY ts) AS mid1 FROM mids"),
    ("sided_ticks", "SELECT symbol, ts, l_linestatus AS side, row_number() OVER (PARTITION BY symbol, ts, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, qty) AS k FROM ticks"),
    ("fills", "SELECT f.symbol, f.ts, f.side, m.mid, m.mid1 FROM sided_ticks f JOIN next_mids m ON m.symbol = f.symbol AND m.ts = f.ts WHERE f.k = 1 AND m.mid1 IS NOT NULL"),
    _values("spreads", "h", [(5,), (25,), (100,)]),
    ("markouts", "SELECT s.h, f.symbol, f.ts, f.side, CASE WHEN f.side = 'O' THEN f.mid + s.h - f.mid1 ELSE f.mid1 - (f.mid - s.h) END AS pnl FROM fills f CROSS JOIN spreads s"),
]


def _plain(result: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)}\n{result}" if parts else result


def all_sql() -> dict[str, str]:
    w = lambda steps, result: steps_sql("w", steps, result)
    d = lambda steps, result: steps_sql("d", steps, result)
    paid = [*book.scores(), *book.weights(), *book.accounting()]
    measured = [*paid, *book.performance()]
    two = [*book.scores((1, 4)), *book.weights(), *book.accounting(), *book.performance()]
    streams = [*sleeves(), *book.accounting(), *book.performance(), *STREAMS]
    dated = ("dated", "SELECT b.*, c.ts FROM bar_returns b JOIN calendar c ON c.bar_idx = b.bar_idx")
    year = "extract(YEAR FROM ts)"
    out = {
        "a03_validate_bars": d([], "SELECT symbol, count(*) AS n, count(*) - count(DISTINCT l_shipdate) AS repeated, CAST(sum(CASE WHEN price <= 5010 OR qty IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS broken FROM ticks GROUP BY symbol"),
        "a07_overlay_align": d(OVERLAY, "SELECT bar_idx, symbol, round(tvl, 4) AS tvl FROM aligned"),
        "a08_overlay_lag": d(OVERLAY, f"SELECT bar_idx, symbol, round(lag(tvl, 1) OVER ({SYMBOL}), 4) AS tvl FROM aligned"),
        "a19_best_slug": "SELECT symbol, slug FROM (SELECT p_brand AS symbol, p_name AS slug, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_name <> '' AND p_name <> '-') t WHERE k = 1",
        "a21_symbol_normalise": "SELECT p_partkey, regexp_replace(concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'USDT' ELSE '' END), 'USDT$', '') AS symbol FROM part",
        "a22_timestamp_normalise": "SELECT o_orderkey, MILLIS[o_orderdate] AS ms FROM orders",
        "a23_bars_per_year": _plain("SELECT i.name, 525600e0 / i.minutes AS per_year, count(DISTINCT floor(MILLIS[e.ts] / (i.minutes * 60000e0))) AS n_bars FROM events e CROSS JOIN intervals i GROUP BY i.name, i.minutes", "intervals AS ({1})".replace("{1}", _values("", "name, minutes", [("1m", 1), ("5m", 5), ("15m", 15), ("1h", 60), ("4h", 240), ("1d", 1440)])[1])),
        "b01_project": "SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS qty, 'lineitem' AS origin FROM lineitem",
        "b02_range_filter": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-07-01'",
        "b03_is_in": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
        "b04_not_in": "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
        "b05_regex": "SELECT p_partkey, p_brand FROM part WHERE MATCHES[p_brand|^Brand#[12];]",
        "b06_concat": "SELECT 'supplier' AS kind, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance FROM customer",
        "b07_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag",
        "b08_keep_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) t WHERE k = 1",
        "b09_sort": "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
        "b10_slice": w([], "SELECT bar_idx, symbol, close FROM grid WHERE bar_idx >= 100 AND bar_idx < 200"),
        "b11_top_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "b12_intersect": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0",
        "b13_fill_and_drop": d([("runs", f"SELECT *, count(close) OVER ({SYMBOL}) AS block FROM grid"), ("filled", Both(f"SELECT bar_idx, symbol, last_value(close, true) OVER ({SYMBOL} {LAST}) AS close, coalesce(volume, 0.0) AS volume FROM grid", "SELECT bar_idx, symbol, max(close) OVER (PARTITION BY symbol, block) AS close, coalesce(volume, 0.0) AS volume FROM runs"))], "SELECT * FROM filled WHERE close IS NOT NULL"),
        "c01_left": w([("supply", "SELECT date_trunc('week', o_orderdate) AS ts, sum(o_totalprice) AS minted FROM orders GROUP BY date_trunc('week', o_orderdate)")], "SELECT b.symbol, b.ts, b.close, round(s.minted, 2) AS minted FROM bars b LEFT JOIN supply s ON s.ts = b.ts"),
        "c02_complete_bars": w(
            [("perp", "SELECT ts, symbol, close * (1 + tax - 0.04) AS close FROM bars"), ("paid_rates", "SELECT ts, symbol, (discount - 0.05) / 100 AS rate FROM bars"), ("joined", "SELECT b.ts, b.symbol, b.close AS spot, p.close AS perp, f.rate FROM bars b JOIN perp p ON p.ts = b.ts AND p.symbol = b.symbol JOIN paid_rates f ON f.ts = b.ts AND f.symbol = b.symbol")],
            "SELECT ts, symbol, spot, round(perp, 6) AS perp, round(rate, 8) AS rate FROM joined WHERE ts IN (SELECT ts FROM joined GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))",
        ),
        "c03_streams": w(two, "SELECT a.bar_idx, round(a.r, 8) AS r1, round(b.r, 8) AS r4 FROM bar_returns a JOIN bar_returns b ON b.bar_idx = a.bar_idx AND b.run_id = 4 WHERE a.run_id = 1 AND a.r IS NOT NULL AND b.r IS NOT NULL"),
        "c04_cross": d([_values("params", "lookback, k", [(1, 3), (1, 5), (4, 3), (4, 5)])], "SELECT c.bar_idx, p.lookback, p.k FROM calendar c CROSS JOIN params p"),
        "c06_semi_and_anti": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
        "c07_union_of_maps": w(sleeves(), "SELECT bar_idx, symbol, round(sum(w), 6) AS w FROM (SELECT bar_idx, symbol, w FROM weighted WHERE run_id = 1 UNION ALL SELECT bar_idx, symbol, w FROM weighted WHERE run_id = 2) u GROUP BY bar_idx, symbol"),
        "f07_consistency": w(_halves(), "SELECT i.run_id AS lookback, i.verdict AS first_half, o.verdict AS second_half, CASE WHEN i.verdict = o.verdict AND i.verdict <> 'dead' THEN 1 ELSE 0 END AS held FROM (SELECT floor(run_id / 10) AS run_id, verdict FROM verdicts WHERE run_id % 10 = 1) i JOIN (SELECT floor(run_id / 10) AS run_id, verdict FROM verdicts WHERE run_id % 10 = 2) o ON o.run_id = i.run_id"),
        "f09_null_control": w(_shuffled(), "SELECT run_id, n, round(mean_ic, 6) AS mean_ic, verdict FROM verdicts"),
        "f10_causality": w(*_causal()),
        "h06_vol_target": w([*book.scores(), *book.weights(), *vol_target()], "SELECT bar_idx, symbol, round(w, 6) AS w FROM targeted WHERE bar_idx % 4 = 0"),
        "h08_derisk": w(measured, "SELECT bar_idx, round(CASE WHEN drawdown >= -0.05 THEN 1.0 WHEN drawdown <= -0.20 THEN 0.25 ELSE 1 - 0.75 * (-drawdown - 0.05) / 0.15 END, 6) AS scale FROM bar_returns"),
        "i02_funding_flow": w([*book.scores(), *book.weights(), *book.accounting(funding=RATE)], "SELECT bar_idx, round(flow, 8) AS flow, round(equity, 4) AS equity FROM equity"),
        "i10_round_trips": w(crossover(), "SELECT run_id, symbol, CAST(trip AS BIGINT) AS trip, p_in, p_out, round(f, 8) AS factor FROM trips"),
        "j08_alpha_beta": w(
            [*measured, *MARKET, ("fit", "SELECT count(*) AS n, regr_slope(b.r, m.m) AS beta, regr_intercept(b.r, m.m) AS alpha, regr_sxx(b.r, m.m) AS sxx, regr_syy(b.r, m.m) AS syy, regr_sxy(b.r, m.m) AS sxy, avg(m.m) AS x FROM bar_returns b JOIN market m ON m.bar_idx = b.bar_idx WHERE b.r IS NOT NULL")],
            "SELECT n, round(beta, 6) AS beta, round(alpha * 52, 6) AS alpha, round(alpha / nullif(sqrt((syy - sxy * sxy / nullif(sxx, 0)) / nullif(n - 2, 0) * (1e0 / nullif(n, 0) + x * x / nullif(sxx, 0))), 0), 5) AS t FROM fit",
        ),
        "j11_trade_quality": w(measured, "SELECT run_id, round(avg(CASE WHEN r > 1e-12 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END), 6) AS win_rate, round(avg(CASE WHEN r > 1e-12 THEN r END), 8) AS mean_up, round(avg(CASE WHEN r < -1e-12 THEN r END), 8) AS mean_down, round(avg(CASE WHEN r > 1e-12 THEN r END) / nullif(-avg(CASE WHEN r < -1e-12 THEN r END), 0), 6) AS payoff, round(max(r), 8) AS best, round(min(r), 8) AS worst FROM bar_returns GROUP BY run_id"),
        "j12_turnover_profile": w(paid, "SELECT run_id, round(avg(CASE WHEN turnover > 0 THEN turnover END) / 2, 6) AS one_way, round(avg(gross), 6) AS mean_gross, round(28 / nullif(avg(CASE WHEN turnover > 0 THEN turnover END) / 2 / nullif(avg(gross), 0), 0), 4) AS holding_days FROM equity GROUP BY run_id"),
        "j13_per_year": w([*measured, dated], f"SELECT {year} AS year, round({product('(1 + coalesce(r, 0.0))')} - 1, 6) AS r FROM dated GROUP BY {year}"),
        "j14_segment": w([*measured, dated, ("cut_out", "SELECT *, max(equity) OVER (PARTITION BY run_id ORDER BY bar_idx) AS peak FROM dated WHERE ts >= DATE '1997-01-01' AND ts <= DATE '1999-12-31'")], f"SELECT run_id, count(*) AS n, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe, round(min(equity / nullif(peak, 0) - 1), 6) AS max_drawdown, round({product('(1 + r)')} - 1, 6) AS total FROM cut_out GROUP BY run_id"),
        "j15_losing_streak": w([*measured, ("signs", "SELECT run_id, bar_idx, CASE WHEN r < -1e-12 THEN 1 ELSE 0 END AS loss FROM bar_returns WHERE r IS NOT NULL"), ("islands", "SELECT *, bar_idx - row_number() OVER (PARTITION BY run_id, loss ORDER BY bar_idx) AS island FROM signs")], "SELECT run_id, max(n) AS longest FROM (SELECT run_id, island, count(*) AS n FROM islands WHERE loss = 1 GROUP BY run_id, island) t GROUP BY run_id"),
        "j17_year_ends": w([*measured, dated, ("ends", f"SELECT *, row_number() OVER (PARTITION BY run_id, {year} ORDER BY bar_idx DESC) AS k FROM dated")], f"SELECT {year} AS year, round(equity, 4) AS equity FROM ends WHERE k = 1"),
        "k02_windows": w(walk()[:2], "SELECT lo, side, a, b FROM sides"),
        "k03_walk_forward": w(walk(), "SELECT lo, lookback, round(train_sharpe, 5) AS train_sharpe, round(test_sharpe, 5) AS test_sharpe, round(train_sharpe - test_sharpe, 5) AS gap FROM judged"),
        "k04_stitched": w([*walk(), TESTED, ("whole", f"SELECT lo, {product('(1 + r)')} AS f FROM tested GROUP BY lo"), ("entered", f"SELECT lo, {product('f', ' OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS before FROM whole")], f"SELECT lo, bar_idx, round(10000 * before * {product('(1 + r)', f' OVER (PARTITION BY lo ORDER BY bar_idx {LAST})')}, 4) AS equity FROM tested JOIN entered USING (lo)"),
        "k06_bootstrap": w([*subsets(), *book.weights(), *book.accounting(), *book.performance()], "SELECT run_id, round(sharpe, 6) AS sharpe, round(total_return, 6) AS total_return FROM metrics"),
        "k07_bootstrap_summary": w([*subsets(), *book.weights(), *book.accounting(), *book.performance()], "SELECT count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY sharpe), 6) AS median_sharpe, round(percentile_cont(0.05) WITHIN GROUP (ORDER BY sharpe), 6) AS low, round(avg(CASE WHEN sharpe > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive FROM metrics"),
        "k14_friction_ladder": w(
            [*_base(), ("ranked_names", "SELECT symbol, row_number() OVER (ORDER BY sum(volume) DESC, symbol) AS k FROM bars GROUP BY symbol"), _values("scenarios", "id, names", [(1, 999), (2, 12), (3, 999), (4, 12)]), ("scored", "SELECT s.id AS run_id, b.bar_idx, b.ts, b.symbol, b.close, b.volume, b.score FROM base b JOIN ranked_names n ON n.symbol = b.symbol JOIN scenarios s ON n.k <= s.names"), *book.weights(), *book.accounting(cost="(CASE WHEN run_id <= 2 THEN 0.0 ELSE 0.001 END)", short_rate="(CASE WHEN run_id <= 2 THEN 0.0 ELSE 0.0005 END)"), *book.performance()],
            "SELECT run_id, round(sharpe, 6) AS sharpe, round(total_return, 6) AS total_return FROM metrics",
        ),
        "k15_capacity_curve": w(
            [*_base(), _values("sizes", "id, capital", [(1, 10_000), (2, 1_000_000), (3, 10_000_000), (4, 100_000_000)]), ("scored", "SELECT s.id AS run_id, b.bar_idx, b.ts, b.symbol, b.close, b.volume, b.score FROM base b CROSS JOIN sizes s"), *book.weights(), *book.limits(0.0, 0.02, "(CASE run_id WHEN 1 THEN 1e4 WHEN 2 THEN 1e6 WHEN 3 THEN 1e7 ELSE 1e8 END)"), *book.accounting("limited"), *book.performance()],
            "SELECT run_id, round(sharpe, 5) AS sharpe, round(total_return, 6) AS total_return, round(total_return / nullif(max(CASE WHEN run_id = 1 THEN total_return END) OVER (), 0), 5) AS kept FROM metrics",
        ),
        "k17_carry_sweep": w(*carry_sweep()),
        "l02_two_sleeves": w(sleeves(), "SELECT symbol, round(sum(CASE run_id WHEN 1 THEN 0.6 ELSE 0.4 END * w), 6) AS w FROM weighted WHERE run_id <= 2 AND bar_idx = (SELECT max(bar_idx) FROM calendar) GROUP BY symbol HAVING abs(sum(CASE run_id WHEN 1 THEN 0.6 ELSE 0.4 END * w)) > 0.000001"),
        "l03_three_sleeves": w(streams, "SELECT t.symbol, round(sum(s.share * t.w), 6) AS w FROM weighted t JOIN shares s ON s.run_id = t.run_id WHERE t.bar_idx = (SELECT max(bar_idx) FROM calendar) GROUP BY t.symbol"),
        "l04_inverse_vol_blend": w(streams, "SELECT t.bar_idx, round(sum(s.share * t.r), 8) AS r FROM streams t JOIN shares s ON s.run_id = t.run_id GROUP BY t.bar_idx"),
        "l05_fixed_blend": w(streams, "SELECT bar_idx, round(sum(r) / 3, 8) AS r FROM streams GROUP BY bar_idx"),
        "l06_correlations": w(streams, "SELECT a.run_id AS a, b.run_id AS b, round(covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0), 6) AS corr FROM streams a JOIN streams b ON b.bar_idx = a.bar_idx GROUP BY a.run_id, b.run_id"),
        "l09_carry": w(carry(), "SELECT bar_idx, round(carry, 10) AS carry, n_held FROM carried"),
        "l10_basket": w(carry(), "SELECT symbol FROM pair_returns WHERE bar_idx = (SELECT max(bar_idx) FROM calendar) AND upto > 0"),
        "l11_realised_carry": w(carry(), f"SELECT round({product('(1 + carry)')} - 1, 8) AS realised FROM carried WHERE ts > DATE '2000-01-01'"),
        "l12_always_or_timed": w([*carry(), ("always", "SELECT bar_idx, avg(coalesce(funding, 0.0)) AS harvest FROM pairs GROUP BY bar_idx")], "SELECT a.bar_idx, round(a.harvest, 10) AS always_on, round(c.carry, 10) AS timed FROM always a JOIN carried c ON c.bar_idx = a.bar_idx"),
        "l13_adverse_moves": w([("moved", f"SELECT symbol, bar_idx, high / nullif(lag(close) OVER ({SYMBOL}), 0) - 1 AS up FROM grid"), _values("levers", "leverage", [(5,), (10,), (20,)])], "SELECT leverage, count(up) AS n, CAST(sum(CASE WHEN up > 1e0 / leverage THEN 1 ELSE 0 END) AS BIGINT) AS n_liquidated, round(max(up), 8) AS worst FROM moved CROSS JOIN levers GROUP BY leverage"),
        "l13_worst_moves": w([("moved", f"SELECT symbol, ts, high / nullif(lag(close) OVER ({SYMBOL}), 0) - 1 AS up FROM grid")], "SELECT symbol, ts, round(up, 8) AS up, CASE WHEN up > 0.2 THEN 5 WHEN up > 0.1 THEN 10 WHEN up > 0.05 THEN 20 END AS liquidates_from FROM moved WHERE up IS NOT NULL ORDER BY round(up, 8) DESC, symbol, ts LIMIT 20"),
        "l14_siloed_margin": w([*carry(), ("adverse", f"SELECT bar_idx, ret, lately, high / nullif(lag(close) OVER ({SYMBOL}), 0) - 1 AS up FROM pair_returns"), _values("levers", "leverage", [(5,), (10,), (20,)])], "SELECT leverage, bar_idx, round(avg(CASE WHEN up > 1e0 / leverage THEN -1e0 / leverage ELSE ret END), 10) AS r FROM adverse CROSS JOIN levers WHERE lately > 0 AND ret IS NOT NULL GROUP BY leverage, bar_idx"),
        "l15_macro_timing": w(_macro(), "SELECT t.bar_idx, t.lookback, t.pos, round(t.ret, 8) AS r, CASE WHEN t.bar_idx < 178 THEN 'in' ELSE 'out' END AS side FROM timed_returns t JOIN best_lookback b ON b.lookback = t.lookback"),
        "m01_ledger": w([*book.scores((1, 4, 8)), *book.weights(), *ledger()], "SELECT run_id, bar_idx, round(growth, 8) AS growth, round(turnover, 6) AS turnover, round(equity, 4) AS equity FROM ledgers"),
        "m03_gap_guard": _plain("SELECT account, CAST(day AS VARCHAR(10)) AS day, gap FROM (SELECT account, day, DAYS[lag(day) OVER (PARTITION BY account ORDER BY day)|day] AS gap FROM updated) g WHERE gap > 45", ACCOUNTS),
        "m04_two_pots": w(
            [*book.scores(), *book.weights(), *ledger(), *carry(), ("carry_pots", f"SELECT 13 * ceil(bar_idx / 13e0) AS bar_idx, {product('(1 + carry)')} AS fc FROM carried GROUP BY 13 * ceil(bar_idx / 13e0)"), ("pots", "SELECT m.run_id, m.bar_idx, (1 + m.growth) * (1 - 0.001 * m.turnover) AS fa, coalesce(c.fc, 1.0) AS fc FROM marked m LEFT JOIN carry_pots c ON c.bar_idx = m.bar_idx")],
            f"SELECT bar_idx, round(fa, 8) AS alpha_factor, round(fc, 8) AS carry_factor, round(10000 * {product('(0.5 * fa + 0.5 * CASE WHEN bar_idx = 26 THEN 1.0 ELSE fc END)', f' OVER (PARTITION BY run_id ORDER BY bar_idx {LAST})')}, 4) AS equity FROM pots",
        ),
        "m06_price_precedence": w(
            [("offers", "SELECT symbol, close, 1 AS priority FROM grid WHERE bar_idx = (SELECT max(bar_idx) FROM grid) AND close IS NOT NULL UNION ALL SELECT symbol, open AS close, 2 AS priority FROM grid WHERE bar_idx = (SELECT max(bar_idx) - 1 FROM grid) AND open IS NOT NULL"), ("placed_offers", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority) AS k FROM offers")],
            "SELECT symbol, close, priority FROM placed_offers WHERE k = 1",
        ),
        "m07_staleness": _plain("SELECT account, n_updates, stale, status FROM statuses ORDER BY CASE status WHEN 'BROKEN' THEN 0 WHEN 'MISSING' THEN 1 WHEN 'CRITICAL' THEN 2 WHEN 'STALE' THEN 3 ELSE 4 END, account", ACCOUNTS),
        "m08_fleet_alarm": _plain("SELECT max(CASE WHEN status IN ('BROKEN', 'CRITICAL', 'MISSING') THEN 1 ELSE 0 END) AS failing, count(*) AS n_accounts FROM statuses", ACCOUNTS),
        "n03_sweep_cost": w(
            [_LEVELS, ("depth", "SELECT *, coalesce(sum(qty) OVER (PARTITION BY ts, side ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM levels WHERE side = 'F'"), ("takes", "SELECT *, greatest(0, least(qty, 500 - prior)) AS take FROM depth")],
            "SELECT ts, round(sum(take), 4) AS filled, round(sum(take * price) / nullif(sum(take), 0), 6) AS mean_price, round(sum(take * price) / nullif(sum(take), 0) - min(price), 6) AS slippage FROM takes GROUP BY ts",
        ),
        "n04_markouts": w(FILLS, "SELECT h, symbol, ts, side, round(pnl, 6) AS pnl FROM markouts"),
        "n05_attribution": w(FILLS, "SELECT h, count(*) AS n_fills, h * count(*) AS captured, round(h * count(*) - sum(pnl), 4) AS adverse, round(avg(pnl), 6) AS per_fill FROM markouts GROUP BY h"),
    }
    return out


def bench_sql() -> dict[str, PanelQuery]:
    """The alpha bench and its breakdown by theme."""
    scored, names = bench()
    named = _values("names", "run_id, alpha", [(k, n) for k, n in names.items()])
    themed = _values("themes", "run_id, theme", [(k, t) for k, n in names.items() for t in alphas.ALPHAS[n].theme])
    return {
        "f05_bench": steps_sql("w", [*scored, *book._ic(known=True), named], "SELECT n.alpha, coalesce(v.n, 0) AS n, round(v.mean_ic, 5) AS mean_ic, round(v.t, 4) AS t, round(v.hit, 5) AS hit, coalesce(v.verdict, 'dead') AS verdict FROM names n LEFT JOIN verdicts v ON v.run_id = n.run_id"),
        "f08_themes": steps_sql("w", [*scored, *book._ic(known=True), themed], "SELECT t.theme, coalesce(v.verdict, 'dead') AS verdict, count(*) AS n FROM themes t LEFT JOIN verdicts v ON v.run_id = t.run_id GROUP BY t.theme, coalesce(v.verdict, 'dead')"),
    }


def _macro(lookbacks: tuple[int, ...] = (4, 8, 13), cut: int = 178) -> Steps:
    """Market timed by the sign of a supply's growth, one bar later; the lookback
    is the one with the best ratio before the cut."""
    over = "OVER (PARTITION BY lookback ORDER BY bar_idx)"
    return [
        *MARKET,
        ("minted", "SELECT date_trunc('week', o_orderdate) AS ts, sum(o_totalprice) AS x FROM orders GROUP BY date_trunc('week', o_orderdate)"),
        ("supply", "SELECT c.bar_idx, sum(coalesce(m.x, 0.0)) OVER (ORDER BY c.bar_idx) AS supply FROM calendar c LEFT JOIN minted m ON m.ts = c.ts"),
        ("growths", unpivot("supply", "bar_idx", {k: f"supply / nullif(lag(supply, {k}) OVER (ORDER BY bar_idx), 0) - 1 - {k}e0 / (bar_idx + 1)" for k in lookbacks}, "g", "lookback")),
        ("positions", f"SELECT lookback, bar_idx, coalesce(lag(CASE WHEN round(g, 9) > 0 THEN 1 WHEN round(g, 9) < 0 THEN -1 ELSE 0 END) {over}, 0) AS pos FROM growths"),
        ("timed_returns", "SELECT p.lookback, p.bar_idx, p.pos, p.pos * m.m AS ret FROM positions p JOIN market m ON m.bar_idx = p.bar_idx"),
        ("in_sample", f"SELECT lookback, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0e0), 9) AS ratio FROM timed_returns WHERE bar_idx < {cut} GROUP BY lookback"),
        ("best_lookback", "SELECT lookback FROM (SELECT lookback, row_number() OVER (ORDER BY ratio DESC, lookback) AS k FROM in_sample) x WHERE k = 1"),
    ]


def _halves() -> Steps:
    """Verdicts of three lookbacks in each half of the timeline, cut before any window."""
    columns = ", ".join(f"close / nullif(lag(close, {k}) OVER (PARTITION BY period, symbol ORDER BY bar_idx), 0) - 1 AS r{k}" for k in (1, 4, 8))
    return [
        ("period_grid", "SELECT CASE WHEN bar_idx < 178 THEN 1 ELSE 2 END AS period, CASE WHEN bar_idx < 178 THEN bar_idx ELSE bar_idx - 178 END AS bar_idx, ts, symbol, close, volume FROM grid"),
        ("period_returns", f"SELECT *, {columns} FROM period_grid"),
        ("scored", unpivot("period_returns", CELL, {f"{k} * 10 + period": f"-r{k}" for k in (1, 4, 8)})),
        *book._ic(),
    ]


def _shuffled(draws: int = 10) -> Steps:
    """Scores dealt at random among the symbols of each bar: no draw may be alive."""
    x = "PARTITION BY d.id, b.bar_idx"
    return [
        *_base(),
        _values("draws", "id", [(k,) for k in range(draws)]),
        ("placed", f"SELECT d.id, b.bar_idx, b.symbol, b.score, row_number() OVER ({x} ORDER BY b.symbol) AS seat, row_number() OVER ({x} ORDER BY md5(concat(d.id, '-', b.bar_idx, '-', b.symbol))) AS card FROM base b CROSS JOIN draws d WHERE b.score IS NOT NULL"),
        ("dealt", "SELECT a.id, a.bar_idx, a.symbol, c.score FROM placed a JOIN placed c ON c.id = a.id AND c.bar_idx = a.bar_idx AND c.card = a.seat"),
        ("scored", "SELECT d.id AS run_id, b.bar_idx, b.ts, b.symbol, b.close, b.volume, t.score FROM base b CROSS JOIN draws d LEFT JOIN dealt t ON t.id = d.id AND t.bar_idx = b.bar_idx AND t.symbol = b.symbol"),
        *book._ic(),
    ]


def _causal(name: str = "alpha101_034", cut: int = 200) -> tuple[Steps, str]:
    """An alpha on the grid and on one whose bars after a cut are spoiled."""
    steps, last = alphas.formula(name).steps()
    spoiled = ", ".join(f"CASE WHEN bar_idx >= {cut} THEN {c} * (2 + bar_idx % 3) ELSE {c} END AS {c}" for c in ("open", "high", "low", "close", "volume"))
    again = [(re.sub(r"\blevel", "spoiled", n), re.sub(r"\blevel", "spoiled", re.sub(r"FROM grid$", "FROM spoiled_grid", q))) for n, q in steps]
    side = f"CASE WHEN a.bar_idx < {cut} THEN 'past' ELSE 'future' END"
    moved = "CASE WHEN round(coalesce(a.value, -9e0) - coalesce(b.value, -9e0), 8) <> 0 THEN 1 ELSE 0 END"
    return (
        [*steps, ("spoiled_grid", f"SELECT bar_idx, ts, symbol, {spoiled} FROM grid"), *again],
        f"SELECT {side} AS side, count(*) AS n, max({moved}) AS moved FROM {last} a JOIN {last.replace('level', 'spoiled')} b ON b.bar_idx = a.bar_idx AND b.symbol = a.symbol GROUP BY {side}",
    )
