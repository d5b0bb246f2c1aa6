"""From scores to weights, profit and loss, metrics and validation, as SQL steps.

The accounting is in closed form: between two rebalances a book is buy-and-hold,
so with g the growth of each symbol since the epoch's start, the book is worth
V = 1 + sum w (g - 1), and its drifted weights are w g / V. Equity is a running
product of V(t) / V(t - 1), less funding and short financing on the weights held
over each bar, and costs at the rebalances. ``run_id`` stands in all keys, so
many parameter settings are one job. The oracle walks the bars one by one in a
recursive statement.
"""

from __future__ import annotations

from panelspark.functions.vocabulary import Formula, digits, place
from panelspark.sources.panels import Both, PanelQuery, steps_sql

Steps = list[tuple[str, str]]
LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
PER_YEAR = 52
#: Pairs of stablecoins and metals, and the form of an ordinary pair.
PEGGED = ("USDCUSDT", "USD1USDT", "FDUSDUSDT", "EURUSDT", "RLUSDUSDT", "TUSDUSDT", "DAIUSDT", "PYUSDUSDT", "USDPUSDT", "BUSDUSDT", "PAXGUSDT", "XAUTUSDT")
LISTED = "^[A-Z0-9]+USDT$"
#: Funding rate of a cell of the fixture grids.
RATE = "coalesce((discount - 0.05) / 100, 0e0)"


def product(x: str, over: str = "") -> str:
    """Product of ``x`` in a window (or group): signs are counted and a zero stays zero."""
    none, sign = f"count(CASE WHEN {x} = 0 THEN 1 END){over}", f"1 - 2 * (count(CASE WHEN {x} < 0 THEN 1 END){over} % 2)"
    return f"CASE WHEN {none} > 0 THEN 0e0 ELSE ({sign}) * exp(coalesce(sum(ln(abs(nullif({x}, 0)))){over}, 0e0)) END"


def unpivot(source: str, kept: str, runs: dict[int | str, str], value: str = "score", run: str = "run_id") -> str:
    """``kept`` columns with one row for each of ``runs`` (run: expression): one pass in Spark."""
    columns = ", ".join(f"{x} AS v{i}" for i, x in enumerate(runs.values()))
    pairs = ", ".join(f"{k}, v{i}" for i, k in enumerate(runs))
    return Both(
        f"SELECT {kept}, stack({len(runs)}, {pairs}) AS ({run}, {value}) FROM (SELECT *, {columns} FROM {source}) u",
        " UNION ALL ".join(f"SELECT {kept}, {k} AS {run}, {x} AS {value} FROM {source}" for k, x in runs.items()),
    )


def within(name: str, rows: str, windows: str, columns: str, lo: str, hi: str) -> tuple[str, str]:
    """Step ``name``: ``columns`` of rows ``g`` and of the windows ``w`` of bars from ``lo``
    to before ``hi`` in which they lie. Spark deals each window out to its bars, so the
    join is on equal numbers; the oracle compares ranges."""
    spread = f"SELECT *, explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) - 1)) AS at FROM {windows}"
    return name, Both(f"SELECT {columns} FROM {rows} g JOIN ({spread}) w ON w.at = g.bar_idx", f"SELECT {columns} FROM {rows} g JOIN {windows} w ON g.bar_idx >= w.{lo} AND g.bar_idx < w.{hi}")


CELL = "bar_idx, ts, symbol, close, volume"


def strategy_scores(runs: dict[int, str], formula: Formula | None = None, source: str = "grid") -> Steps:
    """``scored``: run_id, bar_idx, ts, symbol, close, volume, score; one run for
    each score (an SQL expression over the columns of ``formula``). This is how
    any strategy, or a grid of its settings, enters a book."""
    steps, last = (formula or Formula()).steps(source)
    return [*steps, ("scored", unpivot(last, CELL, {k: f"({x}) * 1e0" for k, x in runs.items()}))]


def scores(lookbacks: tuple[int, ...] = (1,), sign: int = -1) -> Steps:
    """``scored`` of reversal (or, with sign 1, momentum): one run for each lookback."""
    g = Formula()
    return strategy_scores({k: f"{sign} * {g.returns('close', k)}" for k in lookbacks}, g)


def weights(kind: str = "neutral", top_k: int | str = 5, leverage: float = 1.0, directional: str = "") -> Steps:
    """``weighted``: the score's weight; fewer than two scores in a bar give a flat
    book. ``kind`` is neutral, top or directional; ``top_k`` may be an SQL
    expression of ``run_id``, and ``directional`` one that tells which runs are
    directional whatever the kind."""
    if kind not in ("neutral", "top", "directional"):
        raise ValueError(f"no kind of weights: {kind}")
    x = "PARTITION BY run_id, bar_idx"
    centred = "score" if kind == "directional" else f"score - avg(score) OVER ({x})"
    if kind == "top":
        place = digits("score")
        up, down = f"row_number() OVER ({x} ORDER BY {place} DESC NULLS LAST, symbol)", f"row_number() OVER ({x} ORDER BY {place} NULLS LAST, symbol)"
        centred = f"CASE WHEN score IS NULL THEN NULL WHEN 2 * {top_k} > count(score) OVER ({x}) THEN {centred} WHEN {up} <= {top_k} THEN 1.0 WHEN {down} <= {top_k} THEN -1.0 ELSE 0.0 END"
    if directional:
        centred = f"CASE WHEN {directional} THEN score ELSE {centred} END"
    return [
        ("centred", f"SELECT *, {centred} AS c, count(score) OVER ({x}) AS n_scores FROM scored"),
        ("weighted", f"SELECT run_id, bar_idx, ts, symbol, close, volume, score, CASE WHEN n_scores < 2 THEN 0.0 ELSE coalesce({leverage} * c / nullif(sum(abs(c)) OVER ({x}), 0), 0.0) END AS w FROM centred"),
    ]


def limits(min_volume: float | str = 0.0, share: float | None = None, capital: float = 1e6, lookback: int = 20) -> Steps:
    """``limited``: ``weighted`` with shorts only in traded names, and with a cap by traded
    value. ``min_volume`` may be an SQL expression of ``run_id``."""
    dv = f"avg(close * volume) OVER (PARTITION BY run_id, symbol ORDER BY bar_idx ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)"
    w = f"CASE WHEN w < 0 AND NOT coalesce(dv >= {min_volume}, false) THEN 0.0 ELSE w END"
    if share is not None:
        cap = f"coalesce({share} * dv / {capital}, 0.0)"
        w = f"greatest(least({w}, {cap}), -{cap})"
    return [("valued", f"SELECT *, {dv} AS dv FROM weighted"), ("limited", f"SELECT run_id, bar_idx, ts, symbol, close, volume, score, dv, {w} AS w FROM valued")]


def accounting(source: str = "weighted", every: int | str = 4, cost: float | str = 0.001, short_rate: float | str = 0.0, cash: float = 10_000.0, funding: str = "0e0") -> Steps:
    """``equity``: run_id, bar_idx, f, flow, turnover, gross, equity, from the first bar (cash) on.

    Settings may be SQL expressions of ``run_id``. ``funding`` is an expression
    over the grid's columns: the rate that a holding pays in a bar.
    """
    key = "PARTITION BY run_id, symbol ORDER BY bar_idx"
    e = "PARTITION BY run_id, epoch, symbol ORDER BY bar_idx"
    rated = [("rated", f"SELECT s.*, {funding} AS rate FROM {source} s" + ("" if funding == "0e0" else " JOIN (SELECT bar_idx AS at, symbol AS of, discount, tax FROM grid) g ON g.at = s.bar_idx AND g.of = s.symbol"))]
    set_now = f"bar_idx >= 1 AND bar_idx % ({every}) = 0"
    return [
        *rated,
        ("priced", f"SELECT *, coalesce(close / nullif(lag(close) OVER ({key}), 0) - 1, 0e0) AS r, lag(w) OVER ({key}) AS w_before, ({every}) * floor((bar_idx - 1) / (({every}) * 1e0)) AS epoch FROM rated"),
        ("held", f"SELECT *, CASE WHEN epoch >= 1 THEN coalesce(first_value(w_before) OVER ({e}), 0e0) ELSE 0e0 END AS w0, min(CASE WHEN close IS NULL THEN 0 ELSE 1 END) OVER ({e} {LAST}) AS live FROM priced"),
        ("grown", f"SELECT *, CASE WHEN min(CASE WHEN live = 1 THEN 1 + r ELSE 1e0 END) OVER ({e} {LAST}) <= 0 THEN 0e0 ELSE exp(sum(CASE WHEN live = 1 AND r > -1 THEN ln(1 + r) ELSE 0e0 END) OVER ({e} {LAST})) END AS g FROM held"),
        ("amounts", f"SELECT run_id, bar_idx, epoch, w, rate, w0 * (g - 1) AS gain, w0 * g * live AS amount, coalesce(lag(w0 * g * live) OVER ({e}), w0) AS amount0 FROM grown"),
        ("worths", "SELECT *, 1 + sum(gain) OVER (PARTITION BY run_id, bar_idx) AS v FROM amounts"),
        ("book_bars", "SELECT run_id, bar_idx, epoch, max(v) AS v, sum(greatest(-amount0, 0e0)) AS shorts, sum(greatest(amount0, 0e0)) AS longs, sum(amount0 * coalesce(rate, 0e0)) AS paid, coalesce(sum(abs(amount / nullif(v, 0))), 0e0) AS drifted, sum(abs(w)) AS aimed, sum(abs(w - coalesce(amount / nullif(v, 0), 0e0))) AS turnover FROM worths GROUP BY run_id, bar_idx, epoch"),
        ("ahead_bars", "SELECT *, coalesce(nullif(lag(v) OVER (PARTITION BY run_id, epoch ORDER BY bar_idx), 0e0), 1e0) AS v0 FROM book_bars"),
        ("charged", f"SELECT run_id, bar_idx, -paid / v0 AS flow, v / v0 - paid / v0 - ({short_rate}) * CASE WHEN v0 < 0 THEN -longs / v0 ELSE shorts / v0 END AS f0, CASE WHEN {set_now} THEN turnover ELSE 0e0 END AS turnover, CASE WHEN {set_now} THEN aimed ELSE drifted END AS gross FROM ahead_bars"),
        ("factored", f"SELECT run_id, bar_idx, flow, f0 * (1 - ({cost}) * turnover) AS f, turnover, gross FROM charged"),
        *_walked("rated", every, cost, short_rate, cash),
        ("equity", Both(f"SELECT *, {cash} * {product('f', f' OVER (PARTITION BY run_id ORDER BY bar_idx {LAST})')} AS equity FROM factored", "SELECT run_id, bar_idx, flow, f, turnover, gross, equity FROM book_path")),
    ]


def _walked(source: str, every: int | str, cost: float | str, short_rate: float | str, cash: float, fill: float | str = 1.0, derisk: tuple[float, float, float] | None = None) -> Steps:
    """``book_path``: the same accounting bar by bar, in the oracle's words: lists
    over the symbols, one row of state for each run."""
    each = lambda x: f"list_transform(range(1, len(r) + 1), lambda i: {x})"
    key = "PARTITION BY run_id, symbol ORDER BY bar_idx"
    scale = "1e0"
    if derisk:
        start, full, floor = derisk
        scale = f"(CASE WHEN 1 - equity1 / peak1 <= {start} THEN 1e0 WHEN 1 - equity1 / peak1 >= {full} THEN {floor} ELSE 1 - (1 - equity1 / peak1 - {start}) / ({full} - {start}) * (1 - {floor}) END)"
    lists = f"""SELECT run_id, bar_idx, list(r ORDER BY symbol) AS r, list(there ORDER BY symbol) AS there, list(w ORDER BY symbol) AS w, list(rate ORDER BY symbol) AS rate
  FROM (SELECT run_id, bar_idx, symbol, coalesce(w, 0e0) AS w, coalesce(rate, 0e0) AS rate, CASE WHEN close IS NULL THEN 0e0 ELSE 1e0 END AS there,
          coalesce(close / nullif(lag(close) OVER ({key}), 0) - 1, 0e0) AS r FROM {source}) x GROUP BY run_id, bar_idx"""
    path = f"""SELECT run_id, bar_idx, {cash}::DOUBLE AS equity, {cash}::DOUBLE AS peak, {each("0e0")} AS held, 0e0 AS turnover, 0e0 AS gross, 1e0 AS f, 0e0 AS flow FROM bar_lists WHERE bar_idx = 0
  UNION ALL
  SELECT run_id, bar_idx, equity1 * (1 - ({cost}) * turnover), peak1, active, turnover, list_sum({each("abs(active[i])")}), f0 * (1 - ({cost}) * turnover), flow FROM (
    SELECT *, CASE WHEN bar_idx % ({every}) = 0 THEN list_sum({each("abs(active[i] - drifted[i])")}) ELSE 0e0 END AS turnover FROM (
      SELECT *, CASE WHEN bar_idx % ({every}) = 0 THEN {each(f"drifted[i] + ({fill}) * (w[i] * {scale} - drifted[i])")} ELSE drifted END AS active FROM (
        SELECT *, equity0 * f0 AS equity1, greatest(peak, equity0 * f0) AS peak1, {each("there[i] * CASE WHEN growth = 0 THEN held[i] ELSE held[i] * (1 + r[i]) / growth END")} AS drifted FROM (
          SELECT b.run_id, l.bar_idx, b.equity AS equity0, b.peak, b.held, l.r, l.there, l.w,
            1 + list_sum(list_transform(range(1, len(l.r) + 1), lambda i: b.held[i] * l.r[i])) AS growth,
            -list_sum(list_transform(range(1, len(l.r) + 1), lambda i: b.held[i] * l.rate[i])) AS flow,
            1 + list_sum(list_transform(range(1, len(l.r) + 1), lambda i: b.held[i] * l.r[i] - b.held[i] * l.rate[i] - (SHORT) * greatest(-b.held[i], 0e0))) AS f0
          FROM book_path b JOIN bar_lists l ON l.run_id = b.run_id AND l.bar_idx = b.bar_idx + 1) s1) s2) s3) s4"""
    path = path.replace("SHORT", str(short_rate).replace("run_id", "b.run_id"))
    return [("bar_lists", Both("SELECT 1 AS unused", lists)), ("book_path", Both("SELECT 1 AS unused", path))]


def performance(per_year: int = PER_YEAR, cash: float = 10_000.0) -> Steps:
    """``metrics``: one row of measures for each run."""
    run = "PARTITION BY run_id ORDER BY bar_idx"
    end = "max(CASE WHEN back = 1 THEN equity END)"
    return [
        ("bar_returns", f"SELECT *, equity / nullif(lag(equity) OVER ({run}), 0) - 1 AS r, equity / nullif(max(equity) OVER ({run} {LAST}), 0) - 1 AS drawdown, row_number() OVER (PARTITION BY run_id ORDER BY bar_idx DESC) AS back FROM equity"),
        (
            "metrics",
            f"""SELECT run_id, {end} AS final_equity, {end} / {cash} - 1 AS total_return,
            CASE WHEN count(r) < 2 THEN 0.0 ELSE coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt({per_year}), 0.0) END AS sharpe,
            CASE WHEN count(r) < 2 OR count(CASE WHEN r < 0 THEN 1 END) = 0 AND avg(r) <= 0 THEN 0.0 ELSE avg(r) * sqrt({per_year}) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 0) END AS sortino,
            coalesce(stddev_samp(r), 0.0) * sqrt({per_year}) AS volatility, min(drawdown) AS max_drawdown,
            CASE WHEN count(*) < 2 THEN 0.0 WHEN {end} <= 0 THEN -1.0 ELSE power({end} / {cash}, {per_year} / nullif((count(*) - 1) * 1e0, 0)) - 1 END AS cagr,
            sum(CASE WHEN turnover > 0 THEN 1 ELSE 0 END) AS n_trades, avg(CASE WHEN r > 1e-12 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS win_rate,
            sum(CASE WHEN r > 0 THEN r END) / nullif(-sum(CASE WHEN r < 0 THEN r END), 0) AS profit_factor, max(r) AS best, min(r) AS worst
            FROM bar_returns GROUP BY run_id""",
        ),
    ]


_METRICS = "SELECT run_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in "final_equity total_return sharpe sortino volatility max_drawdown cagr win_rate profit_factor best worst".split()) + ", n_trades FROM metrics"
_W = "SELECT bar_idx, symbol, round(w, 6) AS w FROM {}"


def flagship_sql() -> PanelQuery:
    return steps_sql("w", [*scores(), *weights(), *accounting(), *performance()], _METRICS)


def top_symbols(source: str, value: str, without: str = "", quote: str = "", n: int = 10) -> Steps:
    """``top_symbols``: symbol, total of the n symbols of most ``value`` that end in ``quote`` and do not begin with ``without``."""
    tests = [f"symbol LIKE '%{quote}'"] * bool(quote) + [f"symbol NOT LIKE '{without}%'"] * bool(without)
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return [("totals", f"SELECT symbol, sum({value}) AS total FROM {source}{where} GROUP BY symbol"), ("top_symbols", f"SELECT symbol, total FROM totals ORDER BY total DESC, symbol LIMIT {n}")]


AHEAD = "lead(close, {}) OVER (PARTITION BY {}symbol ORDER BY bar_idx) / nullif(close, 0) - 1 AS fwd"


def _ic(horizon: int = 1, known: bool = False) -> Steps:
    """``ic``: rank correlation of score and following return in each bar with five
    pairs. ``known``: ``scored`` has the return as ``fwd``."""
    rank = lambda c: f"CASE WHEN {c} IS NOT NULL THEN {place(c, 'run_id, bar_idx')} END"
    return [
        *([] if known else [("ahead", f"SELECT *, {AHEAD.format(horizon, 'run_id, ')} FROM scored")]),
        ("rounded", f"SELECT run_id, bar_idx, {digits('score')} AS score, {digits('fwd')} AS fwd FROM {'scored' if known else 'ahead'}"),
        ("ranked", f"SELECT run_id, bar_idx, {rank('score')} AS a, {rank('fwd')} AS b FROM rounded"),
        ("ic", "SELECT run_id, bar_idx, count(*) AS n, CASE WHEN count(*) >= 5 THEN covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END AS ic FROM ranked WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY run_id, bar_idx"),
        ("ic_stats", "SELECT run_id, count(ic) AS n, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS t, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(CASE WHEN ic > 1e-12 THEN 1e0 WHEN ic IS NOT NULL THEN 0e0 END) AS hit FROM ic WHERE bar_idx >= 8 GROUP BY run_id"),
        ("verdicts", "SELECT *, CASE WHEN n < 30 THEN 'dead' WHEN mean_ic > 0.02 AND t > 2 AND hit >= 0.55 THEN 'alive' WHEN mean_ic < -0.02 AND t < -2 THEN 'reversed' ELSE 'dead' END AS verdict FROM ic_stats"),
    ]


#: The last value of each kind in a day, inside a range.
_DAYS = "SELECT event_type AS symbol, date_trunc('day', ts) AS day, {} FROM events WHERE value IS NOT NULL AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'"
_SNAPPED = Both(
    _DAYS.format("max_by(value, struct(ts, event_id)) AS value") + " GROUP BY event_type, date_trunc('day', ts)",
    f"SELECT symbol, day, value FROM ({_DAYS.format('value, row_number() OVER (PARTITION BY event_type, date_trunc(%s, ts) ORDER BY ts DESC, event_id DESC) AS k' % repr('day'))}) d WHERE k = 1",
)


def all_sql() -> dict[str, PanelQuery | str]:
    book = [*scores(), *weights()]
    many = [*scores((1, 2, 4, 8, 20)), *weights()]
    paid = [*book, *accounting()]
    measured = [*paid, *performance()]
    w = lambda steps, result: steps_sql("w", steps, result)
    d = lambda steps, result: steps_sql("d", steps, result)
    out = {
        "a04_validate_panel": d([("landed", "SELECT symbol, ts, price FROM ticks UNION ALL SELECT symbol, ts, NULL AS price FROM ticks WHERE qty >= 50")], "SELECT symbol, ts, count(*) AS n, count(*) - count(price) AS n_empty FROM landed GROUP BY symbol, ts HAVING count(*) > 1 OR count(price) < count(*)"),
        "a05_funding_event": d([], "SELECT bar_idx, symbol, round(coalesce((discount - 0.05) / 100, 0.0), 8) AS rate FROM grid"),
        "a06_funding_prevailing": d([("seen", "SELECT *, count(discount) OVER (PARTITION BY symbol ORDER BY bar_idx) AS block FROM grid")], Both(f"SELECT bar_idx, symbol, round(coalesce(last_value((discount - 0.05) / 100, true) OVER (PARTITION BY symbol ORDER BY bar_idx {LAST}), 0.0), 8) AS rate FROM grid", "SELECT bar_idx, symbol, round(coalesce(max((discount - 0.05) / 100) OVER (PARTITION BY symbol, block), 0.0), 8) AS rate FROM seen")),
        "a09_dense": w([], "SELECT symbol, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars))"),
        "a10_ragged_grid": d([], "SELECT bar_idx, symbol, close FROM grid"),
        "a11_panel": w([], "SELECT bar_idx, symbol, open, high, low, close, volume FROM grid"),
        "a12_volumes": d([], "SELECT bar_idx, symbol, coalesce(volume, 0.0) AS volume FROM grid"),
        "a13_clean_universe": d([("names", "SELECT concat(symbol, CASE WHEN length(symbol) = 1 THEN '-X' WHEN symbol LIKE '%0' THEN 'usdt' ELSE 'USDT' END) AS symbol, count(*) AS n_bars FROM bars GROUP BY symbol")], f"SELECT symbol, n_bars FROM names WHERE n_bars >= 365 AND symbol NOT IN ({', '.join(map(repr, PEGGED))}) AND MATCHES[symbol|{LISTED};]"),
        "a14_top_by_volume": d(top_symbols("bars", "volume", "9"), "SELECT symbol, round(total, 4) AS volume FROM top_symbols"),
        "a14_top_of_quote": w(top_symbols("bars", "traded", "Brand#1", "5", 2), "SELECT symbol, round(total, 2) AS traded FROM top_symbols"),
        "a18_snap_last": _SNAPPED,
        "a24_bars": w([], "SELECT symbol, ts, open, high, low, close, volume FROM bars"),
        "a25_survivors": d([], "SELECT symbol FROM bars GROUP BY symbol HAVING max(ts) = (SELECT max(ts) FROM bars)"),
        "c05_range_join": w([("windows", "SELECT * FROM (VALUES (0, 0, 60), (1, 60, 120), (2, 100, 180)) AS v(id, lo, hi)"), within("inside", "grid", "windows", "w.id, g.symbol, g.close", "lo", "hi")], "SELECT id, symbol, round(avg(close), 6) AS mean_close FROM inside GROUP BY id, symbol"),
        "f01_forward_returns": w([*scores(), *_ic()], "SELECT bar_idx, symbol, round(fwd, 6) AS fwd FROM ahead"),
        "f02_rank_ic": w([*scores(), *_ic()], "SELECT bar_idx, n, round(ic, 6) AS ic FROM ic"),
        "f03_information_coefficient": w([*scores((1, 2, 4, 8, 20)), *_ic()], "SELECT run_id, n, round(mean_ic, 6) AS mean_ic, round(t, 6) AS t, round(ir, 6) AS ir, round(hit, 6) AS hit FROM ic_stats"),
        "f04_verdict": w([*scores((1, 2, 4, 8, 20)), *_ic()], "SELECT run_id, verdict FROM verdicts"),
        "f06_survival": w([*scores((1, 2, 4, 8, 20)), *_ic()], "SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict"),
        "h01_neutral_weights": w(book, _W.format("weighted")),
        "h02_top_k": w([*scores(), *weights("top", 5)], _W.format("weighted")),
        "h03_directional": w([*scores(), *weights("directional")], _W.format("weighted")),
        "h04_trailing_value": w([*book, *limits()], "SELECT bar_idx, symbol, round(dv, 6) AS dv FROM limited"),
        "h05_shortability": w([*book, *limits(3_500_000.0)], _W.format("limited")),
        "h07_capacity": w([*book, *limits(0.0, 0.02)], _W.format("limited")),
        "h09_schedule": w(book, "SELECT DISTINCT bar_idx FROM weighted WHERE bar_idx >= 1 AND bar_idx % 4 = 0"),
        "i01_book_accounting": w(paid, "SELECT bar_idx, round(equity, 4) AS equity, round(f, 8) AS factor FROM equity"),
        "i03_short_financing": w([*book, *accounting(short_rate=0.0005, funding=RATE)], "SELECT bar_idx, round(equity, 4) AS equity, round(flow, 8) AS flow FROM equity"),
        "i04_turnover": w(paid, "SELECT bar_idx, round(turnover, 6) AS turnover FROM equity WHERE bar_idx >= 1 AND bar_idx % 4 = 0"),
        "i05_forced_exit": d([*scores(), *weights(), *accounting(every=20)], "SELECT bar_idx, sum(live) AS n_live FROM grown GROUP BY bar_idx"),
        "i08_gross": w(paid, "SELECT bar_idx, round(gross, 6) AS gross FROM equity"),
        "i09_trade_log": w(paid, "SELECT bar_idx, round(turnover, 6) AS turnover, round(turnover * 0.001 * equity, 4) AS cost FROM equity WHERE turnover > 0"),
        "j01_bar_returns": w(measured, "SELECT bar_idx, round(r, 8) AS r FROM bar_returns WHERE r IS NOT NULL"),
        "j05_max_drawdown": w(measured, "SELECT run_id, round(max_drawdown, 6) AS max_drawdown FROM metrics"),
        "j09_metrics": w(measured, _METRICS),
        "j10_underwater": w(measured, "SELECT bar_idx, round(drawdown, 6) AS drawdown FROM bar_returns"),
        "j16_block_returns": w([*measured, ("blocks", f"SELECT floor(bar_idx / 21.0) AS block, {product('(1 + coalesce(r, 0.0))')} - 1 AS r FROM bar_returns GROUP BY floor(bar_idx / 21.0)")], "SELECT count(*) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY r), 6) AS median_r, round(max(r), 6) AS best, round(min(r), 6) AS worst FROM blocks"),
        "k01_split": w(measured, "SELECT CASE WHEN bar_idx < 214 THEN 'train' ELSE 'test' END AS side, count(*) AS n, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe FROM bar_returns GROUP BY CASE WHEN bar_idx < 214 THEN 'train' ELSE 'test' END"),
        "k05_subperiods": w(measured, "SELECT least(floor(bar_idx / 60.0), 4) AS part, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe FROM bar_returns GROUP BY least(floor(bar_idx / 60.0), 4)"),
        "k11_sweep": w([*many, *accounting(), *performance()], _METRICS),
        "k12_in_and_out_of_sample": w(
            [*many, *accounting(), *performance(), ("sides", "SELECT run_id, avg(CASE WHEN bar_idx < 200 THEN r END) / nullif(stddev_samp(CASE WHEN bar_idx < 200 THEN r END), 0) * sqrt(52) AS train, avg(CASE WHEN bar_idx >= 200 THEN r END) / nullif(stddev_samp(CASE WHEN bar_idx >= 200 THEN r END), 0) * sqrt(52) AS test FROM bar_returns GROUP BY run_id")],
            "SELECT run_id, round(train, 6) AS train, round(test, 6) AS test, CASE WHEN train > 0.5 AND test > 0.5 THEN 'candidate' WHEN train > 0.5 AND test > 0.2 THEN 'promising' WHEN train > 0.5 AND test <= 0 THEN 'overfit' WHEN train > 0.5 THEN 'faded' WHEN test > 0.5 THEN 'noise' ELSE 'dead' END AS verdict FROM sides",
        ),
        "l01_latest_book": w(book, "SELECT symbol, round(w, 6) AS w FROM weighted WHERE bar_idx = (SELECT max(bar_idx) FROM weighted) AND abs(w) > 0.000000001"),
        "l07_funding_sum": "SELECT p_brand AS symbol, date_trunc('day', l_shipdate) AS ts, round(sum((l_discount - 0.05) / 100), 8) AS rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, date_trunc('day', l_shipdate)",
        "l08_pair_return": w([("pairs", "SELECT bar_idx, symbol, (discount - 0.05) / 100 AS funding, tax - 0.04 AS basis FROM grid")], "SELECT bar_idx, symbol, round(funding - coalesce(basis - lag(basis) OVER (PARTITION BY symbol ORDER BY bar_idx), 0.0), 8) AS ret FROM pairs"),
        "l16_market_return": w([("rets", "SELECT bar_idx, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx), 0) - 1 AS r FROM grid")], "SELECT bar_idx, round(avg(r), 8) AS r FROM rets GROUP BY bar_idx HAVING count(r) = count(*)"),
        "m05_latest_price": w([], "SELECT symbol, close FROM grid WHERE bar_idx = (SELECT max(bar_idx) FROM grid) AND close IS NOT NULL"),
        "n01_top_of_book": w([("levels", "SELECT ts, l_linestatus AS side, round(price, 0) AS price, sum(qty) AS qty FROM ticks GROUP BY ts, l_linestatus, round(price, 0)")], "SELECT ts, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread FROM (SELECT ts, max(CASE WHEN side = 'O' THEN price END) AS bid, min(CASE WHEN side = 'F' THEN price END) AS ask FROM levels GROUP BY ts) t"),
        "n02_levels": w([], "SELECT ts, l_linestatus AS side, round(price, 0) AS price, sum(qty) AS qty FROM ticks GROUP BY ts, l_linestatus, round(price, 0)"),
    }
    return out
