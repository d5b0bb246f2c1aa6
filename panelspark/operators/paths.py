"""Books whose next weights depend on their own past: partial fills, exposure cut
in drawdowns, and single-asset ledgers of cash and units.

**Partial fills.** With Q the worth of a book before costs and a the amounts it
holds, a rebalance of which the share f is filled sets a to (1 - f) a + f w s Q,
where s is the cut. That is linear in q = s Q, so what a rebalance at j adds to the book at
a later bar t is q(j) times a *response*, f (1 - f)^lag times the sum over the
symbols of w(j) and the growth from j to t. Responses are sums over symbols:
tasks that hold some symbols each add up their own, Spark adds up the tasks',
and what is walked bar by bar is a run's worth alone, a few numbers for each
bar. Lags end where (1 - f)^lag is below the last bit of a double.

With the worth known the amounts of each symbol follow by themselves, and so do
turnover, funding and financing, again as sums over symbols. Only the cut of a
drawdown needs them beforehand, as the equity that it looks at has paid them:
there the two steps alternate until no cut changes. A cut depends on earlier
bars alone, so each round settles one more rebalance at least; costs being
small, some rounds settle all.

**Ledgers.** A fill sets an account's units to a share of its equity, and an
account that went flat starts anew: its equity is a product over the stretches
between flat positions, taken by windows. Inside a stretch the fills are folded
in order, in expressions alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.operators import book
from panelspark.sources.panels import Both, PanelQuery, steps_sql
from panelspark.sources.shared import saved

#: The cut in a drawdown: none up to the first, the last's share of the exposure from the second on.
DERISK = (0.05, 0.20, 0.25)
_CELLS = ("bar_idx", "epoch", "set", "growth", "live", "w", "rate", "fill")


def _cells(weighted: DataFrame, every: int) -> DataFrame:
    """Each symbol's bars: growth since the epoch's start, whether it was there since,
    and the weight set at that start."""
    rows = weighted.selectExpr("CAST(run_id AS BIGINT) AS run_id", "CAST(bar_idx AS BIGINT) AS bar_idx", "symbol", "CAST(close AS DOUBLE) AS close", "coalesce(CAST(w AS DOUBLE), 0e0) AS w", "coalesce(CAST(rate AS DOUBLE), 0e0) AS rate", "CAST(cost AS DOUBLE) AS cost", "CAST(fill AS DOUBLE) AS fill")
    rows = rows.withColumn("epoch", F.floor((F.col("bar_idx") - 1) / every))
    along = Window.partitionBy("run_id", "symbol").orderBy("bar_idx")
    here = Window.partitionBy("run_id", "symbol", "epoch").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    factor = F.coalesce(F.col("close") / F.nullif(F.lag("close").over(along), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("factor", factor).withColumn("live", F.min(F.when(F.col("close").isNull(), 0.0).otherwise(1.0)).over(here))
    factor = F.when(F.col("live") > 0, F.col("factor")).otherwise(1.0)
    lost, grown = F.min(factor).over(here) <= 0, F.exp(F.sum(F.ln(F.when(factor > 0, factor).otherwise(1.0))).over(here))
    rows = rows.withColumn("growth", F.when(lost, 0.0).otherwise(grown))
    return rows.withColumn("set", F.when((F.col("bar_idx") >= 1) & (F.col("bar_idx") % every == 0), 1.0).otherwise(0.0)).select("run_id", "symbol", *_CELLS, "cost")


def _by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The arrays of one symbol of one run after the other, from rows sorted so."""
    held: pa.Table | None = None

    def cut(t: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
        run, symbol = t.column("run_id").to_numpy(), t.column("symbol").to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (symbol[1:] != symbol[:-1])][: t.num_rows]).tolist()
        ends = [*new[1:], t.num_rows] if new else []
        whole = list(zip(new, ends, strict=True))[: None if last else -1]
        out = [(int(run[a]), {c: t.column(c).slice(a, b - a).to_numpy() for c in t.column_names if c not in ("run_id", "symbol")}) for a, b in whole]
        return out, None if last or not new else t.slice(new[-1])

    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        done, held = cut(t, False)
        yield from done
    if held is not None and held.num_rows:
        yield from cut(held.combine_chunks(), True)[0]


def _lags(fill: float, epochs: int) -> int:
    """Rebalances after which what was held before counts for nothing."""
    return min(epochs, 1 if fill >= 1 else 1 + math.ceil(math.log(1e-18) / math.log(1 - fill))) if fill > 0 else 1


def _added(sums: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return more if sums is None else {c: sums[c] + x for c, x in more.items()}


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run_id, bar_idx, lag, response``, added up over the symbols of a task."""

    def out(run_id: int, bars: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        t, lag = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(t), run_id)), pa.array(bars[t]), pa.array(lag.astype(np.int32)), pa.array(total[t, lag])], names=["run_id", "bar_idx", "lag", "response"])

    now, bars, total = None, None, None
    for run_id, x in _by_symbol(batches):
        if run_id != now:
            if now is not None:
                yield out(now, bars, total)
            now, bars, total = run_id, x["bar_idx"], None
        elif len(x["bar_idx"]) != len(bars):
            raise ValueError("every bar of a run needs the same symbols")
        first, fill = int(x["epoch"][0]), x["fill"][0]
        epoch = (x["epoch"] - first).astype(np.int64)  # 0 is the stretch before any rebalance
        count = int(epoch[-1]) + 1
        last = np.r_[np.flatnonzero(epoch[1:] != epoch[:-1]), len(epoch) - 1]  # each epoch's last bar
        at_set = np.zeros(count)  # the weight set where an epoch begins
        sets = np.flatnonzero(x["set"] > 0)
        begun = epoch[sets] + 1
        at_set[begun[begun < count]] = x["w"][sets[begun < count]]
        kept = x["growth"][last] * x["live"][last]
        lags = _lags(fill, count)
        if total is None:
            total = np.zeros((len(epoch), lags))
        carried = at_set * fill  # of what was set ``lag`` epochs ago, by epoch
        for lag in range(lags):
            total[:, lag] += carried[epoch] * (x["growth"] - 1)
            carried = np.r_[0.0, (carried * kept)[:-1]] * (1 - fill)
    if now is not None:
        yield out(now, bars, total)


def _worth(every: int, cash: float, derisk: tuple[float, float, float] | None) -> callable:
    """Walks a run's worth: the rows are bars with their responses, turnover and charges."""

    def cut(equity: float, peak: float) -> float:
        if not derisk or peak <= 0:
            return 1.0
        start, full, floor = derisk
        loss = 1 - equity / peak
        return 1.0 if loss <= start else floor if loss >= full else 1 - (loss - start) / (full - start) * (1 - floor)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        put, worth, equity = [], np.ones(len(rows)), np.full(len(rows), cash)
        puts = np.zeros(len(rows))
        base = peak = 1.0
        peak = cash
        for t, (bar, lags, responses, turnover, charge, cost) in enumerate(zip(rows.bar_idx, rows.lags, rows.responses, rows.turnover, rows.charge, rows.cost, strict=True)):
            if t:
                back = len(put) - 1 - np.asarray(lags, np.int64)
                past = np.asarray(put)[back] if len(back) else np.zeros(0)
                worth[t] = base + float(past @ np.asarray(responses, float))
                before = worth[t - 1]
                equity[t] = equity[t - 1] * ((worth[t] - charge) / before if before else 0.0)
                peak = max(peak, equity[t])
                if bar % every == 0:
                    base = worth[t]
                    put.append(base * cut(equity[t], peak))
                    puts[t] = put[-1]
                    equity[t] *= 1 - cost * turnover
        return pd.DataFrame({"run_id": rows.run_id, "bar_idx": rows.bar_idx, "worth": worth, "put": puts, "equity": equity})

    return walk


def _amounts(short_rate: float) -> callable:
    """``run_id, bar_idx, charge, turnover, gross``, added up over the symbols of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(run_id: int, bars: np.ndarray, s: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(bars), run_id)), pa.array(bars), *(pa.array(s[c]) for c in ("charge", "turnover", "gross"))], names=["run_id", "bar_idx", "charge", "turnover", "gross"])

        now, bars, sums = None, None, None
        for run_id, x in _by_symbol(batches):
            if run_id != now:
                if now is not None:
                    yield out(now, bars, sums)
                now, bars, sums = run_id, x["bar_idx"], None
            n, fill = len(x["bar_idx"]), x["fill"][0]
            sets = np.flatnonzero(x["set"] > 0)
            drifted, held, traded = np.zeros(n), np.zeros(n), np.zeros(n)
            amount, begin = 0.0, 0
            for end in [*(sets + 1).tolist(), n]:  # an epoch's bars end with its rebalance
                drifted[begin:end] = amount * x["growth"][begin:end] * x["live"][begin:end]
                held[begin:end] = drifted[begin:end]
                if end > begin and x["set"][end - 1] > 0:
                    aimed = fill * (x["w"][end - 1] * x["put"][end - 1] - drifted[end - 1])
                    traded[end - 1] = abs(aimed)
                    amount = held[end - 1] = drifted[end - 1] + aimed
                begin = end
            before = np.r_[0.0, held[:-1]]
            worth, worth0 = x["worth"], np.r_[1.0, x["worth"][:-1]]
            short = np.maximum(-before * np.sign(worth0), 0) * np.sign(worth0)
            over = np.where(worth != 0, np.abs(worth), np.inf)
            sums = _added(sums, {"charge": before * x["rate"] + short_rate * short, "turnover": traded / over, "gross": np.abs(held) / over})
        if now is not None:
            yield out(now, bars, sums)

    return run


def walked(weighted: DataFrame, every: int = 4, short_rate: float = 0.0, cash: float = 10_000.0, derisk: tuple[float, float, float] | None = None, rounds: int = 200) -> DataFrame:
    """``run_id, bar_idx, turnover, gross, equity`` of ``weighted`` (``run_id, bar_idx,
    symbol, close, w, rate, cost, fill``; cost and fill are constant in a run, its
    bars are numbered from 0 and have the same symbols). Only the share ``fill``
    of each intended trade is made. A run's symbols may lie in any number of
    tasks; a task holds one symbol's bars, and a run's bars by lags as sums."""
    cells = saved(_cells(weighted, every))
    key = ["run_id", "symbol", "bar_idx"]
    parts = cells.select("run_id", "symbol", *_CELLS).repartition("run_id", "symbol").sortWithinPartitions(*key)
    responses = parts.mapInArrow(_responses, "run_id long, bar_idx long, lag int, response double")
    responses = responses.groupBy("run_id", "bar_idx", "lag").agg(F.sum("response").alias("response"))
    by_bar = responses.groupBy("run_id", "bar_idx").agg(F.collect_list(F.struct("lag", "response")).alias("r")).select("run_id", "bar_idx", F.col("r.lag").alias("lags"), F.col("r.response").alias("responses"))
    bars = cells.groupBy("run_id", "bar_idx").agg(F.max("cost").alias("cost"))
    none = [F.array().cast("array<int>"), F.array().cast("array<double>")]
    bars = saved(bars.join(by_bar, ["run_id", "bar_idx"], "left").select("run_id", "bar_idx", "cost", F.coalesce("lags", none[0]).alias("lags"), F.coalesce("responses", none[1]).alias("responses")))
    schema = "run_id long, bar_idx long, worth double, put double, equity double"
    sums = bars.select("run_id", "bar_idx", *(F.lit(0.0).alias(c) for c in ("charge", "turnover", "gross")))
    puts = None
    for _ in range(rounds):
        path = saved(bars.join(sums, ["run_id", "bar_idx"]).drop("gross").groupBy("run_id").applyInPandas(_worth(every, cash, derisk), schema))
        if puts is not None:
            both = path.join(puts, ["run_id", "bar_idx"])
            change = both.agg(F.max(F.abs(F.col("put") - F.col("put_before")))).first()[0]
            if not change or change < 1e-12:
                return path.join(sums, ["run_id", "bar_idx"]).select("run_id", "bar_idx", "turnover", "gross", "equity")
        puts = path.select("run_id", "bar_idx", F.col("put").alias("put_before"))
        told = cells.select("run_id", "symbol", *_CELLS).join(path.select("run_id", "bar_idx", "worth", "put"), ["run_id", "bar_idx"])
        shares = told.repartition("run_id", "symbol").sortWithinPartitions(*key).mapInArrow(_amounts(short_rate), "run_id long, bar_idx long, charge double, turnover double, gross double")
        sums = saved(shares.groupBy("run_id", "bar_idx").agg(*(F.sum(c).alias(c) for c in ("charge", "turnover", "gross"))))
    raise RuntimeError(f"the cuts of a drawdown still change after {rounds} rounds")


_ACCOUNT = ["run_id", "symbol"]


def _folded(fills: DataFrame, stretch: list[str]) -> DataFrame:
    """``fills`` with what an account holds after each, for 1 at its stretch's start:
    ``money, units``; and ``factor``, its worth after the stretch's last fill."""

    def step(done: Column, x: Column) -> Column:
        now = F.element_at(done, -1)
        delta = x["target"] * (now["money"] + now["units"] * x["price"]) / x["price"] - now["units"]
        # as an account of 10,000 would judge what is no trade
        delta = F.when(F.abs(delta) < 1e-16, 0.0).otherwise(delta)
        price = x["price"] * (1 + x["slip"] * F.signum(delta))
        money, units = now["money"] - delta * price - F.abs(delta) * price * x["fee"], now["units"] + delta
        return F.concat(done, F.array(F.struct(money.alias("money"), units.alias("units"), (money + units * x["price"]).alias("worth"), x["i"].alias("i"))))

    items = F.array_sort(F.collect_list(F.struct("i", "target", "price", "slip", "fee")))
    start = F.array(F.struct(F.lit(1.0).alias("money"), F.lit(0.0).alias("units"), F.lit(1.0).alias("worth"), F.lit(-1).cast("long").alias("i")))
    states = fills.groupBy(*stretch).agg(F.aggregate(items, start, step).alias("states"))
    return states.select(*stretch, F.explode(F.slice("states", 2, F.size("states"))).alias("s"), F.element_at("states", -1)["worth"].alias("factor")).select(*stretch, "factor", "s.*")


def ledger(targets: DataFrame, slip: str | float = 0.0005, fee: str | float = 0.001, cash: float = 10_000.0) -> DataFrame:
    """``run_id, bar_idx, symbol, units, equity, filled`` of ``targets`` (``run_id, bar_idx,
    symbol, open, close, target``): an account for each run and symbol; ``slip`` and
    ``fee`` may be SQL expressions of ``run_id``. A target (a share of equity, cut to -1
    and 1) is filled at the open of the symbol's next bar, if it is not the one
    held to; slippage goes against the trade and the commission is on its value.
    A bar without prices is none; a null target changes nothing."""
    rows = targets.selectExpr("run_id", "CAST(bar_idx AS BIGINT) AS bar_idx", "symbol", "CAST(open AS DOUBLE) AS price", "CAST(close AS DOUBLE) AS close", "CASE WHEN target IS NOT NULL THEN greatest(least(CAST(target AS DOUBLE), 1e0), -1e0) END AS target").where("price IS NOT NULL AND close IS NOT NULL")
    along = Window.partitionBy(*_ACCOUNT).orderBy("bar_idx")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    # what is asked for at a bar, what is held to until then, and whether that is a fill
    rows = rows.withColumn("asked", F.lag("target").over(along)).withColumn("held_to", F.coalesce(F.last("asked", ignorenulls=True).over(past), F.lit(0.0)))
    rows = rows.withColumn("fill", F.col("asked").isNotNull() & (F.col("asked") != F.col("held_to")))
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fills", F.sum(F.when(F.col("fill"), 1).otherwise(0)).over(upto)).withColumn("stretch", F.sum(F.when(F.col("fill") & (F.col("held_to") == 0), 1).otherwise(0)).over(upto))
    rows = saved(rows.select("run_id", "symbol", "bar_idx", "price", "close", "asked", "fill", "fills", "stretch"))
    fills = rows.where("fill").select("run_id", "symbol", "stretch", F.col("fills").alias("i"), F.col("asked").alias("target"), "price", F.expr(str(slip)).cast("double").alias("slip"), F.expr(str(fee)).cast("double").alias("fee"))
    key = [*_ACCOUNT, "stretch"]
    folded = saved(_folded(fills, key))
    ends = folded.groupBy(*key).agg(F.max("factor").alias("factor"))
    # an account that lost all is folded as a whole: below zero its trades turn around
    lost = saved(ends.where("factor <= 0").select(*_ACCOUNT).distinct())
    before = Window.partitionBy(*_ACCOUNT).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.join(lost, _ACCOUNT, "left_anti").select(*key, F.coalesce(F.exp(F.sum(F.ln("factor")).over(before)), F.lit(1.0)).alias("start"))
    whole = _folded(fills.join(lost, _ACCOUNT, "left_semi"), _ACCOUNT).select(*_ACCOUNT, F.col("i").alias("fills"), "money", "units")
    states = folded.join(starts, key).select(*_ACCOUNT, F.col("i").alias("fills"), (F.col("money") * F.col("start")).alias("money"), (F.col("units") * F.col("start")).alias("units")).unionAll(whole)
    out = rows.join(states, [*_ACCOUNT, "fills"], "left")
    units, money = cash * F.coalesce("units", F.lit(0.0)), cash * F.coalesce("money", F.lit(1.0))
    return out.select("run_id", "bar_idx", "symbol", units.alias("units"), (money + units * F.col("close")).alias("equity"), F.col("fill").alias("filled"))


#: Cost and share filled of the sweep (fixed values).
EXECUTION = {1: (0.001, 1.0), 2: (0.0002, 1.0), 3: (-0.0001, 1.0), 4: (-0.0001, 0.7), 5: (-0.0001, 0.5), 6: (0.0001, 0.5)}


def _settings(values: dict[int, tuple[float, float]]) -> tuple[str, str]:
    return "settings", f"SELECT * FROM (VALUES {', '.join(f'({k}, CAST({c} AS DOUBLE), CAST({f} AS DOUBLE))' for k, (c, f) in values.items())}) AS v(id, cost, fill)"


def _case(values: dict[int, tuple[float, float]], at: int) -> str:
    return "(CASE run_id " + " ".join(f"WHEN {k} THEN {v[at]!r}" for k, v in values.items()) + " END)"


def _queries() -> dict[str, tuple[PanelQuery, dict, str]]:
    """Name: the steps to ``settled`` (and the oracle's path), settings of :func:`walked`, and the result."""
    base = [*book.scores(), *book.weights()]

    def made(values: dict[int, tuple[float, float]], every: int, derisk: tuple[float, float, float] | None, result: str) -> tuple[PanelQuery, dict, str]:
        steps = [*base, _settings(values), ("settled", "SELECT s.id AS run_id, w.bar_idx, w.symbol, w.close, w.w, 0e0 AS rate, s.cost, s.fill FROM (SELECT bar_idx, symbol, close, w FROM weighted) w CROSS JOIN settings s")]
        steps += book._walked("settled", every, _case(values, 0), 0.0, 10_000.0, _case(values, 1), derisk)
        steps += [("walked", Both("SELECT * FROM settled", "SELECT run_id, bar_idx, turnover, gross, equity FROM book_path"))]
        return steps_sql("w", steps, result), {"every": every, "derisk": derisk}, result

    path = "SELECT bar_idx, round(turnover, 6) AS turnover, round(gross, 6) AS gross, round(equity, 4) AS equity FROM walked"
    sharpe = "SELECT run_id, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(52), 6) AS sharpe, round(max(CASE WHEN back = 1 THEN equity END) / 10000 - 1, 6) AS total_return FROM (SELECT run_id, bar_idx, equity, equity / nullif(lag(equity) OVER (PARTITION BY run_id ORDER BY bar_idx), 0) - 1 AS r, row_number() OVER (PARTITION BY run_id ORDER BY bar_idx DESC) AS back FROM walked) x GROUP BY run_id"
    return {
        "i06_partial_fills": made({1: (0.001, 0.5)}, 4, None, path),
        "i07_drawdown_breaker": made({1: (0.001, 1.0)}, 4, DERISK, path),
        "k16_execution_sweep": made(EXECUTION, 1, None, sharpe),
    }


def _run(spark: SparkSession, sf_dir: str, query: PanelQuery, settings: dict, result: str) -> DataFrame:
    settled = PanelQuery(query.steps, "SELECT * FROM settled").run(spark, sf_dir)
    return spark.sql(result.replace("FROM walked", "FROM {walked}"), walked=walked(settled, **settings))


def queries() -> dict:
    return {name: lambda spark, sf_dir, q=q, s=s, r=r: _run(spark, sf_dir, q, s, r) for name, (q, s, r) in _queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.duckdb() for name, (q, _, _) in _queries().items()}
