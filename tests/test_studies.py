"""Significance, streams and studies against plain versions."""

import datetime
import math
import os
import random
from statistics import NormalDist, mean, stdev

import pytest
from pyspark.sql import functions as F

from panelspark.operators import significance
from panelspark.plans import gauntlet, sleeves, studies
from panelspark.sources.panels import run_query
from panelspark.streaming import bars, state

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_significance(spark):
    rng = random.Random(5)
    runs = {k: [rng.gauss(0.01 * k, 0.05) for _ in range(50)] for k in range(4)} | {9: [0.1, 0.2]}
    frame = spark.createDataFrame([(k, r) for k, rs in runs.items() for r in rs] + [(0, None)], "run_id int, r double")
    stats = significance.moments(frame)
    psr = {r.run_id: r.psr for r in significance.probabilistic(stats).collect()}
    dsr = {r.run_id: r.dsr for r in significance.deflated(stats).collect()}
    ratios = [mean(rs) / stdev(rs) for rs in runs.values() if len(rs) > 2]
    z = NormalDist().inv_cdf
    expected = stdev(ratios) * ((1 - significance.GAMMA) * z(1 - 1 / 4) + significance.GAMMA * z(1 - 1 / (4 * math.e)))
    for k, rs in runs.items():
        if len(rs) < 3:
            assert psr[k] is None
            continue
        m, s = mean(rs), stdev(rs)
        skew, kurt = mean([((r - m) / s) ** 3 for r in rs]), mean([((r - m) / s) ** 4 for r in rs])
        spread = math.sqrt(1 - skew * m / s + (kurt - 1) / 4 * (m / s) ** 2)
        assert psr[k] == pytest.approx(NormalDist().cdf(m / s * math.sqrt(49) / spread))
        assert dsr[k] == pytest.approx(NormalDist().cdf((m / s - expected) * math.sqrt(49) / spread))


def test_normal_distribution(spark):
    """Against the standard library, to twelve digits, and its inverse as far out as a billion trials."""
    xs = [-9.0, -8.0, -7.5, -3.0, -1e-9, 0.0, 0.3, 1.0, 2.5, 5.0, 7.9, 12.0, None]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in frame.selectExpr("x", f"{significance.normal_cdf('x')} AS p").collect():
        assert r.p is None if r.x is None else r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-13)
    ps = [1e-9, 0.01, 0.3, 0.5, 0.75, 0.99, 1 - 1e-9, 0.0, 1.0, None]
    frame = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in frame.selectExpr("p", f"{significance.normal_quantile('p')} AS z").collect():
        assert r.z is None if r.p in (None, 0.0, 1.0) else r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-7, abs=1e-12)


@needs_tables
def test_sleeves(spark):
    """Weights in each sleeve's own universe alone, gates and gross of each, and a book of their sum at equal risk."""
    formula, own = sleeves._fixture()
    steps = [*studies.OVERLAY, *sleeves.sleeve_book(formula, own, "aligned", every=4, suffix="1")]
    run = lambda result: sleeves.steps_sql("w", steps, result).run(spark, SF).collect()
    rows = [r for r in run("SELECT * FROM sleeve_weights WHERE bar_idx % 4 = 0") if abs(r.w) > 1e-12]
    member = lambda k, symbol, bar: any(lo <= bar < hi and symbol.startswith(p.rstrip("%")) and (p.endswith("%") or p == symbol) for p, lo, hi in own[k - 1].members)
    assert {r.run_id for r in rows} == {1, 2, 3, 4} and all(member(r.run_id, r.symbol, r.bar_idx) for r in rows)
    assert {r.symbol[:7] for r in rows if r.run_id == 3 and r.bar_idx >= 200} <= {"Brand#2", "Brand#3"} and any(r.symbol.startswith("Brand#1") for r in rows if r.run_id == 3)
    gross = {}
    for r in rows:
        gross[r.run_id, r.bar_idx] = gross.get((r.run_id, r.bar_idx), 0.0) + abs(r.w)
    assert all(g <= (3 if k == 1 else 1) + 1e-9 for (k, _), g in gross.items())
    shares = {r.run_id: (r.vol, r.share) for r in run("SELECT * FROM sleeve_shares")}
    assert all(x[1] == pytest.approx(1 / x[0] / sum(1 / v for v, _ in shares.values())) for x in shares.values())
    last, book = max(r.bar_idx for r in rows), {}
    for r in rows:
        if r.bar_idx == last:
            name = r.symbol[:-1] if r.symbol.endswith("1") else r.symbol
            book[name] = book.get(name, 0.0) + shares[r.run_id][1] * r.w
    got = {r.symbol: r.weight for r in run("SELECT * FROM alpha_book")}
    assert got == pytest.approx({k: v for k, v in book.items() if abs(v) > 1e-6})
    for wrong in (lambda: sleeves.book.weights("neutrl"), lambda: studies.walk(grid={100: studies.reversal_of(1)})):
        with pytest.raises(ValueError):
            wrong()


@needs_tables
def test_gauntlet(spark):
    """Each figure of the gauntlet from its own query; verdicts by the three thresholds."""
    rows = gauntlet.gauntlet(spark, SF, draws=3, size=10).collect()
    assert [r.hypothesis for r in sorted(rows, key=lambda r: r.setting)] == list(gauntlet.HYPOTHESES)
    steps = gauntlet._booked(gauntlet._full())
    ratios = {}
    for r in gauntlet.steps_sql("w", steps, "SELECT run_id, r FROM bar_returns WHERE r IS NOT NULL").run(spark, SF).collect():
        ratios.setdefault(r.run_id, []).append(r.r)
    ratios = {k: mean(rs) / stdev(rs) for k, rs in ratios.items()}
    z = NormalDist().inv_cdf
    for r in rows:
        config = r.setting // gauntlet.PER
        trials = {k: x for k, x in ratios.items() if k // gauntlet.PER == config}
        assert len(trials) == gauntlet.PER and trials[r.setting] == max(trials.values())
        assert 0 <= r.dsr <= r.psr <= 1 and 0 <= r.positive <= 1 and (3 * r.positive) == pytest.approx(round(3 * r.positive))
        expected = stdev(trials.values()) * ((1 - significance.GAMMA) * z(1 - 1 / 3) + significance.GAMMA * z(1 - 1 / (3 * math.e)))
        assert (r.psr > 0.5) == (trials[r.setting] > 0) and (r.dsr > 0.5) == (trials[r.setting] > expected)
        passed = r.oos_sharpe > 0.5 and r.positive > 0.65 and r.dsr > 0.6
        assert r.verdict == ("PASS" if passed else "weak" if r.oos_sharpe > 0 else "REJECT")


@needs_tables
def test_streams_equal_batch(spark):
    batch = {}
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS at", "event_type AS symbol", "value").collect()
    for r in sorted((r for r in events if r.value is not None), key=lambda r: (r.at, r.event_id)):
        batch.setdefault((r.symbol, r.at // 3_600_000), []).append(r.value)
    got = bars.whole_bars(spark, SF).selectExpr("symbol", "unix_millis(ts) div 3600000 AS hour", "open", "high", "low", "close", "volume", "open_bar").collect()
    assert len(got) == len(batch)
    for r in got:
        xs = batch[r.symbol, r.hour]
        assert (r.open, r.high, r.low, r.close, r.volume) == (xs[0], max(xs), min(xs), xs[-1], len(xs))
    # bars whose end the watermark has not passed stay open
    assert min((r.hour for r in got if r.open_bar), default=1 << 40) > max(r.hour for r in got if not r.open_bar)


def plain_marks(rows, cash=10_000.0, cost=0.001):
    """Marks of updates, account by account and time by time."""
    times, held, equity, out = {}, {}, {}, {}
    for account, at, symbol, price, weight in rows:
        if price is not None and price > 0 and at is not None:
            of = times.setdefault((account, at), {})
            of[symbol] = min(of.get(symbol, (price, weight)), (price, weight))
    for account, at in sorted(times, key=lambda k: (str(k[0]), k[1])):
        growth = turnover = 0.0
        for symbol, (price, weight) in times[account, at].items():
            p0, w0 = held.get((account, symbol), (None, 0.0))
            growth += w0 * (price / p0 - 1) if p0 else 0.0
            turnover += abs(weight - w0)
            held[account, symbol] = (price, weight)
        equity[account] = equity.get(account, cash) * max((1 + growth) * (1 - cost * turnover), 0.0)
        out[account, at] = (growth, turnover, equity[account])
    return out


def stream_of(spark, schema, folder):
    return spark.readStream.schema(schema).parquet(str(folder))


def test_accounts_go_on_from_their_state(spark, tmp_path):
    """The same updates at once, and in three runs that each start from the checkpoint, give the plain marks."""
    schema = "account string, at long, symbol string, price double, weight double"
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 10 * t + rng.randrange(3), rng.choice("xyz"), rng.choice([1.0, 2.0, 3.5]), rng.choice([-0.5, 0.0, 0.4, 1.0])) for t in range(60) for _ in range(2)]
    rows += [("c", 1, "x", None, 1.0), ("c", 1, "x", -1.0, 1.0), rows[0], rows[7]]
    rows += [("d", 1, "x", 2.0, 1.0), ("d", 2, "x", 4.0, 2001.0), ("d", 303, "x", 4.0, 0.0)]  # lost for good
    want = plain_marks(rows)
    assert want["d", 303][2] == 0.0
    for k, cuts in enumerate(((0, 10**9), (0, 200, 400, 10**9))):
        folder, path = tmp_path / str(k), str(tmp_path / f"marks{k}")
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = [r for r in rows if lo <= r[1] < hi] + [r for r in rows if r[1] < lo][:5]  # old ones are no news
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
            marks = state.finished(spark, state.accounts(stream_of(spark, schema, folder)), path)
        got = {(r.account, r.at): (r.growth, r.turnover, r.equity) for r in marks.collect()}
        assert got.keys() == want.keys() and marks.count() == len(got)
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_statuses_by_timers(spark, tmp_path):
    """An account without updates goes down the ladder as the others' days pass, also after a restart."""
    schema, path = "account string, ts timestamp", str(tmp_path / "statuses")
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    seen = {}
    for part in ([("a", 0), ("b", 0), ("b", 0)], [("b", 9), ("b", 10)], [("b", 20), ("c", 35), ("b", 3)], [("c", 47), ("b", 100), ("a", 100)]):
        spark.createDataFrame([(a, day(n)) for a, n in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = state.finished(spark, state.watched(stream_of(spark, schema, tmp_path / "in")), path).collect()
        for r in rows:
            seen.setdefault(r.account, set()).add(((r.since - datetime.date(2024, 1, 1)).days, r.status, r.n_updates))
        assert len(rows) == sum(map(len, seen.values()))  # nothing twice
        if part[0] == ("b", 9):
            assert (8, "STALE", 1) in seen["a"] and (30, "CRITICAL", 1) not in seen["a"]
    assert seen["a"] == {(0, "OK", 1), (8, "STALE", 1), (30, "CRITICAL", 1), (46, "BROKEN", 1), (100, "OK", 2)}
    assert {x for x in seen["b"] if x[1] != "OK"} == {(8, "STALE", 1), (18, "STALE", 3), (28, "STALE", 4), (50, "CRITICAL", 4), (66, "BROKEN", 4)}
    assert {x[0] for x in seen["b"] if x[1] == "OK"} == {0, 9, 10, 20, 100} and max(x[2] for x in seen["b"]) == 5
    assert (55, "STALE", 2) in seen["c"] and (93, "BROKEN", 2) in seen["c"]


@needs_tables
def test_streamed_accounts(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("CAST(user_id AS STRING) AS u", "unix_micros(CAST(ts AS TIMESTAMP)) AS at", "event_type", "1 + value AS price", "((event_id % 5) - 2) / 10e0 AS w")
    want = plain_marks([tuple(r) for r in events.collect()])
    got = {(r.account, r.at): r.equity for r in bars.streaming_accounts(spark, SF).collect()}
    assert len(got) == len(want) and all(got[k] == pytest.approx(want[k][2], rel=1e-6) for k in want)


def test_overlay_is_lagged(spark):
    overlay = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-04", 2.0)], "symbol string, day string, value double").withColumn("day", F.to_date("day"))
    ticks = spark.createDataFrame([(1, "2024-01-01 12:00:00", "a", 0.0), (2, "2024-01-02 00:00:00", "a", 0.0), (3, "2024-01-04 23:59:59", "a", 0.0), (4, "2024-01-05 00:00:00", "a", 0.0), (5, "2024-01-05 00:00:00", "b", 0.0)], "event_id long, ts string, symbol string, price double").withColumn("ts", F.to_timestamp("ts"))
    assert {r.event_id: r.overlay for r in bars.lagged_overlay(ticks, overlay).collect()} == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: None}


@needs_tables
def test_studies(spark):
    sql = studies.all_sql()
    run = lambda name: run_query(spark, SF, sql[name]).collect()
    moved = {r.side: r.moved for r in run("f10_causality")}
    assert moved == {"past": 0, "future": 1}
    assert not [r for r in run("k02_windows") if r.b <= r.a]
    statuses = {r.status for r in run("m07_staleness")}
    assert statuses <= {"OK", "STALE", "CRITICAL", "BROKEN", "MISSING"}
