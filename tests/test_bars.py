"""Bars and grids of small tables with ties, large keys and gaps, against their oracle."""

import datetime as dt

import pytest

from panelspark import registry
from panelspark.sources import panels
from panelspark.sources.panels import oracle, run_query, steps_sql

_LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp"


def line(order, part, supplier, price, day, number=1):
    return order, part, supplier, number, 1.0 + order % 5, 100.0 * price, 0.05, 0.02, "O", dt.datetime(1996, 1, 1) + dt.timedelta(days=day)


def tables(spark, path, lines):
    spark.createDataFrame(lines, _LINES).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, "x") for k in range(1, 4)], "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


def same(spark, path, query):
    """The rows of a query, which are those of its oracle."""
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    got, want = run_query(spark, path, query), db.execute(oracle(query))
    assert got.columns == [c[0] for c in want.description]
    show = lambda rows: sorted(str([f"{x:.9g}" if isinstance(x, (int, float)) else str(x) for x in r]) for r in rows)
    rows = got.collect()
    assert show(rows) == show(want.fetchall())
    return rows


@pytest.mark.parametrize("factor", [1, 10**13])
def test_ties_of_day_order_and_line(spark, tmp_path, factor):
    # orders of the same days with the same line; a larger key is later, whatever its size
    lines = [line(k * factor, part, s, 10 * k + 3 * part - s, day) for k in (1, 2, 30) for part in (3, 1, 2) for s in (2, 1) for day in (0, 1)]
    path = tables(spark, tmp_path / "t", lines)
    bars = same(spark, path, steps_sql("w", [], "SELECT symbol, ts, open, high, low, close, volume FROM bars"))
    assert [(b.open, b.close) for b in bars] == [(5000 + 10 + 3 - 1, 5000 + 300 + 9 - 2)]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_of_gaps(spark, tmp_path):
    # suppliers with a bar at the begin, in the middle, at the end, at all times, and none but a null key; days with gaps
    days = {1: (0,), 2: (5, 6), 3: (20,), 4: (0, 5, 6, 9, 20), None: (6, 9)}
    path = tables(spark, tmp_path / "t", [line(k, 1, s, k + day, day) for s, at in days.items() for k in (1, 2) for day in at])
    rows = same(spark, path, steps_sql("d", [], "SELECT bar_idx, ts, symbol, open, high, low, close, volume, tax, discount, traded FROM grid"))
    assert len(rows) == 5 * len(days) and sum(r.close is not None for r in rows) == 9
    for query in ("a06_funding_prevailing", "a07_overlay_align", "a08_overlay_lag", "b13_fill_and_drop", "d14_delay", "d01_rank"):
        same(spark, path, registry._named()[query])


def test_no_bars(spark, tmp_path):
    path = tables(spark, tmp_path / "t", [line(1, 1, 1, 1, 1)])
    spark.read.parquet(f"{path}/lineitem.parquet").where("false").write.parquet(f"{tmp_path}/n/lineitem.parquet")
    assert run_query(spark, f"{tmp_path}/n", steps_sql("d", [], "SELECT bar_idx, symbol, close FROM grid")).count() == 0


def test_empty_cells_are_not_shuffled(spark, tmp_path):
    path = tables(spark, tmp_path / "t", [line(k, 1, k % 3, k, k) for k in range(9)])
    for query, sorts in (("d14_delay", 2), ("a08_overlay_lag", 2), ("a06_funding_prevailing", 2), ("b13_fill_and_drop", 2)):
        plan = planned(run_query(spark, path, registry._named()[query]))
        # one exchange, of the bars, and one sort of the cells; before, cells were joined and dealt again
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and plan.count("Sort [") == sorts, query


def test_ticks_are_dealt_once_and_by_their_number(spark, tmp_path, monkeypatch):
    path = tables(spark, tmp_path / "t", [line(k, 1, k % 3, k, k) for k in range(90)])
    monkeypatch.setattr(panels, "SHARE", 3)
    parts = max(30, spark.sparkContext.defaultParallelism)
    for query in ("a07_overlay_align", "a06_funding_prevailing"):
        rows = same(spark, path, registry._named()[query])
        plan = planned(run_query(spark, path, registry._named()[query]))
        # before, bars with all their columns were shuffled and written, and then dealt again; parts did not follow the ticks
        assert "SortAggregate" not in plan and "l_orderkey" not in plan and f", {parts}), REPARTITION_BY_NUM" in plan and rows
