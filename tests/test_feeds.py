"""Landed pages and checked bar files."""

import datetime
import pytest
from pyspark.errors import AnalysisException

from panelspark.sources import feeds, store


def test_pages(spark):
    bodies = [("A", 1, '[["5","9","9","9","9","9"]]'), ("A", 0, '[["5","1","2","0.5","x","10","more"],["5","7","7","7","7","7"],[null,"1"],["6"]]'), ("B", 0, None), ("B", 1, ""), ("B", 2, "{oops")]
    got = {(r.symbol, r.millis): tuple(r)[2:] for r in feeds.klines(spark.createDataFrame(bodies, "symbol string, page int, body string")).collect()}
    assert got == {("A", 5): (1.0, 2.0, 0.5, None, 10.0), ("A", 6): (None,) * 5}
    rates = [("A", 0, '[{"fundingTime":3,"fundingRate":"0.01"},{"fundingTime":3,"fundingRate":"0.5"},{"fundingRate":"1"}]')]
    assert [tuple(r) for r in feeds.funding(spark.createDataFrame(rates, "symbol string, page int, body string")).collect()] == [("A", 3, 0.01)]


def test_overlays(spark):
    page = lambda body: spark.createDataFrame([("A", 0, body)], "symbol string, page int, body string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(feeds.locked_value(page('[{"date":5,"totalLiquidityUSD":2.5},{"date":"6","totalLiquidityUSD":1}]'))) == [("A", 5000, 2.5), ("A", 6000, 1.0)]
    assert rows(feeds.fees(page("[[5,2.5],[5,9],[7,3]]"))) == [("A", 5000, 2.5), ("A", 7000, 3.0)]
    assert rows(feeds.supply(page('[{"date":5,"totalCirculating":{"peggedUSD":4}},{"date":6,"totalCirculating":{}},{"date":7}]'))) == [("A", 5000, 4.0), ("A", 6000, 0.0), ("A", 7000, 0.0)]


def test_stacked_files(spark, tmp_path):
    for name, close in (("A", 1.0), ("B C+", 2.0)):
        spark.createDataFrame([(1, close)], "ts int, close double").coalesce(1).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    assert sorted(map(tuple, feeds.stack_files(spark, str(tmp_path)).select("symbol", "close").collect())) == [("A", 1.0), ("B C+", 2.0)]


def test_bar_files(spark, tmp_path):
    bars = spark.createDataFrame([(1, "A", 1.0, 1.0, 1.0, 1.0, 5.0), (2, "A", 1.0, 1.0, 1.0, 1.0, 5.0)], "ts int, symbol string, open double, high double, low double, close double, volume double")
    feeds.write_bars(bars, f"{tmp_path}/bars")
    assert sorted(map(tuple, feeds.read_bars(spark, f"{tmp_path}/bars").collect())) == [("A", 1, 1.0, 1.0, 1.0, 1.0, 5.0), ("A", 2, 1.0, 1.0, 1.0, 1.0, 5.0)]
    for bad in (bars.unionAll(bars), bars.limit(0), bars.drop("low")):
        with pytest.raises(ValueError):
            feeds.check_bars(bad)


def test_series_files(spark, tmp_path):
    rates = spark.createDataFrame([("A", 1, 0.1, "x"), ("A", 2, None, "y")], "symbol string, ts int, rate double, note string")
    feeds.write_series(rates, f"{tmp_path}/rates", "rate")
    assert sorted(map(tuple, feeds.read_series(spark, f"{tmp_path}/rates", "rate").collect())) == [("A", 1, 0.1), ("A", 2, None)]
    assert feeds.check_series(rates.limit(0), "rate").count() == 0
    for bad, value in ((rates.unionAll(rates), "rate"), (rates, "tvl")):
        with pytest.raises(ValueError):
            feeds.check_series(bad, value)
    with pytest.raises(AnalysisException):
        feeds.read_series(spark, f"{tmp_path}/nothing", "rate")


def test_bar_store(spark, tmp_path):
    """Overlapping deliveries add only new bars, the first of several; windows by symbol need no exchange."""
    schema = "symbol string, ts timestamp, close double, source int"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    first = [(s, day(t), 10.0 * t, 2) for s in "abc" for t in range(6)] + [("a", day(0), -1.0, 1), (None, day(1), 1.0, 1), ("b", None, 1.0, 1)]
    assert store.add_bars(spark.createDataFrame(first, schema), "test_bars", ["source"], 4, str(tmp_path / "bars")) == 18
    again = spark.createDataFrame([(s, day(t), 99.0, 1) for s in "bcd" for t in range(4, 8)], schema)
    assert store.add_bars(again, "test_bars", ["source"]) == 8 and store.add_bars(again, "test_bars", ["source"]) == 0
    bars = {(r.symbol, r.ts.day): r.close for r in spark.table("test_bars").collect()}
    assert len(bars) == 26 and bars["a", 1] == -1.0 and bars["b", 5] == 40.0 and bars["b", 7] == 99.0
    stored = spark.sql("SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM test_bars")
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE test_bars")
