"""Landed JSON pages to typed rows, and bar files that are checked on both ways.

A page is ``(symbol, page, body)``. Pages may overlap; of rows with the same
symbol and time the first stays: that of the lowest page, then of the lowest
place in it. A null, empty or malformed body has no rows; a row without a time
is left out, a value that is no number is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.panels import steps_sql
from panelspark.sources.shared import new_path

BAR = ("open", "high", "low", "close", "volume")


def _first(pages: DataFrame, schema: str, time: Column, values: dict[str, Column]) -> DataFrame:
    """One row for each symbol and time, from the JSON arrays in ``body``; columns are made from each element ``e``."""
    rows = pages.select("symbol", "page", F.posexplode(F.from_json("body", schema)).alias("at", "e")).select("symbol", "page", "at", time.try_cast("long").alias("millis"), F.struct(*(v.try_cast("double").alias(n) for n, v in values.items())).alias("v"))
    kept = rows.where("millis IS NOT NULL").groupBy("symbol", "millis").agg(F.min_by("v", F.struct("page", "at")).alias("v"))
    return kept.select("symbol", "millis", "v.*")


def klines(pages: DataFrame) -> DataFrame:
    """``symbol, millis, open, high, low, close, volume`` of ``[time, open, high, low, close, volume, ...]`` arrays."""
    return _first(pages, "array<array<string>>", F.get("e", F.lit(0)), {n: F.get("e", F.lit(i)) for i, n in enumerate(BAR, 1)})


def funding(pages: DataFrame) -> DataFrame:
    """``symbol, millis, rate`` of ``{fundingTime, fundingRate}`` objects."""
    return _first(pages, "array<struct<fundingTime:string,fundingRate:string>>", F.col("e.fundingTime"), {"rate": F.col("e.fundingRate")})


def _seconds(time: Column) -> Column:
    return time.try_cast("long") * 1000


def locked_value(pages: DataFrame) -> DataFrame:
    """``symbol, millis, tvl`` of ``{date, totalLiquidityUSD}`` objects; ``date`` is in seconds."""
    return _first(pages, "array<struct<date:string,totalLiquidityUSD:string>>", _seconds(F.col("e.date")), {"tvl": F.col("e.totalLiquidityUSD")})


def fees(pages: DataFrame) -> DataFrame:
    """``symbol, millis, fees`` of ``[seconds, value]`` pairs."""
    return _first(pages, "array<array<string>>", _seconds(F.get("e", F.lit(0))), {"fees": F.get("e", F.lit(1))})


def supply(pages: DataFrame) -> DataFrame:
    """``symbol, millis, supply`` of ``{date, totalCirculating: {peggedUSD}}`` objects; 0 where there is none."""
    schema = "array<struct<date:string,totalCirculating:struct<peggedUSD:string>>>"
    return _first(pages, schema, _seconds(F.col("e.date")), {"supply": F.coalesce(F.col("e.totalCirculating.peggedUSD"), F.lit("0"))})


def check_bars(bars: DataFrame, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """``bars`` in the order of the bar columns; an error if a column lacks, there are no rows, or a key repeats."""
    lacking = [c for c in (*key, *BAR) if c not in bars.columns]
    if lacking:
        raise ValueError(f"columns lack: {lacking}")
    if bars.isEmpty():
        raise ValueError("no bars")
    if not bars.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated {key}")
    return bars.select(*key, *BAR)


def write_bars(bars: DataFrame, path: str, key: tuple[str, ...] = ("symbol", "ts")) -> None:
    check_bars(bars, key).write.parquet(path)


def read_bars(spark: SparkSession, path: str, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return check_bars(spark.read.parquet(path), key)


def write_series(rows: DataFrame, path: str, value: str, key: tuple[str, ...] = ("symbol", "ts")) -> None:
    """A funding or overlay file: one ``value`` for each key."""
    check_series(rows, value, key).write.parquet(path)


def read_series(spark: SparkSession, path: str, value: str, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """What :func:`write_series` has written; no file at ``path`` is Spark's PATH_NOT_FOUND error."""
    return check_series(spark.read.parquet(path), value, key)


def check_series(rows: DataFrame, value: str, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """``key`` and ``value``; an error if a column lacks or a key repeats. No rows are no error."""
    lacking = [c for c in (*key, value) if c not in rows.columns]
    if lacking:
        raise ValueError(f"columns lack: {lacking}")
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated {key}")
    return rows.select(*key, value)


def stack_files(spark: SparkSession, path: str) -> DataFrame:
    """The bar files ``symbol.parquet`` in a folder as one panel, in one read; ``symbol`` is the file's name."""
    bars = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet(?:/[^/]*)?$", 1)
    return bars.withColumn("symbol", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


_ROWS = "SELECT symbol, MILLIS[ts] AS millis, {} FROM bars WHERE close IS NOT NULL"
_BARS = _ROWS.format(", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in BAR))
_TVL = _ROWS.format("CAST(traded AS DOUBLE) AS tvl")
_RATES = _ROWS.format("CAST(discount AS DOUBLE) AS rate")


def _landed(spark: SparkSession, sf_dir: str, sql: str, element: Column) -> DataFrame:
    """The weekly panel as pages by symbol and year, each landed twice."""
    rows = steps_sql("w", [], sql).run(spark, sf_dir)
    pages = rows.groupBy("symbol", F.year(F.timestamp_millis("millis")).alias("year")).agg(F.to_json(F.collect_list(element)).alias("body"))
    return pages.select("symbol", "body", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("page"))


def _klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return klines(_landed(spark, sf_dir, _BARS, F.array(*(F.col(c).cast("string") for c in ("millis", *BAR)))))


def _funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funding(_landed(spark, sf_dir, _RATES, F.struct(F.col("millis").alias("fundingTime"), F.col("rate").cast("string").alias("fundingRate"))))


def _locked_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locked_value(_landed(spark, sf_dir, _TVL, F.struct(F.expr("millis div 1000").alias("date"), F.col("tvl").cast("string").alias("totalLiquidityUSD"))))


def _fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fees(_landed(spark, sf_dir, _FEES, F.array(F.expr("millis div 1000").cast("string"), F.col("fees").cast("string"))))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    minted = F.struct(F.col("supply").cast("string").alias("peggedUSD"))
    return supply(_landed(spark, sf_dir, _SUPPLY, F.struct(F.expr("millis div 1000").alias("date"), minted.alias("totalCirculating"))))


def _bar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly bars by way of a checked file."""
    path = new_path(spark, "bars")
    write_bars(steps_sql("w", [], _FILE).run(spark, sf_dir), path)
    return read_bars(spark, path)


def _series_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding and overlay by way of checked files, side by side."""
    paths = {}
    for value, sql in _SERIES.items():
        paths[value] = new_path(spark, value)
        write_series(steps_sql("w", [], sql).run(spark, sf_dir), paths[value], value)
    rate, tvl = (read_series(spark, paths[v], v) for v in _SERIES)
    return rate.join(tvl, ["symbol", "ts"], "left")


_FEES = _ROWS.format("CAST(round(traded * tax, 9) AS DOUBLE) AS fees")
_SUPPLY = _ROWS.format("CAST(volume AS DOUBLE) AS supply")
_FILE = "SELECT symbol, ts, open, high, low, close, volume FROM bars"
_SERIES = {"rate": "SELECT symbol, ts, round((discount - 0.05) / 100, 10) AS rate FROM bars", "tvl": "SELECT symbol, ts, round(traded, 2) AS tvl FROM bars WHERE volume > 25"}


def queries() -> dict:
    return {"a01_bar_files": _bar_files, "a02_series_files": _series_files, "a15_klines": _klines, "a16_funding": _funding, "a17_locked_value": _locked_value, "a17_fees": _fees, "a17_supply": _supply}


def oracle_sql() -> dict[str, str]:
    said = {"a01_bar_files": _FILE, "a15_klines": _BARS, "a16_funding": _RATES, "a17_locked_value": _TVL, "a17_fees": _FEES, "a17_supply": _SUPPLY}
    said["a02_series_files"] = f"SELECT symbol, ts, rate, tvl FROM ({_SERIES['rate']}) r LEFT JOIN ({_SERIES['tvl']}) t USING (symbol, ts)"
    return {name: steps_sql("w", [], sql).duckdb() for name, sql in said.items()}
