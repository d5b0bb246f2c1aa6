"""Bars in a table that is bucketed by symbol and sorted by time.

Windows along a symbol, and joins of two stores on symbol, read the buckets as
they lie: no exchange. Files are added as they come; a bar that is there stays
as it is, and of several new ones the first by the given order is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.sources.panels import PanelQuery, oracle, steps_sql
from panelspark.sources.shared import new_path

BUCKETS = 8


def add_bars(bars: DataFrame, name: str, first_by: list[str], buckets: int = BUCKETS, path: str | None = None) -> int:
    """Add the bars of ``bars`` (``symbol, ts`` and others) that the table ``name`` does not
    have yet, and say how many. Of rows of one symbol and time the first by the
    columns ``first_by`` is the bar; rows without symbol or time are none. The
    first call makes the table, in ``buckets`` and at ``path`` (or a new one in the
    shared folder)."""
    spark = bars.sparkSession
    new = bars.where("symbol IS NOT NULL AND ts IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*first_by))
    new = new.select("*", place.alias("place_of_bar")).where("place_of_bar = 1").drop("place_of_bar")
    there = spark.catalog.tableExists(name)
    if there:
        buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
        new = new.join(spark.table(name).select("symbol", "ts"), ["symbol", "ts"], "left_anti").select(spark.table(name).columns)
    before = spark.table(name).count() if there else 0
    # one file for each bucket
    out = new.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol", "ts").format("parquet")
    if there:
        out.mode("append").saveAsTable(name)
    else:
        out.option("path", path or new_path(spark, "bars")).saveAsTable(name)
    return spark.table(name).count() - before


def _landed() -> PanelQuery:
    return steps_sql("d", [("landed", "SELECT symbol, ts, open, close, volume, 1 AS version FROM bars WHERE ts < DATE '1996-01-01' UNION ALL SELECT symbol, ts, open, close + 1 AS close, volume, 2 AS version FROM bars WHERE ts >= DATE '1995-06-01'")], "SELECT * FROM landed")


_RESULT = "SELECT symbol, ts, version, round(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 8) AS r, round(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_volume FROM {}"


def bar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of bars that overlap, and windows over what is stored."""
    landed, name = _landed().run(spark, sf_dir), "bars_" + new_path(spark).rsplit("-", 1)[1]
    for version in (1, 2):
        add_bars(landed.where(f"version = {version}"), name, ["version"])
    return spark.sql(_RESULT.format(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"a01_bar_store": bar_store}


def oracle_sql() -> dict[str, str]:
    kept = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY version) AS k FROM landed) n WHERE k = 1) stored"
    return {"a01_bar_store": oracle(PanelQuery(_landed().steps, _RESULT.format(kept)))}
