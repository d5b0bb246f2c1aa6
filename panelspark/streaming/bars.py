"""Streaming forms: bars from ticks, and accounts marked forward by their updates.

Both read a folder of Parquet files as a stream. On the same input the results
are those of the batch forms: late rows beyond the watermark are dropped, and a
repeated event or update changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.sources.shared import saved
from panelspark.streaming.state import CASH, COST, accounts, finished, watched

def hourly_bars(ticks: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Bars of ``(event_id, ts, symbol, price)`` ticks in event time; null prices are no ticks.

    A bar is final (append mode) once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    return (
        ticks.where("price IS NOT NULL")
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
        .selectExpr("symbol", "w.start AS ts", "open", "high", "low", "close", "volume")
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream of ticks, with the user of each."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS symbol", "value AS price", "user_id")


#: Weight that an event sets, from its own value.
_WEIGHT = "((event_id % 5) - 2) / 10e0"


def streaming_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is an account that holds kinds of events: an event is a price and sets a weight."""
    updates = event_stream(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS account", "unix_micros(ts) AS at", "symbol", "1 + price AS price", f"{_WEIGHT} AS weight")
    marks = finished(spark, accounts(updates))
    return marks.select("account", "at", *(F.round(c, 6).alias(c) for c in ("growth", "turnover")), F.round("equity", 4).alias("equity"))


ACCOUNTS_SQL = f"""
WITH updates AS (
  SELECT user_id::VARCHAR AS account, event_type AS symbol, epoch_us(ts) AS "at", min(row(1 + value, {_WEIGHT})) AS u
  FROM events WHERE 1 + value > 0 AND ts IS NOT NULL GROUP BY ALL),
moves AS (
  SELECT account, "at", u[1] AS price, u[2] AS weight, lag(u[1]) OVER w AS p0, coalesce(lag(u[2]) OVER w, 0) AS w0
  FROM updates WINDOW w AS (PARTITION BY account, symbol ORDER BY "at")),
bars AS (SELECT account, "at", sum(coalesce(w0 * (price / p0 - 1), 0)) AS growth, sum(abs(weight - w0)) AS turnover FROM moves GROUP BY account, "at"),
paths AS (SELECT account, "at", growth, turnover, list(greatest((1 + growth) * (1 - {COST} * turnover), 0)) OVER (PARTITION BY account ORDER BY "at") AS fs FROM bars)
SELECT account, "at", round(growth, 6) AS growth, round(turnover, 6) AS turnover, round({CASH} * list_product(fs), 4) AS equity FROM paths
"""


def streaming_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each account (a customer) after all days with its orders have come by."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    statuses = finished(spark, watched(orders.selectExpr("CAST(o_custkey AS STRING) AS account", "CAST(o_orderdate AS TIMESTAMP) AS ts")))
    newest = statuses.groupBy("account").agg(F.max_by(F.struct("status", "n_updates"), F.struct("since", F.col("status") == "OK")).alias("s"), F.max("since").alias("since"))
    every = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("account"))
    return every.join(newest, "account", "left").select("account", F.col("since").cast("string").alias("since"), F.coalesce("s.status", F.lit("MISSING")).alias("status"), F.coalesce("s.n_updates", F.lit(0)).alias("n_updates"))


STALENESS_SQL = """
WITH latest AS (SELECT o_custkey AS account, max(o_orderdate::DATE) AS day, count(DISTINCT o_orderdate::DATE) AS n FROM orders GROUP BY o_custkey),
aged AS (SELECT *, date_diff('day', day, (SELECT max(day) FROM latest)) AS age FROM latest)
SELECT c_custkey::VARCHAR AS account, coalesce(n, 0) AS n_updates,
       CASE WHEN age IS NULL THEN 'MISSING' WHEN age > 45 THEN 'BROKEN' WHEN age >= 30 THEN 'CRITICAL' WHEN age >= 8 THEN 'STALE' ELSE 'OK' END AS status,
       (day + CASE WHEN age > 45 THEN 46 WHEN age >= 30 THEN 30 WHEN age >= 8 THEN 8 ELSE 0 END)::DATE::VARCHAR AS since
FROM customer LEFT JOIN aged ON account = c_custkey
"""


def lagged_overlay(ticks: DataFrame, overlay: DataFrame, lag_days: int = 1) -> DataFrame:
    """A stream (or table) of ``(event_id, ts, symbol, price)`` with the newest
    ``value`` of ``overlay`` (``symbol, day, value``) that may be known: a day's
    value counts from ``lag_days`` later on, until the next one does. No value
    yet: null. One overlay row for each symbol and day. The joins are on equal
    days, so a tick meets one row, whatever the overlay's length."""
    usable = F.date_add("day", lag_days)
    by_day = Window.partitionBy("of").orderBy("since")
    spans = overlay.select(F.col("symbol").alias("of"), "value", usable.alias("since")).withColumn("until", F.coalesce(F.lead("since").over(by_day), F.date_add("since", 1)))
    # one row for each day; the newest value holds on from its day
    days = spans.select("of", "value", F.explode(F.sequence("since", F.date_sub("until", 1))).alias("on"))
    newest = overlay.groupBy(F.col("symbol").alias("known")).agg(F.max(usable).alias("newest"))
    ticks = ticks.join(newest, F.col("symbol") == F.col("known"), "left").withColumn("day_of", F.least(F.col("ts").cast("date"), F.col("newest")))
    return ticks.join(days, (F.col("symbol") == F.col("of")) & (F.col("day_of") == F.col("on")), "left").select("event_id", "ts", "symbol", "price", F.col("value").alias("overlay"))


#: Mean value of each kind on every third day.
_DAILY = "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, avg(value) AS value FROM {} WHERE extract(DAY FROM ts) % 3 = 0 GROUP BY event_type, CAST(ts AS DATE)"


def streaming_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as they come, with a daily overlay lagged by a day."""
    overlay = saved(spark.sql(_DAILY.format("{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet")))
    joined = finished(spark, lagged_overlay(event_stream(spark, sf_dir).drop("user_id"), overlay))
    return joined.select("event_id", "symbol", F.round("overlay", 6).alias("overlay"))


OVERLAY_SQL = f"""
SELECT e.event_id, e.event_type AS symbol, round(o.value, 6) AS overlay
FROM events e ASOF LEFT JOIN ({_DAILY.format("events")}) o ON o.symbol = e.event_type AND e.ts >= o.day + INTERVAL 1 DAY
"""


def whole_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's final bars, and from the stored ticks those that the watermark
    has not closed yet (``open_bar``)."""
    final = finished(spark, hourly_bars(event_stream(spark, sf_dir)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS symbol", "value AS price")
    newest = final.agg(F.max("ts").alias("newest"))
    late = events.where("price IS NOT NULL").withColumn("hour", F.date_trunc("hour", "ts")).crossJoin(F.broadcast(newest)).where("newest IS NULL OR hour > newest")
    order = F.struct("ts", "event_id")
    still = late.groupBy("symbol", F.col("hour").alias("ts")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("volume"))
    return final.withColumn("open_bar", F.lit(False)).unionByName(still.withColumn("open_bar", F.lit(True)))


BARS_SQL = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)
"""


def queries() -> dict:
    return {
        "m02_streaming_accounts": streaming_accounts,
        "m07_streaming_staleness": streaming_staleness,
        "m09_streaming_bars": lambda spark, sf_dir: whole_bars(spark, sf_dir).drop("open_bar"),
        "m10_streaming_overlay": streaming_overlay,
    }


def oracle_sql() -> dict[str, str]:
    return {"m02_streaming_accounts": ACCOUNTS_SQL, "m07_streaming_staleness": STALENESS_SQL, "m09_streaming_bars": BARS_SQL, "m10_streaming_overlay": OVERLAY_SQL}
