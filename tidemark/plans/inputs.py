"""The views that map the given tables onto trades, bars and events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import time_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("venue_trade_id"), F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr("interval 1 second")).alias("available_time"), F.col("value").cast("decimal(38,18)").alias("price"),
        (F.get_json_object("props", "$.k").cast("decimal(20,0)") + 1).cast("decimal(38,18)").alias("quantity"), (F.col("user_id") % 2 == 0).alias("is_taker_buy"),
    )


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    return time_bars(trades(spark, sf_dir), minutes)


def points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Point events of one type: ``key, event_id, event_time``."""
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "event_id", F.col("ts").alias("event_time"), "value")


def r(column, digits: int = 6):
    """A double rounded for comparison."""
    return F.round(column.cast("double"), digits)


TRADES_SQL = """trades AS (
    SELECT event_type AS symbol, event_id AS venue_trade_id, ts AS event_time, ts + INTERVAL 1 SECOND AS available_time, value AS price,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity, user_id % 2 = 0 AS is_taker_buy
    FROM events)"""


def bars_sql(minutes: int = 60) -> str:
    return f"""{TRADES_SQL}, bars0 AS (
    SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, event_time, TIMESTAMP '1970-01-01') AS interval_start,
           arg_min(price, event_time) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_time) AS close,
           sum(quantity) AS volume, sum(price * quantity) AS quote_volume, coalesce(sum(CASE WHEN is_taker_buy THEN quantity END), 0) AS taker_buy_base_volume,
           count(*) AS trade_count, max(available_time) AS last_available
    FROM trades GROUP BY 1, 2
), bars AS (
    SELECT *, interval_start + INTERVAL {minutes} MINUTE AS interval_end, greatest(interval_start + INTERVAL {minutes} MINUTE, last_available) AS available_time FROM bars0
)"""


def runs_sql(minutes: int = 60) -> str:
    """``bars`` with ``run_id`` and ``log_return`` as ``b``."""
    return f"""{bars_sql(minutes)}, runs0 AS (
    SELECT *, CASE WHEN interval_start = lag(interval_end) OVER (PARTITION BY symbol ORDER BY interval_start) THEN 0 ELSE 1 END AS fresh FROM bars
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY interval_start) AS run_id FROM runs0),
b AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, run_id ORDER BY interval_start)) AS log_return FROM runs)"""


def frame(n: int) -> str:
    return f"(PARTITION BY symbol, run_id ORDER BY interval_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "(PARTITION BY symbol, run_id ORDER BY interval_start)"


def full_sql(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END"
