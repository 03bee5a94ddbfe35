"""Bars from trades: time bars, resampled bars, volume bars, and gaps between them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import greedy_walk, in_blocks, previous, running_sum


def _bucket_start(time: Column, minutes: int) -> Column:
    width = minutes * 60_000_000
    return F.timestamp_micros((F.floor(F.unix_micros(time) / F.lit(width)) * width).cast("long"))


def time_bars(trades: DataFrame, minutes: int) -> DataFrame:
    """Epoch-aligned bars per symbol: first and last price by ``(event_time, venue_trade_id)``, extremes, exact sums.

    A bar is available when it has ended and its last trade is available. Empty intervals give no bar. One aggregation with
    partial results; a busy symbol costs one row per bar and task.
    """
    order = F.struct("event_time", "venue_trade_id")
    grouped = trades.groupBy("symbol", _bucket_start(F.col("event_time"), minutes).alias("interval_start")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").cast("decimal(38,18)").alias("volume"), F.sum(F.col("price").cast("double") * F.col("quantity").cast("double")).alias("quote_volume"),
        F.coalesce(F.sum(F.when(F.col("is_taker_buy"), F.col("quantity"))), F.lit(0)).cast("decimal(38,18)").alias("taker_buy_base_volume"),
        F.count("*").alias("trade_count"), F.max("available_time").alias("last_available"),
    )
    end = F.col("interval_start") + F.expr(f"interval {minutes} minutes")
    return grouped.withColumn("interval_end", end).withColumn("available_time", F.greatest("interval_end", "last_available")).drop("last_available")


def resample(bars: DataFrame, minutes: int, base_minutes: int = 1) -> DataFrame:
    """Coarser bars from bars; ``complete`` only where every base interval is present. Nothing is filled in.

    ``minutes`` must divide a day and be a multiple of ``base_minutes``. Also lists the base intervals used, in order.
    """
    if 1440 % minutes or minutes % base_minutes:
        raise ValueError("the interval must divide a day and be a multiple of the base interval")
    order = F.col("interval_start")
    grouped = bars.groupBy("symbol", _bucket_start(order, minutes).alias("bucket")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.sum("volume").cast("decimal(38,18)").alias("volume"), F.sum("quote_volume").alias("quote_volume"), F.sum("trade_count").alias("trade_count"),
        F.count("*").alias("n_base"), F.max("available_time").alias("last_available"), F.array_sort(F.collect_list(order)).alias("constituents"),
    )
    end = F.col("bucket") + F.expr(f"interval {minutes} minutes")
    return grouped.select(
        "symbol", F.col("bucket").alias("interval_start"), end.alias("interval_end"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count",
        F.greatest(end, "last_available").alias("available_time"), "n_base", (F.col("n_base") == minutes // base_minutes).alias("complete"), "constituents",
    )


def volume_bars(trades: DataFrame, threshold: Decimal | float | str, partitions: int | None = None) -> DataFrame:
    """Bars that close at the first trade with which the quantity since the last close reaches ``threshold``.

    ``symbol, bar_no, first_time, last_time, available_time, open, high, low, close, volume, trade_count``. The closing trade
    belongs whole to its bar, and the bar is available with it; a tail below the threshold gives no bar. Volume runs on over
    midnight. Quantities are summed exactly. Refused are a threshold that is not positive and finite, quantities that are not
    positive, and trade ids that repeat or fall along a symbol's time.

    The next close of each trade follows from exact prefix sums; closes are walked block by block (``greedy_walk``), so a busy
    symbol is many tasks. ``partitions``: ranges to cut the trades into, by default as ``in_blocks`` does.
    """
    step = Decimal(str(threshold))
    if not step.is_finite() or step <= 0:
        raise ValueError("the threshold must be positive and finite")
    by, order = ["symbol"], ["event_time", "venue_trade_id"]
    slim = trades.select(*by, *order, "available_time", F.col("price").cast("decimal(38,18)").alias("price"), F.col("quantity").cast("decimal(38,18)").alias("quantity"))
    blocks = previous(in_blocks(slim, by, order, partitions), {"_id0": "venue_trade_id"})
    fine = F.coalesce((F.col("quantity") > 0) & (F.col("_id0").isNull() | (F.col("venue_trade_id") > F.col("_id0"))), F.lit(False))
    if blocks.rows.where(~fine).limit(1).count():
        raise ValueError("trade ids repeat or fall, or a quantity is not positive")
    sums = running_sum(blocks.but(blocks.rows.drop("_id0")), "quantity", "total")
    walked = greedy_walk(sums, "total", step, Decimal(0)).rows
    at = F.struct(*order)
    bars = walked.groupBy("symbol", F.col("walk").cast("int").alias("bar_no")).agg(
        F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.max_by("available_time", at).alias("available_time"), F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").cast("decimal(38,18)").alias("volume"), F.count("*").cast("int").alias("trade_count"), F.bool_or("kept").alias("closed"),
    )
    return bars.where("closed").drop("closed")


def missing_intervals(bars: DataFrame, minutes: int) -> DataFrame:
    """Maximal runs of intervals without a bar, per symbol and day: ``symbol, day, gap_start, gap_end, n_missing``.

    Every day on which the symbol has a bar is checked from midnight to midnight. Gaps follow from the step to the next bar
    of the day, so no empty interval is ever made a row.
    """
    width = F.expr(f"interval {minutes} minutes")
    day = F.date_trunc("day", "interval_start")
    w = Window.partitionBy("symbol", "day").orderBy("interval_start")
    rows = bars.select("symbol", day.alias("day"), "interval_start", (F.col("interval_start") + width).alias("end")).distinct()
    edges = rows.withColumn("next", F.coalesce(F.lead("interval_start").over(w), F.col("day") + F.expr("interval 1 day"))).withColumn("first", F.row_number().over(w) == 1)
    after = edges.where("next > end").select("symbol", "day", F.col("end").alias("gap_start"), F.col("next").alias("gap_end"))
    before = edges.where("first and interval_start > day").select("symbol", "day", F.col("day").alias("gap_start"), F.col("interval_start").alias("gap_end"))
    size = ((F.unix_micros("gap_end") - F.unix_micros("gap_start")) / F.lit(minutes * 60_000_000)).cast("long")
    return before.union(after).withColumn("n_missing", size)


def id_jumps(trades: DataFrame, key: str = "symbol", trade_id: str = "venue_trade_id") -> DataFrame:
    """Steps of more than one between neighbouring distinct trade ids: ``key, after_id, next_id, n_skipped``."""
    w = Window.partitionBy(key).orderBy(trade_id)
    steps = trades.select(key, trade_id).distinct().withColumn("next_id", F.lead(trade_id).over(w))
    return steps.where(F.col("next_id") != F.col(trade_id) + 1).select(key, F.col(trade_id).alias("after_id"), "next_id", (F.col("next_id") - F.col(trade_id) - 1).alias("n_skipped"))
