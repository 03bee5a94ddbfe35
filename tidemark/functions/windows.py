"""Shared window helpers: contiguous runs, full trailing frames, as-of matches, islands, bucketed range joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(bars: DataFrame, by: Sequence[str] = ("symbol",), start: str = "interval_start", end: str = "interval_end", name: str = "run_id") -> DataFrame:
    """Number the maximal runs of rows in which each row starts where the one before ends."""
    w = Window.partitionBy(*by).orderBy(start)
    broken = F.when(F.col(start) == F.lag(end).over(w), 0).otherwise(1)
    return bars.withColumn("_new", broken).withColumn(name, F.sum("_new").over(w)).drop("_new")


def run_window(by: Sequence[str] = ("symbol",), order: str = "interval_start"):
    return Window.partitionBy(*by, "run_id").orderBy(order)


def full(value: Column, over, n: int, agg: Callable[[Column], Column]) -> Column:
    """``agg(value)`` over the last ``n`` rows, or null unless all of them are there and not null."""
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, max_age_seconds: float | None = None, inclusive: bool = True) -> DataFrame:
    """``left`` with ``<value>`` and ``matched_time`` of the latest ``right`` row at or before its time.

    One sort by key and time over the union of both sides. The right row travels as a struct, so that a value of null is
    kept and not skipped; ``inclusive=False`` takes rows strictly before. Matches older than ``max_age_seconds`` are null.
    Right rows of one key and time: any of them may win, so make them distinct first.
    """
    keys = list(by)
    packed = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 if inclusive else 0).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(_right_type(right, right_time, value)).alias("_right"))
    other = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0 if inclusive else 1).alias("_side"), F.lit(None).cast(packed.schema["_left"].dataType).alias("_left"), F.struct(F.col(right_time).alias("at"), F.col(value).alias("value")).alias("_right"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = packed.unionByName(other).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    found = F.col("_last")
    if max_age_seconds is not None:
        found = F.when(F.unix_micros("_t") - F.unix_micros(F.col("_last.at")) <= int(max_age_seconds * 1_000_000), F.col("_last"))
    both = both.withColumn("_found", found)
    return both.select("_left.*", F.col("_found.at").alias("matched_time"), F.col("_found.value").alias(value))


def _right_type(right: DataFrame, time: str, value: str):
    return right.select(F.struct(F.col(time).alias("at"), F.col(value).alias("value")).alias("r")).schema["r"].dataType


def islands(spans: DataFrame, by: Sequence[str], start: str, end: str, touching: bool = True) -> DataFrame:
    """Merge spans of a key that overlap (or touch): ``by, start, end, n_spans``."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(end).over(w)
    apart = before.isNull() | (F.col(start) > before if touching else F.col(start) >= before)
    # the running sum takes ties together: which of two equal spans opened the island must not matter
    numbered = spans.withColumn("_apart", apart.cast("int")).withColumn("_island", F.sum("_apart").over(Window.partitionBy(*by).orderBy(start, end)))
    return numbered.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans")).drop("_island")


def bucket(time: Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(time) / F.lit(width_us)).cast("long")


def near_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, back_us: int, ahead_us: int) -> DataFrame:
    """Pairs of one key with ``-back <= right - left <= ahead``: an equi-join on time buckets, not a nested loop.

    Left rows are repeated for the few buckets that their range meets; column names of the two sides must differ but for
    ``by``. The bucket is as wide as the range, so at most two or three copies are made.
    """
    width = max(1, back_us + ahead_us)
    t = F.unix_micros(left_time)
    first, last = F.floor((t - back_us) / F.lit(width)).cast("long"), F.floor((t + ahead_us) / F.lit(width)).cast("long")
    spread = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    dealt = right.withColumn("_bucket", bucket(F.col(right_time), width))
    gap = F.unix_micros(right_time) - F.unix_micros(left_time)
    return spread.join(dealt, [*by, "_bucket"]).where((gap >= -back_us) & (gap <= ahead_us)).drop("_bucket")
