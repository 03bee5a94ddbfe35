"""State labels, crosses and switches over features, and diagnostics of label series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import previous, time_blocks
from tidemark.functions.ranks import in_pieces, trailing_ranks

#: Time of a symbol that is worked through as one block where only the row before matters.
BLOCK_US = 32 * 86_400_000_000


def quantile_regime(df: DataFrame, x: str, cuts: Sequence[float], labels: Sequence[str], min_history: int, window_seconds: int, time: str = "interval_end") -> DataFrame:
    """``state``: how many empirical quantiles of the trailing window, the current value included, lie below the value.

    The k-th smallest of n values with ``k = max(1, ceil(cut * n))`` lies below x exactly if at least k values do, so no
    quantile is computed. The window is left-open; a null value or a history below ``min_history`` has no state.

    A symbol's time is cut into pieces of two windows, each with the window before it. Within a piece the values below the own one are counted by
    a wavelet tree, n log n whatever the window's length.
    """
    width = window_seconds * 1_000_000

    def spans(rows) -> tuple[np.ndarray, np.ndarray]:
        at = rows.column(time).cast(pa.timestamp("us", rows.column(time).type.tz)).cast(pa.int64()).to_numpy()
        return np.searchsorted(at, at - width, "right"), np.searchsorted(at, at, "right")  # equal times count together

    counted = in_pieces(df, lambda rows: trailing_ranks(rows, ["symbol"], [time], x, spans), width, 2 * width, time)
    label = F.lit(labels[0])
    for cut, name in zip(cuts, labels[1:], strict=True):
        label = F.when(F.col("_less") >= F.greatest(F.lit(1), F.ceil(F.lit(cut) * F.col("_n"))), F.lit(name)).otherwise(label)
    state = F.when(F.col(x).isNotNull() & (F.col("_n") >= min_history), label)
    return counted.withColumn("state", state).drop("_size", "_n", "_less", "_equal")


def trend_range(df: DataFrame, x: str, n: int, threshold: float, labels: tuple[str, str, str] = ("down", "range", "up"), time: str = "interval_start") -> DataFrame:
    """``state`` by the efficiency ratio ``|sum| / sum of |x|`` of the last ``n`` values, none of them null."""
    w = Window.partitionBy("symbol").orderBy(time).rowsBetween(-(n - 1), 0)
    b = df.withColumns({"_k": F.count(x).over(w), "_total": F.sum(x).over(w), "_path": F.sum(F.abs(x)).over(w)})
    trend = F.when(F.col("_total") > 0, F.lit(labels[2])).otherwise(F.lit(labels[0]))
    label = F.when(F.col("_path") == 0, F.lit(labels[1])).when(F.abs("_total") / F.col("_path") >= threshold, trend).otherwise(F.lit(labels[1]))
    return b.withColumn("state", F.when(F.col("_k") == n, label)).drop("_k", "_total", "_path")


def volatility_squeeze(short: str, long: str, below: float, above: float) -> Column:
    ratio = F.col(short) / F.when(F.col(long) != 0, F.col(long))
    return F.when(ratio.isNull(), None).when(ratio < below, "squeeze").when(ratio > above, "expansion").otherwise("normal")


def return_shock(x: str, vol: str, k: float) -> Column:
    return F.when(F.col(x).isNull() | F.col(vol).isNull(), None).when(F.col(x) > k * F.col(vol), "up_shock").when(F.col(x) < -k * F.col(vol), "down_shock").otherwise("calm")


def _crossed(df: DataFrame, gap: Column, direction: str, time: str) -> DataFrame:
    """Rows where ``gap`` changes its sign from the symbol's row before; that may lie in the block of time before."""
    b = previous(time_blocks(df.withColumn("_gap", gap), ["symbol"], time, BLOCK_US), {"_before": "_gap"}).rows.drop("_block")
    up, down = (F.col("_before") <= 0) & (F.col("_gap") > 0), (F.col("_before") >= 0) & (F.col("_gap") < 0)
    want = {"up": up, "down": down, "both": up | down}[direction]
    return b.where(want).withColumn("direction", F.when(F.col("_gap") > 0, "up").otherwise("down")).drop("_gap", "_before")


def threshold_cross(df: DataFrame, x: str, level: float, direction: str = "both", time: str = "interval_start") -> DataFrame:
    """Rows whose value crosses the level from the row before; a null breaks the pair."""
    return _crossed(df, F.col(x) - F.lit(level), direction, time)


def relative_cross(df: DataFrame, x: str, level: str, multiplier: float, direction: str = "both", time: str = "interval_start") -> DataFrame:
    """The same against another feature, over the times at which both have a value."""
    both = df.where(F.col(x).isNotNull() & F.col(level).isNotNull())
    return _crossed(both, F.col(x) - multiplier * F.col(level), direction, time)


def breakout(df: DataFrame, x: str, n: int, multiplier: float, time: str = "interval_start") -> DataFrame:
    """Rows above ``multiplier`` times the mean of the ``n`` values before, whose predecessor was not; none of the n + 2 is null."""
    w = Window.partitionBy("symbol").orderBy(time)
    b = df.withColumns({"_k": F.count(x).over(w.rowsBetween(-(n + 1), 0)), "baseline": F.avg(x).over(w.rowsBetween(-n, -1)), "_base0": F.avg(x).over(w.rowsBetween(-(n + 1), -2)), "_x0": F.lag(x).over(w)})
    return b.where((F.col("_k") == n + 2) & (F.col(x) > multiplier * F.col("baseline")) & ~(F.col("_x0") > multiplier * F.col("_base0"))).drop("_k", "_base0", "_x0")


def state_switch(df: DataFrame, state: str = "state", from_state: str | None = None, to_state: str | None = None, time: str = "interval_start") -> DataFrame:
    """Rows whose state differs from that of the row before; a null state breaks the pair."""
    b = previous(time_blocks(df, ["symbol"], time, BLOCK_US), {"from_state": state}).rows.drop("_block")
    b = b.withColumn("to_state", F.col(state)).where("from_state <> to_state")
    if from_state is not None:
        b = b.where(F.col("from_state") == from_state)
    return b if to_state is None else b.where(F.col("to_state") == to_state)


def state_counts(df: DataFrame, state: str = "state", min_run: int = 3, time: str = "interval_start") -> DataFrame:
    """Per state: steps, share, runs, mean and longest run, and runs shorter than ``min_run``. Null states are left out."""
    w = Window.partitionBy("symbol").orderBy(time)
    known = df.where(F.col(state).isNotNull()).withColumn("_new", F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1))
    runs = known.withColumn("_run", F.sum("_new").over(w)).groupBy("symbol", "_run", F.col(state).alias("state")).agg(F.count("*").alias("steps"))
    out = runs.groupBy("state").agg(F.sum("steps").alias("n"), F.count("*").alias("runs"), F.avg("steps").alias("mean_run"), F.max("steps").alias("max_run"), F.count(F.when(F.col("steps") < min_run, 1)).alias("short_runs"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per state


def transitions(df: DataFrame, state: str = "state", time: str = "interval_start") -> DataFrame:
    """Counts and probabilities of each step from one known state to the next."""
    known = df.where(F.col(state).isNotNull()).select("symbol", time, F.col(state).alias("to_state"))
    steps = previous(time_blocks(known, ["symbol"], time, BLOCK_US), {"from_state": "to_state"}).rows.where("from_state is not null")
    counted = steps.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counted.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
