"""Bar features. Each is a column over bars with ``run_id``; windows never reach over a gap.

Not computable is null: a window that is short, broken by a gap or holds a null, and any zero denominator.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import Blocks, Smoothing, in_blocks, previous, smooth
from tidemark.functions.ranks import in_pieces, trailing_ranks
from tidemark.functions.windows import full, nonzero, run_window, with_runs


#: Bar intervals of a symbol that are worked through as one piece.
PIECE = 4096


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def floored(x: Column) -> Column:
    """At least 0; null stays null (greatest would skip it)."""
    return F.when(x < 0, 0.0).otherwise(x)


def _w():
    return run_window()


def log_ratio(x: Column, y: Column) -> Column:
    """``ln(x / y)``, null where it is not computable: a price of zero has no logarithm on either side."""
    return F.log(x / nonzero(y))


def float_log_ratio(x: Column, y: Column) -> Column:
    """``ln(x / y)`` by floating-point arithmetic, as SQL over doubles has it: infinite where one price is zero, NaN where both are or signs differ."""
    ratio = F.when(y == 0, x * math.inf).otherwise(x / nonzero(y))
    return F.when(ratio > 0, F.log(ratio)).when(ratio == 0, -math.inf).when(ratio < 0, math.nan)


def log_return() -> Column:
    return log_ratio(_d("close"), F.lag(_d("close")).over(_w()))


def realized_volatility(n: int, r: str = "log_return") -> Column:
    return F.sqrt(full(F.col(r) * F.col(r), _w(), n, F.sum))


def volume_sum(n: int) -> Column:
    return full(F.col("volume"), _w(), n, F.sum)


def bollinger_percent_b(n: int, k: float) -> Column:
    mean, sd = full(_d("close"), _w(), n, F.avg), full(_d("close"), _w(), n, F.stddev_pop)
    return (_d("close") - (mean - k * sd)) / nonzero(2 * k * sd)


def bollinger_bandwidth(n: int, k: float) -> Column:
    mean, sd = full(_d("close"), _w(), n, F.avg), full(_d("close"), _w(), n, F.stddev_pop)
    return 2 * k * sd / nonzero(mean)


def vwap(n: int) -> Column:
    typical = (_d("high") + _d("low") + _d("close")) / 3
    return full(typical * _d("volume"), _w(), n, F.sum) / nonzero(full(_d("volume"), _w(), n, F.sum))


def parkinson_volatility(n: int, ln: Callable[[Column, Column], Column] = log_ratio) -> Column:
    """``ln`` tells what the logarithm of a price of zero is: null, or as ``float_log_ratio`` has it."""
    return F.sqrt(full(F.pow(ln(_d("high"), _d("low")), 2.0) / (4 * math.log(2)), _w(), n, F.avg))


def garman_klass_volatility(n: int, ln: Callable[[Column, Column], Column] = log_ratio) -> Column:
    """``ln`` as in ``parkinson_volatility``."""
    one = 0.5 * F.pow(ln(_d("high"), _d("low")), 2.0) - (2 * math.log(2) - 1) * F.pow(ln(_d("close"), _d("open")), 2.0)
    return F.sqrt(floored(full(one, _w(), n, F.avg)))


def yang_zhang_volatility(n: int) -> Column:
    """Over ``n`` bars and the close before them; n >= 2."""
    overnight, inside = log_ratio(_d("open"), F.lag(_d("close")).over(_w())), log_ratio(_d("close"), _d("open"))
    rs = log_ratio(_d("high"), _d("close")) * log_ratio(_d("high"), _d("open")) + log_ratio(_d("low"), _d("close")) * log_ratio(_d("low"), _d("open"))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    return F.struct(overnight.alias("overnight"), inside.alias("inside"), rs.alias("rs")), k


def amihud_illiquidity(n: int, r: str = "log_return") -> Column:
    quote = _d("quote_volume")
    return full(F.when(quote > 0, F.abs(F.col(r)) / quote), _w(), n, F.avg)


def taker_flow_imbalance(n: int) -> Column:
    return 2 * full(_d("taker_buy_base_volume"), _w(), n, F.sum) / nonzero(full(_d("volume"), _w(), n, F.sum)) - 1


def true_range() -> Column:
    before = F.lag(_d("close")).over(_w())
    return F.greatest(_d("high") - _d("low"), F.abs(_d("high") - before), F.abs(_d("low") - before)) + before * 0


def with_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``run_id`` and ``log_return``: the input of the other features."""
    return with_runs(bars).withColumn("log_return", log_return())


def add_yang_zhang(bars: DataFrame, n: int, name: str = "yang_zhang") -> DataFrame:
    parts, k = yang_zhang_volatility(n)
    w = _w()
    b = bars.withColumn("_yz", parts).withColumns({f"_{c}": F.col(f"_yz.{c}") for c in ("overnight", "inside", "rs")})
    value = F.sqrt(floored(full(F.col("_overnight"), w, n, F.var_samp) + k * full(F.col("_inside"), w, n, F.var_samp) + (1 - k) * full(F.col("_rs"), w, n, F.avg)))
    return b.withColumn(name, value).drop("_yz", "_overnight", "_inside", "_rs")


def add_jump_variance(bars: DataFrame, n: int, name: str = "jump_variance") -> DataFrame:
    """``max(RV - pi/2 * sum |r_t| |r_t-1|, 0)`` over ``n`` returns, whose products are one fewer."""
    w, r = _w(), F.col("log_return")
    b = bars.withColumn("_bp", F.abs(r) * F.abs(F.lag(r).over(w)))
    return b.withColumn(name, floored(full(r * r, w, n, F.sum) - math.pi / 2 * full(F.col("_bp"), w, n - 1, F.sum))).drop("_bp")


def add_corwin_schultz(bars: DataFrame, n: int, name: str = "corwin_schultz") -> DataFrame:
    """Mean over ``n`` pairs of neighbouring bars of the spread estimate, each floored at 0."""
    w = _w()
    h0, l0 = F.lag(_d("high")).over(w), F.lag(_d("low")).over(w)
    beta = F.pow(log_ratio(_d("high"), _d("low")), 2.0) + F.pow(log_ratio(h0, l0), 2.0)
    gamma = F.pow(log_ratio(F.greatest(_d("high"), h0), F.least(_d("low"), l0)), 2.0)
    c = 3 - 2 * math.sqrt(2)
    b = bars.withColumns({"_beta": F.when(h0.isNotNull(), beta), "_gamma": F.when(h0.isNotNull(), gamma)})
    b = b.withColumn("_alpha", (F.sqrt(2 * F.col("_beta")) - F.sqrt("_beta")) / c - F.sqrt(F.col("_gamma") / c))
    b = b.withColumn("_s", F.when(F.col("_alpha").isNotNull(), F.greatest(2 * (F.exp("_alpha") - 1) / (1 + F.exp("_alpha")), F.lit(0.0))))
    return b.withColumn(name, full(F.col("_s"), w, n, F.avg)).drop("_beta", "_gamma", "_alpha", "_s")


def standardize(x: str, n: int) -> Column:
    w = _w()
    return (F.col(x) - full(F.col(x), w, n, F.avg)) / nonzero(full(F.col(x), w, n, F.stddev_pop))


def difference(x: str, n: int) -> Column:
    return F.col(x) - F.lag(x, n).over(_w())


def moving_average(x: str, n: int) -> Column:
    return full(F.col(x), _w(), n, F.avg)


def _ranked_in_run(df: DataFrame, x: str, n: int) -> DataFrame:
    def spans(rows):
        runs, place = rows.column("run_id").to_numpy(), np.arange(rows.num_rows)
        begin = np.maximum.accumulate(np.where(np.diff(runs, prepend=runs[:1] - 1) != 0, place, 0))
        return np.maximum(begin, place - n + 1), place + 1

    return trailing_ranks(df, ["symbol"], ["run_id", "interval_start"], x, spans)


def add_rank_in_time(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Rank of the value among the last ``n`` of its run, ties averaged, from 0 to 1."""
    value = F.when(F.col("_n") == n, (2 * F.col("_less") + F.col("_equal") - 1) / (2.0 * (n - 1)))
    return _ranked_in_run(df, x, n).withColumn(name, value).drop("_size", "_n", "_less", "_equal")


def add_quantile_in_time(df: DataFrame, x: str, n: int, buckets: int, name: str) -> DataFrame:
    """Bucket of that rank, from 0, in whole numbers."""
    at = F.floor((2 * F.col("_less") + F.col("_equal") - 1) * buckets / F.lit(2 * (n - 1))).cast("int")
    return _ranked_in_run(df, x, n).withColumn(name, F.when(F.col("_n") == n, F.least(at, F.lit(buckets - 1)))).drop("_size", "_n", "_less", "_equal")


def over_bars(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], n: int, minutes: int, piece_bars: int = PIECE) -> DataFrame:
    """Bars with returns and what ``compute`` adds to them from windows of at most ``n`` bars of a run.

    A window of a run spans its bars' time, so a symbol is cut into pieces of ``piece_bars`` intervals that overlap by ``n + 2``: a busy symbol is many
    tasks. ``run_id`` numbers the runs of a piece.
    """
    us = minutes * 60_000_000
    return in_pieces(bars, lambda b: compute(with_returns(b)), (n + 2) * us, piece_bars * us)


def cross_section(df: DataFrame, x: str, at: str = "interval_end", buckets: int = 5) -> DataFrame:
    """``cs_rank`` and ``cs_quantile`` of the value among all symbols with a value at one time; null where only one has.

    A window without an order counts the group, a rank gives how many are less: two passes over one partitioning.
    """
    group = Window.partitionBy(at, F.col(x).isNull())
    less = F.rank().over(group.orderBy(x)) - 1
    equal = F.count("*").over(Window.partitionBy(at, F.col(x).isNull(), x))
    n = F.count("*").over(group)
    b = df.withColumns({"_less": less, "_equal": equal, "_n": n})
    fine = F.col(x).isNotNull() & (F.col("_n") > 1)
    top = 2 * F.col("_less") + F.col("_equal") - 1
    return b.withColumn("cs_rank", F.when(fine, top / (2.0 * (F.col("_n") - 1)))).withColumn("cs_quantile", F.when(fine, F.least(F.floor(top * buckets / (2 * (F.col("_n") - 1))).cast("int"), F.lit(buckets - 1)))).drop("_less", "_equal", "_n")


def product(x: str, y: str) -> Column:
    return F.col(x) * F.col(y)


# ---- recursive smoothing along each contiguous run


def _in_runs(bars: DataFrame, columns: list[str], partitions: int | None) -> Blocks:
    """The columns as doubles, in blocks along ``symbol, run_id`` and time, each with the bar before (``high0``, ...), across blocks."""
    slim = bars.select("symbol", "run_id", "interval_start", *[F.col(c).cast("double").alias(c) for c in columns])
    return previous(in_blocks(slim, ["symbol", "run_id"], ["interval_start"], partitions), {f"{c}0": c for c in columns})


def _with(blocks: Blocks, **columns: Column) -> Blocks:
    return blocks.but(blocks.rows.withColumns(columns))


def _of_run(blocks: Blocks, *names: str) -> DataFrame:
    return blocks.rows.select("symbol", "run_id", "interval_start", *names)


def _true_range() -> Column:
    """The true range of a bar that has one before it, else null."""
    h, l, c = (F.col(n) for n in ("high", "low", "close0"))
    return F.when(c.isNotNull(), F.greatest(h - l, F.abs(h - c), F.abs(l - c)))


def atr(bars: DataFrame, period: int, partitions: int | None = None) -> DataFrame:
    """Wilder's average true range: ``symbol, run_id, interval_start, atr``; needs ``period + 1`` bars of the run.

    A run is cut into blocks if it is long (``in_blocks``): what a block does to an average is affine, so averages are carried over
    blocks by two numbers each. So do ``rsi``, ``macd`` and ``adx``.
    """
    blocks = _with(_in_runs(bars, ["high", "low", "close"], partitions), tr=_true_range())
    return _of_run(smooth(blocks, {"atr": Smoothing("tr", period, 1 / period)}), "atr")


def rsi(bars: DataFrame, period: int, partitions: int | None = None) -> DataFrame:
    """Wilder's relative strength index, 100 where there was no loss."""
    step = F.col("close") - F.col("close0")
    blocks = _with(_in_runs(bars, ["close"], partitions), up=F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), down=F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))))
    both = smooth(blocks, {"gain": Smoothing("up", period, 1 / period), "loss": Smoothing("down", period, 1 / period)})
    value = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0))))
    return _of_run(_with(both, rsi=F.when(F.col("gain").isNotNull(), value)), "rsi")


def macd(bars: DataFrame, fast: int, slow: int, signal: int, partitions: int | None = None) -> DataFrame:
    """``macd_line`` and ``macd_signal``; both averages start from the mean of the first ``slow`` closes of the run."""
    averages = smooth(_in_runs(bars, ["close"], partitions), {"fast": Smoothing("close", slow, 2 / (fast + 1)), "slow": Smoothing("close", slow, 2 / (slow + 1))})
    line = _with(averages, macd_line=F.col("fast") - F.col("slow"))
    return _of_run(smooth(line, {"macd_signal": Smoothing("macd_line", signal, 2 / (signal + 1))}), "macd_line", "macd_signal")


def adx(bars: DataFrame, period: int, partitions: int | None = None) -> DataFrame:
    """Wilder's average directional index; null from where a smoothed range or both directions are zero."""
    blocks = _in_runs(bars, ["high", "low", "close"], partitions)
    up, down = F.col("high") - F.col("high0"), F.col("low0") - F.col("low")
    moved = lambda one, other: F.when(F.col("close0").isNotNull(), F.when((one > other) & (one > 0), one).otherwise(0.0))
    blocks = _with(blocks, tr=_true_range(), rise=moved(up, down), fall=moved(down, up))
    means = smooth(blocks, {n: Smoothing(x, period, 1 / period) for n, x in (("range", "tr"), ("plus", "rise"), ("minus", "fall"))})  # means: their ratios are those of the sums
    both = F.col("plus") + F.col("minus")
    known = (F.col("range") != 0) & (both != 0)
    # an infinite value ends it, also where it would be the first
    dx = F.when(known, 100 * F.abs(F.col("plus") - F.col("minus")) / F.nullif(both, F.lit(0.0))).when(F.col("range").isNotNull(), float("inf"))
    return _of_run(smooth(_with(means, dx=dx), {"adx": Smoothing("dx", period, 1 / period)}), "adx")
