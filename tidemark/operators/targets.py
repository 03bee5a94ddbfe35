"""Strategy targets, sizing and routing. Targets are ``time, instrument, target`` rows; gross weights are slices of 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import latest, time_blocks
from tidemark.functions.ranks import in_pieces
from tidemark.functions.windows import asof, nonzero, run_window, with_runs
from tidemark.operators.features import PIECE
from tidemark.operators.statistics import running_max


def _down(x: Column, digits: int = 18) -> Column:
    """Rounded towards zero at so many digits, on doubles at most 12."""
    scale = float(10 ** min(digits, 12))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def time_series_momentum(bars: DataFrame, n: int, time: str = "interval_end") -> DataFrame:
    """Sign of the sum of the last ``n`` log returns of the run, in equal slices of the instruments present; null sums are flat."""
    w = Window.partitionBy("symbol", "run_id").orderBy("interval_start").rowsBetween(-(n - 1), 0)
    total = F.when(F.count("log_return").over(w) == n, F.sum("log_return").over(w))
    side = F.coalesce(F.signum(total), F.lit(0.0))
    m = F.count("*").over(Window.partitionBy(time))
    return bars.select(F.col(time).alias("time"), F.col("symbol").alias("instrument"), side.alias("_side"), m.alias("_m")).select("time", "instrument", (F.col("_side") / F.col("_m")).alias("target"))


def trailing_return(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol", "run_id").orderBy("interval_start")
    return bars.withColumn("trailing", F.col("close").cast("double") / F.lag(F.col("close").cast("double"), n).over(w) - 1)


def cross_sectional_momentum(bars: DataFrame, n: int, top_n: int, time: str = "interval_end") -> DataFrame:
    """Long the ``k`` best trailing returns, short the ``k`` worst, ``k = min(top_n, m div 2)``; ties by name; slices rounded down."""
    known = trailing_return(bars, n).where("trailing is not null").select(F.col(time).alias("time"), F.col("symbol").alias("instrument"), "trailing")
    w = Window.partitionBy("time")
    b = known.withColumns({"m": F.count("*").over(w), "best": F.row_number().over(w.orderBy(F.desc("trailing"), "instrument")), "worst": F.row_number().over(w.orderBy("trailing", "instrument"))})
    k = F.least(F.lit(top_n), F.floor(F.col("m") / 2))
    side = F.when(F.col("best") <= k, 1.0).when(F.col("worst") <= k, -1.0).otherwise(0.0)
    return b.select("time", "instrument", F.when(k > 0, _down(side / (2 * F.when(k > 0, k)))).otherwise(0.0).alias("target"))


def dual_momentum(bars: DataFrame, n: int, universe: int, time: str = "interval_end") -> DataFrame:
    """All in the single best trailing return if it is positive; flat when an instrument is missing or the best is tied."""
    known = trailing_return(bars, n).select(F.col(time).alias("time"), F.col("symbol").alias("instrument"), "trailing")
    w = Window.partitionBy("time")
    best = F.max("trailing").over(w)
    b = known.withColumns({"best": best, "n_known": F.count("trailing").over(w)})
    b = b.withColumn("n_best", F.count(F.when(F.col("trailing") == F.col("best"), 1)).over(w))
    held = (F.col("n_known") == universe) & (F.col("n_best") == 1) & (F.col("trailing") == F.col("best")) & (F.col("best") > 0)
    return b.select("time", "instrument", F.when(held, 1.0).otherwise(0.0).alias("target"))


def _latched(bars: DataFrame, marks: Callable[[DataFrame], tuple[Column, Column]], n: int, minutes: int, time: str, piece_bars: int) -> DataFrame:
    """1 from an entry to the next exit within the run; ``marks(bars)`` says where to enter and leave, never both, from ``n`` bars before.

    The marks come from pieces of a symbol's time. A run begins flat, so the target is the symbol's last mark, which goes from piece to piece.
    """
    us = minutes * 60_000_000

    def marked(piece: DataFrame) -> DataFrame:
        piece = with_runs(piece)
        enter, leave = marks(piece)
        first = F.row_number().over(run_window()) == 1
        return piece.withColumn("_mark", F.when(leave, 0.0).when(enter, 1.0).when(first, 0.0))

    found = in_pieces(bars, marked, (n + 2) * us, piece_bars * us).select(F.col("symbol").alias("instrument"), "interval_start", F.col(time).alias("time"), "_mark")
    return latest(time_blocks(found, ["instrument"], "interval_start", piece_bars * us), "_mark", "target").rows.select("time", "instrument", "target")


def donchian_breakout(bars: DataFrame, entry: int, exit: int, minutes: int, time: str = "interval_end", piece_bars: int = PIECE) -> DataFrame:
    """Long after a close above the highest high of ``entry`` earlier bars, flat after one below the lowest low of ``exit``; resets at a gap.

    Bars of ``minutes``; a symbol is worked through in pieces of ``piece_bars``.
    """
    n = max(entry, exit)

    def marks(b: DataFrame) -> tuple[Column, Column]:
        w, c = run_window(), F.col("close").cast("double")
        enough = F.count(F.lit(1)).over(w.rowsBetween(-n, -1)) == n
        above, below = c > F.max(F.col("high").cast("double")).over(w.rowsBetween(-entry, -1)), c < F.min(F.col("low").cast("double")).over(w.rowsBetween(-exit, -1))
        return enough & above, enough & below

    return _latched(bars, marks, n, minutes, time, piece_bars)


def zscore_reversion(bars: DataFrame, n: int, entry_z: float, exit_z: float, minutes: int, time: str = "interval_end", piece_bars: int = PIECE) -> DataFrame:
    """Long under ``-entry_z``, flat above ``-exit_z`` or where the z-score is missing. Bars of ``minutes``, in pieces of ``piece_bars``."""

    def marks(b: DataFrame) -> tuple[Column, Column]:
        w, c = run_window().rowsBetween(-(n - 1), 0), F.col("close").cast("double")
        z = F.when(F.count(c).over(w) == n, (c - F.avg(c).over(w)) / nonzero(F.stddev_pop(c).over(w)))
        return z < -entry_z, z.isNull() | (z > -exit_z)

    return _latched(bars, marks, n, minutes, time, piece_bars)


def conditioned(targets: DataFrame, states: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Targets held only in the allowed latest state of their instrument; ``states``: instrument, available_time, state."""
    joined = asof(targets, states, ["instrument"], "time", "available_time", "state")
    return joined.select("time", "instrument", F.when(F.col("state").isin(list(allowed)), F.col("target")).otherwise(0.0).alias("target"))


def ensemble(*targets: DataFrame) -> DataFrame:
    """Mean of several strategies' targets; a strategy that says nothing counts as flat."""
    union = targets[0]
    for t in targets[1:]:
        union = union.unionByName(t)
    return union.groupBy("time", "instrument").agg((F.sum("target") / len(targets)).alias("target"))


def negated(targets: DataFrame, spot: bool = False) -> DataFrame:
    """Opposite targets; for spot a negative target is refused: it becomes null with a problem."""
    t = -F.col("target")
    if not spot:
        return targets.withColumn("target", t)
    return targets.withColumns({"problem": F.when(t < 0, "negative target for spot"), "target": F.when(t >= 0, t)})


def volatility_target(targets: DataFrame, volatility: DataFrame, goal: float, leverage_cap: float, position_cap: float, gross_cap: float) -> DataFrame:
    """Targets scaled to a volatility goal, then capped by leverage, position and gross: ``time, instrument, target, rules``.

    ``volatility``: instrument, available_time, vol. A target without a positive volatility becomes 0. ``rules`` lists what bound.
    """
    j = asof(targets, volatility, ["instrument"], "time", "available_time", "vol")
    scale = F.least(goal / F.when(F.col("vol") > 0, F.col("vol")), F.lit(leverage_cap))
    j = j.withColumns({"_missing": ~F.coalesce(F.col("vol") > 0, F.lit(False)), "_lev": goal / F.when(F.col("vol") > 0, F.col("vol")) > leverage_cap, "_x": F.col("target") * F.coalesce(F.when(F.col("vol") > 0, scale), F.lit(0.0))})
    j = j.withColumn("_y", F.greatest(F.least("_x", F.lit(position_cap)), F.lit(-position_cap)))
    gross = F.sum(F.abs("_y")).over(Window.partitionBy("time"))
    j = j.withColumn("_gross", gross)
    active = F.col("target") != 0
    rules = F.array_compact(F.array(F.when(active & F.col("_missing"), "no_volatility"), F.when(active & F.col("_lev"), "leverage"), F.when(F.abs("_x") > position_cap, "position"), F.when(active & (F.col("_gross") > gross_cap), "gross")))
    return j.select("time", "instrument", (F.col("_y") * F.when(F.col("_gross") > gross_cap, gross_cap / F.col("_gross")).otherwise(1.0)).alias("target"), F.concat_ws(",", rules).alias("rules"))


def drawdown_control(targets: DataFrame, equity: DataFrame, limit: float, fraction: float) -> DataFrame:
    """Targets times ``fraction`` while the latest equity stands more than ``limit`` below its peak; ``equity``: time, equity of one book.

    One book has no key to deal rows by: peaks, and then the latest mark before each target, are running maxima over range
    partitions of time.
    """
    e = running_max(equity.select(F.col("time").alias("at"), "equity"), [F.col("at"), F.col("equity")], F.col("equity"), "peak")
    mark = F.struct("at", "equity", (1 - F.col("equity") / F.col("peak") > limit).alias("deep"))
    marks = e.select("at", F.lit(0).alias("side"), mark.alias("mark"))
    asked = targets.select(F.col("time").alias("at"), F.lit(1).alias("side"), F.struct("time", "instrument", "target").alias("ask"))
    both = marks.unionByName(asked, allowMissingColumns=True)
    found = running_max(both, [F.col("at"), F.col("side")], F.col("mark"), "latest").where("side = 1")
    return found.select("ask.time", "ask.instrument", (F.col("ask.target") * F.when(F.coalesce(F.col("latest.deep"), F.lit(False)), fraction).otherwise(1.0)).alias("target"))


def route(states: DataFrame, table: dict[str, dict[str, float]], fallback: dict[str, float]) -> DataFrame:
    """State labels to strategy weights: ``key, time, strategy, weight``; unknown and null states take the fallback."""
    spark = states.sparkSession
    names = sorted({s for w in [*table.values(), fallback] for s in w})
    rows = [(k, s, float(w.get(s, 0.0))) for k, w in [*table.items(), ("", fallback)] for s in names]
    weights = F.broadcast(spark.createDataFrame(rows, "route string, strategy string, weight double"))
    known = F.when(F.col("state").isin(list(table)), F.col("state")).otherwise("")
    return states.withColumn("route", known).join(weights, "route").select("key", "time", "strategy", "weight")


def routing_cost(routed: DataFrame, rate: float) -> DataFrame:
    """Turnover and cost of each change of weights: ``key, time, turnover, cost``; the first weights are bought from nothing."""
    w = Window.partitionBy("key", "strategy").orderBy("time")
    step = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    return routed.withColumn("_step", step).groupBy("key", "time").agg(F.sum("_step").alias("turnover")).withColumn("cost", F.col("turnover") * rate)


def combine(decisions: DataFrame, positions: DataFrame) -> DataFrame:
    """Weighted sum of each strategy's latest target at each routing time: ``time, instrument, target, latest_input``.

    ``decisions``: time, strategy, instrument, weight. ``positions``: strategy, instrument, at, target.
    """
    j = asof(decisions, positions, ["strategy", "instrument"], "time", "at", "target")
    return j.where("target is not null").groupBy("time", "instrument").agg(F.sum(F.col("weight") * F.col("target")).alias("target"), F.max("matched_time").alias("latest_input"))


def execution_bars(targets: DataFrame, bars: DataFrame) -> DataFrame:
    """Each target with its instrument's first bar at or after the decision: ``..., exec_start``."""
    e = targets.select("instrument", F.col("time").alias("t"), F.lit(0).alias("side"), F.struct("*").alias("row"), F.lit(None).cast("timestamp").alias("bar"))
    b = bars.select(F.col("symbol").alias("instrument"), F.col("interval_start").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(e.schema["row"].dataType).alias("row"), F.col("interval_start").alias("bar"))
    ahead = Window.partitionBy("instrument").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows
    return e.unionByName(b).withColumn("exec_start", F.last("bar", ignorenulls=True).over(ahead)).where("side = 0").select("row.*", "exec_start")


def supersede(executed: DataFrame) -> DataFrame:
    """Of targets on one execution bar the latest decision: ``..., n_superseded``; targets without a bar stay unexecuted and go."""
    w = Window.partitionBy("instrument", "exec_start")
    b = executed.where("exec_start is not null").withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("time"))), "n_superseded": F.count("*").over(w) - 1})
    return b.where("_rn = 1").drop("_rn")


def bar_signals(bars: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Bar features as long signals: ``instrument, available_time, signal, value``; missing values are left out."""
    from tidemark.operators.features import realized_volatility

    b = bars.withColumns({f"vol_{n}": realized_volatility(n) for n in windows})
    cols = {"log_return": F.col("log_return"), "close": F.col("close").cast("double"), **{f"vol_{n}": F.col(f"vol_{n}") for n in windows}}
    pairs = F.array(*[F.struct(F.lit(k).alias("signal"), v.alias("value")) for k, v in cols.items()])
    return b.select(F.col("symbol").alias("instrument"), "available_time", F.explode(pairs).alias("s")).select("instrument", "available_time", "s.signal", "s.value").where("value is not null")


def parameter_grid(operators: DataFrame, strategies: DataFrame, parameters: dict[str, Sequence[float]]) -> DataFrame:
    """Every operator with every strategy at every parameter point: three short lists multiplied out."""
    points = F.explode(F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(parameters, p, strict=True)]) for p in _points(list(parameters.values()))]))
    return operators.crossJoin(F.broadcast(strategies)).withColumn("p", points).select("operator", "strategy", "p.*")


def _points(values: list[Sequence[float]]) -> list[tuple]:
    from itertools import product

    return list(product(*values))
