"""Return statistics, tests and multiple-testing corrections, and the gates built on them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import in_ranges
from tidemark.functions.session import materialise


#: From here on the tail comes from its continued fraction, below from the power series; terms of each.
TAIL_FROM, SERIES, FRACTION = 3.0, 40, 60
#: Coefficients of Acklam's rational approximation of the normal quantile, centre and tails.
CENTRE_OVER = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_UNDER = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_OVER = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_UNDER = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution, in column functions alone; null for null and NaN."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    series, square = F.lit(1.0), x * x
    for k in range(SERIES, 0, -1):  # x + x^3 / 3 + x^5 / (3 * 5) + ...
        series = 1 + square / (2 * k + 1) * series
    far = F.greatest(x, F.lit(TAIL_FROM))
    fraction = far
    for k in range(FRACTION, 0, -1):  # x + 1 / (x + 2 / (x + 3 / ...))
        fraction = far + k / fraction
    tail = F.when(x < TAIL_FROM, 0.5 - density * x * series).otherwise(density / fraction)
    return F.when(~F.isnan(z), F.when(z >= 0, tail).otherwise(1 - tail))


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Where the standard normal distribution function is ``p``; null outside (0, 1). Relative error about 1e-9."""
    q = p - 0.5
    middle = q * _horner(CENTRE_OVER, q * q) / _horner(CENTRE_UNDER, q * q)
    far = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _horner(TAIL_OVER, far) / _horner(TAIL_UNDER, far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.47575, middle).when(q < 0, tail).otherwise(-tail))


def effective_sample(spans: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Clusters of overlapping spans per key: ``by, n_spans, n_effective``. A span starting where the last ends is apart."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    b = spans.withColumn("_before", F.max(end).over(w))
    return b.groupBy(*by).agg(F.count("*").alias("n_spans"), F.count(F.when(F.col("_before").isNull() | (F.col(start) >= F.col("_before")), 1)).alias("n_effective"))


def overlap_lag(spans: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Largest number of later spans that start before an earlier one ends: ``by, lag``.

    In start order, the spans that start before ``end`` are a prefix, so a span's number is the count of starts below its
    end less its own rank. Ranks are taken along the key's starts and travel with the ends, which meet the starts in a second pass; both passes
    are dealt by key alone, so spans are shuffled once and joined to nothing.
    """
    keys = list(by)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(start, end))
    point = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("is_start"), F.lit(None).cast("int").alias("rank")), F.struct(F.col(end).alias("t"), F.lit(0).alias("is_start"), F.col("_rank").alias("rank"))))
    points = spans.select(*keys, start, end).withColumn("_rank", rank).select(*keys, point.alias("_p")).select(*keys, "_p.*")
    w = Window.partitionBy(*keys).orderBy("t", "is_start").rowsBetween(Window.unboundedPreceding, 0)
    ends = points.withColumn("_below", F.sum("is_start").over(w)).where("is_start = 0 and t is not null")
    return ends.groupBy(*keys).agg(F.max(F.col("_below") - F.col("rank")).alias("lag"))


def hac_test(values: DataFrame, by: Sequence[str], order: Sequence[str], x: str, lags: int) -> DataFrame:
    """Mean, Newey-West error with Bartlett weights, t and one- and two-sided normal p-values per key; null without spread."""
    w = Window.partitionBy(*by)
    centred = values.where(F.col(x).isNotNull()).withColumn("_c", F.col(x) - F.avg(x).over(w))
    ordered = w.orderBy(*order)
    for k in range(1, lags + 1):
        centred = centred.withColumn(f"_p{k}", F.col("_c") * F.lag("_c", k).over(ordered))
    sums = [F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)]
    out = centred.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), sum(sums, F.sum(F.col("_c") * F.col("_c"))).alias("_long"))
    out = out.withColumn("se", F.when((F.col("n") > 1) & (F.col("_long") > 0), F.sqrt("_long") / F.col("n"))).withColumn("t", F.col("mean") / F.col("se"))
    return out.select(*by, "n", "mean", "se", "t", normal_sf(F.col("t")).alias("p_greater"), (2 * normal_sf(F.abs("t"))).alias("p_two_sided"))


def adjust_p(p: Column, trials: Column, method: str) -> Column:
    if method == "bonferroni":
        return F.least(F.lit(1.0), p * trials)
    if method == "sidak":
        return 1 - F.pow(1 - p, trials)
    raise ValueError(method)


def sharpe(x: str | Column) -> Column:
    """Mean over sample deviation as an aggregate; 0 below two values or without spread."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when((F.count(x) > 1) & (F.stddev_samp(x) > 0), F.avg(x) / F.stddev_samp(x)).otherwise(F.lit(0.0))


def compounded(x: str) -> Column:
    """Compounded return as an aggregate; -1 if a period lost everything or more."""
    return F.when(F.min(x) <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum(F.log1p(F.when(F.col(x) > -1, F.col(x))))) - 1)


def net_returns(returns: DataFrame, multiplier: float = 1.0, gross: str = "gross", cost: str = "cost") -> DataFrame:
    return returns.withColumn("net", F.col(gross) - multiplier * F.col(cost))


def breakeven_multiple(gross: str = "gross", cost: str = "cost") -> Column:
    """How many times the cost the gross result bears, as an aggregate; null without cost."""
    return F.avg(gross) / F.when(F.avg(cost) > 0, F.avg(cost))


def period_returns(equity: DataFrame, fills: DataFrame, by: str = "trial") -> DataFrame:
    """Returns between marks, with each fill's cost at the first mark strictly after it: ``by, mark, gross, cost``.

    ``equity``: by, mark, equity. ``fills``: by, fill_time, cost. One backward sort over both.
    """
    w = Window.partitionBy(by).orderBy("mark")
    marks = equity.withColumn("before", F.lag("equity").over(w))
    f = fills.select(by, F.col("fill_time").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("timestamp").alias("at"), "cost")
    m = equity.select(by, F.col("mark").alias("t"), F.lit(0).alias("side"), F.col("mark").alias("at"), F.lit(None).cast("double").alias("cost"))
    ahead = Window.partitionBy(by).orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    placed = f.unionByName(m).withColumn("mark", F.last("at", ignorenulls=True).over(ahead)).where("side = 1 and mark is not null").groupBy(by, "mark").agg(F.sum("cost").alias("paid"))
    out = marks.where("before is not null").join(placed, [by, "mark"], "left")
    cost = F.coalesce("paid", F.lit(0.0)) / F.col("before")
    return out.select(by, "mark", (F.col("equity") / F.col("before") - 1 + cost).alias("gross"), cost.alias("cost"))


def excess(returns: DataFrame, benchmark: DataFrame, on: str = "time") -> DataFrame:
    """Per trial: mean excess over the benchmark, the share of periods above it, and the mean of the opposite positions."""
    b = benchmark.select(on, F.col("net").alias("bench"))
    joined = returns.join(b, on).withColumn("excess", F.col("net") - F.col("bench"))
    return joined.groupBy("trial").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"), F.avg((F.col("excess") > 0).cast("double")).alias("positive_share"), F.avg(-F.col("gross") - F.col("cost")).alias("inverse_mean"), compounded("net").alias("compounded"))


def overfitting_probability(returns: DataFrame, segments: int, x: str = "net", embargo: int = 0) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation; one row.

    ``returns``: ``trial, time_no`` (0..n-1, the same grid for each trial) and the return. The grid is cut into an even
    number of segments; every half of them is in-sample once, and the other half out of sample, less ``embargo`` periods at
    the start of each segment that follows an in-sample one. The trial with the best in-sample Sharpe ratio gets the logit
    of its average rank outside. Segment sums are aggregated once; the splits join those few rows, not the returns.
    """
    from itertools import combinations

    spark = returns.sparkSession
    n = (returns.agg(F.max("time_no") + 1).first()[0]) or 1
    seg = F.least(F.floor(F.col("time_no") * segments / F.lit(n)), F.lit(segments - 1)).cast("int")
    cut = returns.withColumn("seg", seg).where("seg is not null")
    firsts = cut.groupBy("seg").agg(F.min("time_no").alias("first"))  # a row for each segment
    cut = cut.join(F.broadcast(firsts), "seg").withColumn("early", (F.col("time_no") - F.col("first") < embargo).cast("int"))
    sums = cut.groupBy("trial", "seg", "early").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    splits = [(i, s, int(s in c), int(s - 1 in c)) for i, c in enumerate(combinations(range(segments), segments // 2)) for s in range(segments)]
    plan = spark.createDataFrame(splits, "split int, seg int, inside int, after int")
    both = sums.join(F.broadcast(plan), "seg").where("inside = 1 or not (after = 1 and early = 1)")
    per = both.groupBy("split", "trial", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, var = F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    per = per.withColumn("sharpe", F.round(F.when((F.col("n") > 1) & (var > 1e-18), mean / F.sqrt(var)).otherwise(0.0), 9))
    best = per.where("inside = 1").groupBy("split").agg(F.max_by("trial", F.struct("sharpe", F.col("trial"))).alias("trial"))
    w = Window.partitionBy("split")
    outside = per.where("inside = 0")
    ranked = outside.withColumns({"less": F.rank().over(w.orderBy("sharpe")) - 1, "equal": F.count("*").over(Window.partitionBy("split", "sharpe")), "trials": F.count("*").over(w)})
    rank = (F.col("less") + (F.col("equal") + 1) / 2) / (F.col("trials") + 1)
    chosen = ranked.join(best, ["split", "trial"]).withColumn("logit", F.log(rank / (1 - rank)))
    return chosen.agg(F.count("*").alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Expected largest Sharpe ratio of ``trials`` unskilled trials with this variance of ratios."""
    gamma = 0.5772156649015329
    return F.sqrt(variance) * ((1 - gamma) * normal_quantile(1 - 1 / trials) + gamma * normal_quantile(1 - 1 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, x: str = "net") -> DataFrame:
    """Per trial: Sharpe ratio, the largest one expected by chance among all trials, and the probability of beating it."""
    per = returns.groupBy("trial").agg(F.count(x).alias("n"), sharpe(x).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    family = per.agg(F.var_samp("sharpe").alias("v"), F.count("*").cast("double").alias("k"))
    both = per.crossJoin(F.broadcast(family)).withColumn("expected", F.when(F.col("k") > 1, expected_max_sharpe(F.col("v"), F.col("k"))).otherwise(0.0))
    spread = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = (F.col("sharpe") - F.col("expected")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(spread > 0, spread))
    return both.select("trial", "n", "sharpe", "expected", (1 - normal_sf(z)).alias("deflated"))


def neighbourhood(trials: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Every trial's neighbours, one step away in one parameter: ``trial, n_due, n_found, share_positive, ratio``.

    ``trials``: ``trial, sharpe`` and, for each parameter, the place of its value among the declared ones, from 0; the
    largest place is that of the table. ``share_positive`` is null while a neighbour is missing; ``ratio`` (the
    neighbours' mean over the trial's own) also where the own ratio is not positive. Each trial asks for its neighbours'
    places and meets them by an equi-join.
    """
    ends = trials.agg(*[F.max(p).alias(f"last_{p}") for p in parameters])  # one row
    asked = trials.crossJoin(F.broadcast(ends))
    steps = [F.struct(*[(F.col(p) + (d if p == moved else 0)).alias(p) for p in parameters], (F.col(moved) + d).between(0, F.col(f"last_{moved}")).alias("due")) for moved in parameters for d in (-1, 1)]
    asked = asked.select("trial", F.col("sharpe").alias("own"), F.explode(F.array(*steps)).alias("at")).where("at.due").select("trial", "own", *[F.col("at")[p].alias(p) for p in parameters])
    met = asked.join(trials.select(*parameters, F.col("sharpe").alias("near")), list(parameters), "left")
    out = met.groupBy("trial").agg(F.count("*").alias("n_due"), F.count("near").alias("n_found"), F.avg((F.col("near") > 0).cast("double")).alias("share"), F.avg("near").alias("mean"), F.max("own").alias("own"))
    full = F.col("n_found") == F.col("n_due")
    return out.select("trial", "n_due", "n_found", F.when(full, F.col("share")).alias("share_positive"), F.when(full & (F.col("own") > 0), F.col("mean") / F.col("own")).alias("ratio"))


def stress(returns: DataFrame, multipliers: Sequence[float]) -> DataFrame:
    """Net result of each trial at each cost multiplier: ``trial, multiplier, net``."""
    m = returns.sparkSession.createDataFrame([(float(x),) for x in multipliers], "multiplier double")
    sums = returns.groupBy("trial").agg(F.sum("gross").alias("g"), F.sum("cost").alias("c"))
    return sums.crossJoin(F.broadcast(m)).select("trial", "multiplier", (F.col("g") - F.col("multiplier") * F.col("c")).alias("net"))


def shifted_ratio(returns: DataFrame, offsets: Sequence[int], x: str = "net") -> DataFrame:
    """Sharpe ratio of a signal that acts ``offset`` periods late, over that of the unshifted one: ``trial, offset, ratio``.

    ``returns``: ``trial, time_no, position, asset_return``.
    """
    w = Window.partitionBy("trial").orderBy("time_no")
    base = returns.groupBy("trial").agg(sharpe(F.col("position") * F.col("asset_return")).alias("base"))
    wide = returns
    for k in offsets:
        wide = wide.withColumn(f"_r{k}", F.lag("position", k).over(w) * F.col("asset_return"))
    late = wide.groupBy("trial").agg(*[sharpe(f"_r{k}").alias(f"s{k}") for k in offsets])
    stacked = late.select("trial", F.explode(F.array(*[F.struct(F.lit(k).alias("offset"), F.col(f"s{k}").alias("s")) for k in offsets])).alias("x"))
    return stacked.join(base, "trial").select("trial", "x.offset", (F.col("x.s") / F.when(F.col("base") != 0, F.col("base"))).alias("ratio"))


def walk_forward_result(returns: DataFrame, windows: DataFrame, by: str = "trial") -> DataFrame:
    """Per trial its results by window, summed up: windows, empty ones, positive share, largest window's share of profit.

    Returns meet the windows by day buckets (``within``); windows in which a trial has no return are counted as empty.
    """
    per = within(returns, "time", windows, "test_start", "test_end").groupBy(by, "window_no").agg(F.count("net").alias("n"), F.sum("net").alias("net"))
    n_windows = windows.agg(F.count("*").alias("n_windows"))  # one row
    total = F.sum("net")
    out = per.where("n > 0").groupBy(by).agg(F.count("*").alias("n_full"), F.avg((F.col("net") > 0).cast("double")).alias("positive_share"), F.when(total > 0, F.max("net") / total).alias("largest_share"))
    all_ = returns.select(by).distinct().join(out, by, "left").crossJoin(F.broadcast(n_windows))
    return all_.select(by, "n_windows", (F.col("n_windows") - F.coalesce("n_full", F.lit(0))).alias("n_empty"), "positive_share", "largest_share")


def capacity(fills: DataFrame, max_participation: float, impact: float) -> DataFrame:
    """Per trial: the multiple of its size that the thinnest market bears, turnover, and square-root impact.

    ``fills``: ``trial, traded, market_volume``.
    """
    t, v = F.col("traded"), F.col("market_volume")
    return fills.groupBy("trial").agg((F.min(v / F.when(t > 0, t)) * max_participation).alias("capacity"), F.sum(t).alias("turnover"), F.sum(impact * F.sqrt(t / F.when(v > 0, v)) * t).alias("impact_cost"))


def cross_asset(returns: DataFrame, sub_universe_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """Result and sign per instrument, and results of disjoint groups of the sorted instruments (those left over join the last)."""
    per = materialise(returns.groupBy("instrument").agg(F.avg("net").alias("mean_net"), (F.avg("net") > 0).alias("positive")), "instruments")
    last = max(per.count() // sub_universe_size, 1) - 1
    numbered = ranked(per, [F.col("instrument")], "rn")
    group = F.least(F.floor(F.col("rn") / sub_universe_size), F.lit(last)).cast("int")
    return per, numbered.groupBy(group.alias("group_no")).agg(F.count("*").alias("n"), F.avg("mean_net").alias("mean_net"))


def gate(value: Column, limit: Column, direction: Column, band: Column) -> Column:
    """PASS, FAIL, or INCONCLUSIVE where the value is null or within the band of the limit."""
    passed = F.when(direction == ">=", value >= limit).otherwise(value <= limit)
    return F.when(value.isNull() | (F.abs(value - limit) <= band), "INCONCLUSIVE").when(passed, "PASS").otherwise("FAIL")


def gate_table(metrics: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every threshold's gate for each key: ``by, metric, value, limit, outcome``. A metric that is missing is inconclusive."""
    t = F.broadcast(thresholds)
    if by:
        due = metrics.select(*by).distinct().crossJoin(t)
        joined = due.join(metrics, [*by, "metric"], "left")
    else:
        joined = thresholds.join(metrics, "metric", "left")
    return joined.select(*by, "metric", "value", "limit", gate(F.col("value"), F.col("limit"), F.col("direction"), F.col("band")).alias("outcome"))


def long_metrics(wide: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns as rows ``by, metric, value``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")


def dealt(seed: int, *columns: str) -> Column:
    """A seeded order of rows: the md5 of seed and columns as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def shuffled(study: DataFrame, seed: int, key: str = "event_key", x: str = "label") -> DataFrame:
    """The study with its labels dealt anew: both columns are ranked, keys by name and labels by a hash with the seed, and joined by rank.

    Ranks over the whole table come from sums over range partitions, not from one task.
    """
    keys = ranked(study.select(key), [F.col(key)], "_k")
    values = ranked(study.select(key, x), [dealt(seed, key), F.col(key)], "_k").select("_k", x)
    return keys.join(values, "_k").drop("_k")


def shifted(study: DataFrame, offset: int, key: str = "event_key", x: str = "label") -> DataFrame:
    """The study with each label moved on by ``offset`` places, around the end."""
    n = study.count()
    numbered = ranked(study.select(key, x), [F.col(key)], "_k")
    moved = numbered.select(((F.col("_k") + offset) % F.lit(n)).alias("_k"), x)
    return numbered.select(key, "_k").join(moved, "_k").drop("_k")


def ranked(df: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in a total order without a single-task window: range partitions, counted, then offset."""
    split = in_ranges(df, order, partitions)
    inner = split.withColumn("_rk_i", F.row_number().over(Window.partitionBy("_rk_part").orderBy("_rk_o")))
    counts = inner.groupBy("_rk_part").agg(F.count("*").alias("_rk_n"))
    before = counts.withColumn("_rk_b", F.coalesce(F.sum("_rk_n").over(Window.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return inner.join(F.broadcast(before.select("_rk_part", "_rk_b")), "_rk_part").withColumn(name, F.col("_rk_b") + F.col("_rk_i") - 1).drop("_rk_o", "_rk_part", "_rk_i", "_rk_b")


def running_max(df: DataFrame, order: Sequence[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """The largest ``value`` of all rows up to each one in a total order, nulls passed over, without a single-task window.

    As in ``ranked``: a running maximum inside range partitions, joined with the largest of the partitions before.
    """
    split = in_ranges(df.withColumn("_rk_v", value), order, partitions)
    inner = split.withColumn("_rk_m", F.max("_rk_v").over(Window.partitionBy("_rk_part").orderBy("_rk_o").rowsBetween(Window.unboundedPreceding, 0)))
    tops = split.groupBy("_rk_part").agg(F.max("_rk_v").alias("_rk_t"))
    before = tops.withColumn("_rk_b", F.max("_rk_t").over(Window.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row per partition
    return inner.join(F.broadcast(before.select("_rk_part", "_rk_b")), "_rk_part").withColumn(name, F.greatest("_rk_m", "_rk_b")).drop("_rk_o", "_rk_part", "_rk_v", "_rk_m", "_rk_b")


def within(rows: DataFrame, time: str, spans: DataFrame, start: str, end: str, bucket_days: int = 16) -> DataFrame:
    """Rows with each span that their time falls into, ``start <= time < end``: an equi-join on day buckets, not a nested loop.

    Spans are repeated for the buckets they meet; of the two sides Spark broadcasts one only if it is small.
    """
    day = lambda c: F.floor(F.unix_date(F.to_date(c)) / bucket_days)
    repeated = spans.withColumn("_bucket", F.explode(F.sequence(day(F.col(start)), day(F.col(end)))))
    met = rows.withColumn("_bucket", day(F.col(time))).join(repeated, "_bucket")
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket")


#: Observed sides that ``null_percentile`` sends together, in the order of their ranks.
SIDES = 4096
#: Rows of all its draws that a task deals or ranks, about.
DEALT = 2_000_000


def null_percentile(pool: DataFrame, observed: DataFrame, sims: int, seed: int, key: str = "key", x: str = "label") -> DataFrame:
    """Mid-rank percentile of the observed mean of ``side * label`` among seeded draws of as many labels from the pool.

    Each draw takes the labels with the smallest hashes and pairs them with the observed sides by rank. A histogram of the hashes' first digits
    tells at which rank each of them begins in each draw. Labels then go through one shuffle by these digits, with 16 bytes of hash and no key
    (equal hashes of a draw are equal keys), are ranked within digits and draw, and meet there the few sides that any draw needs for these
    digits: no draw and no study is one task, and no label is written or shuffled again. Null, with its row, when the pool is smaller.
    ``observed``: key, label, side.
    """
    spark = pool.sparkSession
    labels = materialise(pool.where(F.col(x).isNotNull()).select(key, x), "pool")
    observed = materialise(observed.select(key, x, "side"), "observed")
    n = observed.count()
    draws = spark.range(sims).select(F.col("id").alias("sim"))
    digits = spark.range(4096).select(F.lpad(F.lower(F.hex("id")), 3, "0").alias("_d"))
    all_ = labels.count() * sims
    hashed = lambda tasks: labels.repartition(tasks).crossJoin(F.broadcast(draws)).withColumn("_h", dealt(seed, key, "sim")).withColumn("_d", F.substring("_h", 1, 3))
    few = max(1 + all_ // (10 * DEALT), min(1 + all_ // DEALT, 3 * spark.sparkContext.defaultParallelism))  # each task sends a row for all digits of all draws
    counts = hashed(few).groupBy("_d", "sim").agg(F.count("*").alias("c"))  # 4096 rows a draw at most
    before = F.sum("c").over(Window.partitionBy("sim").orderBy("_d")) - F.col("c")
    begins = digits.crossJoin(draws).join(counts, ["_d", "sim"], "left").fillna(0, ["c"]).withColumn("_b", before)
    in_order = lambda place, value: F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda e: e[value])
    span = begins.groupBy("_d").agg(F.min("_b").alias("_lo"), F.least(F.max(F.col("_b") + F.col("c")), F.lit(n)).alias("_hi"), in_order("sim", "_b").alias("_begins"))
    needed = materialise(span.where("_lo < _hi"), "needed")
    top = needed.agg(F.max("_d")).first()[0] or ""
    near = hashed(1 + all_ // DEALT).where(F.col("_d") <= top).select("_d", "sim", F.unhex("_h").alias("_h"), x)
    tasks = 1 + n * sims // DEALT  # with fewer than the session's, the join below would shuffle the labels again
    near = near.repartition(tasks, "_d") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else near.repartition("_d")
    taken = near.withColumn("_i", F.row_number().over(Window.partitionBy("_d", "sim").orderBy("_h")) - 1)

    piece = lambda rank: F.floor(rank / F.lit(SIDES))
    sides = ranked(observed.select("side", key), [dealt(seed, key), F.col(key)], "rn").groupBy(piece(F.col("rn")).alias("_p")).agg(in_order("rn", "side").alias("_s"))
    met = needed.withColumn("_p", F.explode(F.sequence(piece(F.col("_lo")), piece(F.col("_hi") - 1)))).join(sides, "_p")
    beside = met.groupBy("_d").agg(F.first("_begins").alias("_begins"), (F.min("_p") * SIDES).alias("_base"), F.flatten(in_order("_p", "_s")).alias("_sides"))
    paired = taken.join(beside, "_d").withColumn("rn", F.col("_i") + F.get("_begins", F.col("sim").cast("int"))).where(F.col("rn") < n)
    means = paired.select("sim", x, F.get("_sides", (F.col("rn") - F.col("_base")).cast("int")).alias("side")).groupBy("sim").agg(F.avg(F.col("side") * F.col(x)).alias("m"), F.count("*").alias("n"))
    own = observed.agg(F.avg(F.col("side") * F.col(x)).alias("own"))
    out = means.where(F.col("n") == n).crossJoin(F.broadcast(own)).agg(F.count("*").alias("sims"), F.count(F.when(F.col("m") < F.col("own"), 1)).alias("below"), F.count(F.when(F.col("m") == F.col("own"), 1)).alias("equal"))
    return out.select("sims", F.when(F.col("sims") > 0, 100 * (F.col("below") + 0.5 * F.col("equal")) / F.col("sims")).alias("percentile"))


def state_matrix(returns: DataFrame, top_k: int = 3) -> DataFrame:
    """Per state: count, total, mean, hit rate, the best state flagged with its share of the total and its top results' share.

    ``returns``: ``state, net``. Each task keeps no more than the ``top_k`` of each state before they meet.
    """
    w = Window.partitionBy("state").orderBy(F.desc("net"))
    top = returns.select("state", "net").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_k).groupBy(F.col("state").alias("of")).agg(F.sum("net").alias("top"))
    per = returns.groupBy("state").agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))
    per = per.join(top, F.col("state").eqNullSafe(F.col("of")), "left")
    all_states = Window.partitionBy()  # one row per state
    grand = F.sum("total").over(all_states)
    best = F.col("total") == F.max("total").over(all_states)
    return per.select("state", "n", "total", "mean", "hit_rate", best.alias("is_best"), (F.col("total") / F.when(grand != 0, grand)).alias("share"), (F.col("top") / F.when(F.col("total") != 0, F.col("total"))).alias("top_share"))


def state_support(matrix: DataFrame, states: Sequence[str], minimum: int) -> DataFrame:
    """Every declared state, and ``unknown``, with its count and a reason where it is too small to judge."""
    declared = matrix.sparkSession.createDataFrame([(s,) for s in [*states, "unknown"]], "state string")
    n = F.coalesce("n", F.lit(0))
    return declared.join(matrix.select("state", "n"), "state", "left").select("state", n.cast("long").alias("n"), F.when(n == 0, "no observations").when(n < minimum, "below minimum support").alias("reason"))


def degradation(baseline: DataFrame, recent: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule's metric: ``breach``, ``missing`` or ``ok``; the decline counts against the rule's direction."""
    b, r = baseline.select("metric", F.col("value").alias("base")), recent.select("metric", F.col("value").alias("now"))
    joined = rules.join(b, "metric", "left").join(r, "metric", "left")
    decline = F.when(F.col("direction") == ">=", F.col("base") - F.col("now")).otherwise(F.col("now") - F.col("base"))
    verdict = F.when(F.col("now").isNull() | F.col("base").isNull(), "missing").when(decline > F.col("limit"), "breach").otherwise("ok")
    return joined.select("metric", "base", "now", decline.alias("decline"), verdict.alias("verdict"))


def deviation(run: DataFrame, reference: DataFrame, by: str = "trial") -> DataFrame:
    """Each run's equity against a reference on equal marks: ``by``, mean and largest difference, tracking error, first widest mark, unmatched marks.

    ``run``: by, time, equity. ``reference``: time, equity. A mark that only one side has is unmatched.
    """
    n_marks = reference.agg(F.count("*").alias("n_marks"))  # one row
    d = run.select(by, "time", F.col("equity").alias("a")).join(reference.select("time", F.col("equity").alias("b")), "time", "left").withColumn("d", F.col("a") - F.col("b"))
    widest = F.max_by("time", F.when(F.col("d").isNotNull(), F.struct(F.abs("d"), -F.unix_micros("time"))))
    both = F.count("b")
    out = d.groupBy(by).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.max(F.abs("d")).alias("max_diff"), F.stddev_samp("d").alias("tracking_error"), widest.alias("widest_at"), (F.count("*") - both).alias("own"), both.alias("met"))
    return out.crossJoin(F.broadcast(n_marks)).select(by, "n", "mean_diff", "max_diff", "tracking_error", "widest_at", (F.col("own") + F.col("n_marks") - F.col("met")).alias("n_unmatched"))
