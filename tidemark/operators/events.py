"""Point-event operators: sequence, co-occurrence, absence, counts, shifts, and statistics of event series.

Events are ``key, event_id, event_time`` rows; times of events refer to one key. Windows are in seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import greedy_walk, in_blocks, running_sum

US = 1_000_000


def _tagged(**sides: DataFrame) -> DataFrame:
    out = None
    for name, df in sides.items():
        one = df.select("key", "event_id", "event_time", F.lit(name).alias("side"), F.unix_micros("event_time").alias("us"))
        out = one if out is None else out.unionByName(one)
    return out


def _latest(side: str, frame):
    """The latest row of a side in the frame, as a struct; of equal times the larger id."""
    return F.max(F.when(F.col("side") == side, F.struct("us", "event_id"))).over(frame)


def _so_far(last: int):
    """All rows of a key up to now (0) or strictly before (-1): a frame that only grows, so each row is read once. Whether the
    latest of them lies within a window is asked afterwards."""
    return Window.partitionBy("key").orderBy("us").rangeBetween(Window.unboundedPreceding, last)


def sequence(first: DataFrame, then: DataFrame, window_s: int) -> DataFrame:
    """Each ``then`` with the latest ``first`` strictly before it and at most the window away: ``key, event_id, event_time, first_id, gap_seconds``.

    One window over the union of both sides; no pairs are made.
    """
    both = _tagged(first=first, then=then).withColumn("hit", _latest("first", _so_far(-1)))
    near = both.where("side = 'then'").where(F.col("us") - F.col("hit.us") <= window_s * US)
    return near.select("key", "event_id", "event_time", F.col("hit.event_id").alias("first_id"), ((F.col("us") - F.col("hit.us")) / US).alias("gap_seconds"))


def sequence_in_bars(first: DataFrame, then: DataFrame, n_bars: int, bar_s: int, lag_s: int) -> DataFrame:
    """The sequence on occurrence times (event time less the observable lag), at most ``n_bars`` bars apart, at least one."""
    shift = F.expr(f"interval {lag_s} seconds")
    moved = [df.withColumn("event_time", F.col("event_time") - shift) for df in (first, then)]
    out = sequence(*moved, n_bars * bar_s).where(F.col("gap_seconds") >= bar_s)
    return out.withColumn("event_time", F.col("event_time") + shift)


def co_occurrence(left: DataFrame, right: DataFrame, window_s: int) -> DataFrame:
    """Each event of either side with the latest of the other at or before it within the window; a tie in time counts once.

    ``key, event_id, event_time, other_id``: of two events at one time the right one is kept.
    """
    both = _tagged(left=left, right=right).withColumns({"l": _latest("left", _so_far(0)), "r": _latest("right", _so_far(0))})
    hit = F.when(F.col("side") == "left", F.col("r")).otherwise(F.col("l"))
    found = both.withColumn("hit", hit).where(F.col("us") - F.col("hit.us") <= window_s * US).where(~((F.col("side") == "left") & (F.col("hit.us") == F.col("us"))))
    return found.select("key", "event_id", "event_time", F.col("hit.event_id").alias("other_id"))


def absence(anchor: DataFrame, absent: DataFrame, window_s: int) -> DataFrame:
    """Anchors without an ``absent`` event in the window up to and including them."""
    both = _tagged(anchor=anchor, absent=absent).withColumn("last", F.max(F.when(F.col("side") == "absent", F.col("us"))).over(_so_far(0)))
    return both.where("side = 'anchor'").where(F.col("last").isNull() | (F.col("us") - F.col("last") > window_s * US)).select("key", "event_id", "event_time")


def window_end(events: DataFrame, window_s: int) -> DataFrame:
    """Each event at the end of its window."""
    return events.withColumn("event_time", F.col("event_time") + F.expr(f"interval {window_s} seconds"))


def not_followed(a: DataFrame, b: DataFrame, window_s: int) -> DataFrame:
    """Events A without a B from A to the end of its window; the event is that end."""
    return absence(window_end(a, window_s), b, window_s)


def at_least(events: DataFrame, n: int, window_s: int) -> DataFrame:
    """Events with at least ``n`` events in the window up to them: ``key, event_id, event_time, n_events, first_id, first_time``.

    What a row cites are its key's ``n_events`` events from the first one named to itself; as a list in each row they would
    take the square of a dense key's events.
    """
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-window_s * US, 0)
    b = _tagged(e=events).withColumns({"n_events": F.count("*").over(w), "_first": F.min(F.struct("event_time", "event_id")).over(w)})
    return b.where(F.col("n_events") >= n).select("key", "event_id", "event_time", "n_events", F.col("_first.event_id").alias("first_id"), F.col("_first.event_time").alias("first_time"))


def latest(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the candidates of each key the latest, by time and then by id, whole."""
    rest = [c for c in candidates.columns if c not in by]
    top = candidates.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("event_time", "event_id")).alias("_top"))
    return top.select(*by, *[F.col("_top")[c].alias(c) for c in rest])


def lead_lag(a: DataFrame, b: DataFrame, max_lag_s: int, bin_s: int, partitions: int | None = None) -> DataFrame:
    """Histogram of ``B - A`` over pairs at most ``max_lag_s`` apart: ``bin, n``; the last bin holds the upper end.

    No pair is made. A bin's count is how many B stand before its end less how many stand before its begin, summed over A; so each
    A asks once for each edge, and a running count over both sides' times answers. A busy key is counted block by block.
    """
    n_bins, reach = -(-2 * max_lag_s // bin_s), max_lag_s * US
    shift = F.when(F.col("edge") == n_bins, F.lit(reach + 1)).otherwise(F.col("edge") * (bin_s * US) - reach)
    edges = a.select("key", F.unix_micros("event_time").alias("us"), F.explode(F.sequence(F.lit(0), F.lit(n_bins))).alias("edge"))
    asked = edges.select("key", (F.col("us") + shift).alias("us"), "edge", F.lit(0).cast("long").alias("one"))
    both = asked.unionByName(b.select("key", F.unix_micros("event_time").alias("us"), F.lit(n_bins + 1).alias("edge"), F.lit(1).cast("long").alias("one")))
    counted = running_sum(in_blocks(both, ["key"], ["us", "edge"], partitions), "one", "before", "long").rows  # at one time the asking stand first
    # what is before edge k counts for the bin that ends there and against the one that begins there
    told = counted.where(F.col("edge") <= n_bins).groupBy("edge").agg(F.sum("before").alias("n"))
    signed = told.select((F.col("edge") - 1).alias("bin"), "n").unionByName(told.select(F.col("edge").alias("bin"), (-F.col("n")).alias("n")))
    return signed.where((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.sum("n").alias("n")).where("n > 0")


def frequency(events: DataFrame, start: str, end: str, bucket_s: int) -> DataFrame:
    """Events per bucket from ``start`` to ``end``, empty buckets included: ``bucket, n, total, per_day``."""
    s, e = F.unix_micros(F.lit(start).cast("timestamp")), F.unix_micros(F.lit(end).cast("timestamp"))
    spark = events.sparkSession
    bounds = spark.range(1).select(s.alias("s"), e.alias("e"))
    grid = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("e") - F.col("s")) / F.lit(bucket_s * US)).cast("long") - 1)).alias("bucket"))
    t = F.unix_micros("event_time")
    inside = events.where((t >= s) & (t < e)).groupBy(F.floor((t - s) / F.lit(bucket_s * US)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    days = (e - s) / F.lit(86_400 * US)
    filled = grid.join(inside, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per bucket of the period
    return filled.select("bucket", "n", total.alias("total"), (total / days).alias("per_day"))


def co_occurrence_lift(a: DataFrame, b: DataFrame, window_s: int, start: str, end: str) -> DataFrame:
    """How many A have a B within the window on either side, what a Poisson B of the same rate would give, and the ratio. One row."""
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-window_s * US, window_s * US)
    both = _tagged(a=a, b=b).withColumns({"near_b": F.count(F.when(F.col("side") == "b", 1)).over(w), "near_a": F.count(F.when(F.col("side") == "a", 1)).over(w)})
    span = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(US)
    keys = both.groupBy("key").agg(
        F.count(F.when(F.col("side") == "a", 1)).alias("n_a"), F.count(F.when(F.col("side") == "b", 1)).alias("n_b"),
        F.count(F.when((F.col("side") == "a") & (F.col("near_b") > 0), 1)).alias("a_near_b"), F.count(F.when((F.col("side") == "b") & (F.col("near_a") > 0), 1)).alias("b_near_a"),
    )
    expected = F.col("n_a") * (1 - F.exp(-F.col("n_b") * 2 * window_s / span))
    return keys.agg(F.sum("a_near_b").alias("a_near_b"), F.sum("b_near_a").alias("b_near_a"), F.sum(expected).alias("expected")).withColumn("lift", F.col("a_near_b") / F.when(F.col("expected") != 0, F.col("expected")))


def overlap(events: DataFrame, horizon_s: int) -> DataFrame:
    """Per key: events, neighbours nearer than the horizon, mean gap in seconds and dispersion of the gaps."""
    w = Window.partitionBy("key").orderBy("event_time", "event_id")
    gaps = events.withColumn("gap", (F.unix_micros("event_time") - F.unix_micros(F.lag("event_time").over(w))) / F.lit(float(US)))
    mean = F.avg("gap")
    return gaps.groupBy("key").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("gap") < horizon_s, 1)).alias("n_close"), mean.alias("mean_gap"), (F.var_pop("gap") / F.when(mean != 0, mean * mean)).alias("dispersion")
    )


def independent_count(events: DataFrame, horizon_s: int, partitions: int | None = None) -> DataFrame:
    """Per key, how many events a greedy walk keeps that skips all within the horizon of the last kept: ``key, n_independent``.

    The walk is that of volume bars, along time instead of volume: a busy key is walked block by block.
    """
    times = events.select("key", F.unix_micros("event_time").alias("us"))
    walked = greedy_walk(in_blocks(times, ["key"], ["us"], partitions), "us", horizon_s * US, None).rows
    return walked.groupBy("key").agg(F.count_if("kept").alias("n_independent"))
