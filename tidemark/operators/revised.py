"""Features over bars that are revised: what a value was at each time, computed anew only where a revision touches it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import materialise


def over_revisions(revisions: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, minutes: int) -> DataFrame:
    """Values of a feature, or of a feature of features, over time: ``symbol, interval_start, valid_from, value``.

    ``revisions``: bars with ``symbol, interval_start, interval_end, available_time, revision_id``, several of one interval where it was revised; at a time the
    last one available counts (of equal times the largest id). ``compute`` adds ``value`` to bars by windows of ``symbol`` over at most ``back`` earlier intervals.

    A bar has a value from when it is available, from what is visible then, and a new one each time that a bar of its window arrives late or is
    revised. Nearly all bars see their window's first revisions and none other: one pass of plain windows serves them. Only the others are
    evaluated by themselves, at their times: each with its window in the revisions visible then, bars of one time together. So the work
    is one pass and a window for each revision, not a history for each time. Values that stay the same are given again.
    """
    step = minutes * 60_000_000
    order = F.struct("available_time", "revision_id")
    nth = F.row_number().over(Window.partitionBy("symbol", "interval_start").orderBy("available_time", "revision_id"))
    all_ = materialise(revisions.withColumn("_nth", nth), "bar-revisions")
    first = all_.where("_nth = 1").drop("_nth")
    second = all_.where("_nth = 2").select("symbol", "interval_start", F.col("available_time").alias("_second"))
    w = Window.partitionBy("symbol").orderBy(F.unix_micros("interval_start")).rangeBetween(-back * step, 0)
    seen = first.join(second, ["symbol", "interval_start"], "left").withColumns({"_late": F.max("available_time").over(w), "_early": F.min("_second").over(w)})
    plain = (F.col("_late") <= F.col("available_time")) & F.coalesce(F.col("_early") > F.col("available_time"), F.lit(True))
    seen = materialise(seen.select("symbol", "interval_start", "available_time", plain.alias("plain")), "bar-times")

    usual = compute(first).join(seen.where("plain").select("symbol", "interval_start"), ["symbol", "interval_start"], "left_semi")
    usual = usual.select("symbol", "interval_start", F.col("available_time").alias("valid_from"), "value")
    # times at which a bar's window changes after the bar is there: late first revisions and all later ones touch the bars after them
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.timestamp_micros(F.unix_micros("interval_start") + k * step)))
    touched = all_.select("symbol", ahead.alias("interval_start"), F.col("available_time").alias("at"))
    later = touched.join(seen.select("symbol", "interval_start", "available_time"), ["symbol", "interval_start"]).where("at > available_time").select("symbol", "interval_start", "at")
    due = later.unionByName(seen.where("not plain").select("symbol", "interval_start", F.col("available_time").alias("at"))).distinct()
    due = materialise(due, "evaluations")
    behind = F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.timestamp_micros(F.unix_micros("interval_start") - k * step)))
    context = due.select("symbol", "at", behind.alias("interval_start")).distinct()
    rows = F.struct(*[c for c in revisions.columns if c not in ("symbol", "interval_start")])
    visible = context.join(all_.drop("_nth"), ["symbol", "interval_start"]).where("available_time <= at").groupBy("symbol", "at", "interval_start").agg(F.max_by(rows, order).alias("_r"))
    keyed = visible.select(F.struct("symbol", "at").alias("symbol"), "interval_start", "_r.*")
    anew = compute(keyed).select(F.col("symbol.symbol").alias("symbol"), "interval_start", F.col("symbol.at").alias("at"), "value")
    anew = anew.join(due, ["symbol", "interval_start", "at"], "left_semi").select("symbol", "interval_start", F.col("at").alias("valid_from"), "value")
    return usual.unionByName(anew)


def values_at(values: DataFrame, at: str) -> DataFrame:
    """Of ``over_revisions`` the value of each bar as it was at a time: ``symbol, interval_start, value``."""
    known = values.where(F.col("valid_from") <= F.lit(at).cast("timestamp"))
    return known.groupBy("symbol", "interval_start").agg(F.max_by(F.struct("value"), "valid_from").alias("_v")).select("symbol", "interval_start", "_v.value")
