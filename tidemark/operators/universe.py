"""Listings, universe membership and quality reports.

Listings are ``symbol, observed_at, source_status`` rows; members have half-open spans ``[valid_from, valid_until)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import materialise
from tidemark.functions.windows import islands

SUSPENDED = ("HALT", "BREAK", "END_OF_DAY", "CANCEL_ONLY")


def classify(status: Column) -> Column:
    return F.when(status == "TRADING", "listed").when(status.isin(*SUSPENDED), "suspended").otherwise("unresolved")


def derive_chain(listings: DataFrame) -> DataFrame:
    """Status intervals per symbol: ``symbol, valid_from, valid_until, status, episode`` (open end: null).

    Rows at or after the first tie in time do not count, nor do rows before the first TRADING, nor unresolved ones. A new
    interval starts only where the mapped status changes; an episode at each return to listed after the first.
    """
    b = listings.withColumn("status", classify(F.col("source_status")))
    tie = F.count("*").over(Window.partitionBy("symbol", "observed_at"))
    w = Window.partitionBy("symbol")
    b = b.withColumn("_tie", tie).withColumn("_stop", F.min(F.when(F.col("_tie") > 1, F.col("observed_at"))).over(w))
    b = b.withColumn("_open", F.min(F.when(F.col("status") == "listed", F.col("observed_at"))).over(w))
    b = b.where("(_stop is null or observed_at < _stop) and observed_at >= _open and status <> 'unresolved'")
    o = w.orderBy("observed_at")
    changed = b.withColumn("_before", F.lag("status").over(o)).where("_before is null or _before <> status")
    out = changed.withColumns({"valid_until": F.lead("observed_at").over(o), "episode": F.sum(F.when(F.col("status") == "listed", 1).otherwise(0)).over(o)})
    return out.select("symbol", F.col("observed_at").alias("valid_from"), "valid_until", "status", "episode")


def listing_at(chain: DataFrame, wanted: DataFrame, at: str) -> DataFrame:
    """Each wanted symbol's standing at one time: ``symbol, constructible, reason``."""
    t = F.lit(at).cast("timestamp")
    now = chain.where((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))).groupBy("symbol").agg(F.count("*").alias("n"), F.max("status").alias("status"))
    ever = chain.groupBy("symbol").agg(F.min("valid_from").alias("first"))
    j = wanted.select("symbol").distinct().join(ever, "symbol", "left").join(now, "symbol", "left")
    reason = F.when(F.col("first").isNull(), "never observed").when(F.col("first") > t, "not yet observed").when(F.col("n").isNull(), "no status in force").when(F.col("n") > 1, "competing statuses").when(F.col("status") == "suspended", "suspended")
    return j.select("symbol", reason.isNull().alias("constructible"), reason.alias("reason"))


def members(chain: DataFrame, start: str, end: str) -> DataFrame:
    """Listed spans within a period, touching ones merged: ``symbol, valid_from, valid_until``."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    spans = chain.where("status = 'listed'").select("symbol", F.greatest("valid_from", s).alias("valid_from"), F.least(F.coalesce("valid_until", e), e).alias("valid_until")).where("valid_from < valid_until")
    return islands(spans, ["symbol"], "valid_from", "valid_until").select("symbol", "valid_from", "valid_until")


def exclusions(chain: DataFrame, start: str, end: str) -> DataFrame:
    """The other status spans of the period with their reason."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    spans = chain.where("status <> 'listed'").select("symbol", F.greatest("valid_from", s).alias("valid_from"), F.least(F.coalesce("valid_until", e), e).alias("valid_until"), F.col("status").alias("reason"))
    return spans.where("valid_from < valid_until")


def backfilled(member_spans: DataFrame, policy: DataFrame, floor: str) -> DataFrame:
    """Members with an assumed span from the floor to their first observation where the policy allows it: ``..., assumed``."""
    f = F.lit(floor).cast("timestamp")
    first = member_spans.groupBy("symbol").agg(F.min("valid_from").alias("first"))
    assumed = first.join(policy.where("backfill"), "symbol", "left_semi").where(F.col("first") > f).select("symbol", f.alias("valid_from"), F.col("first").alias("valid_until"), F.lit(True).alias("assumed"))
    return member_spans.withColumn("assumed", F.lit(False)).unionByName(assumed)


def gate_membership(selections: DataFrame, member_spans: DataFrame) -> DataFrame:
    """Selections cut to the spans in which their symbol is a member; overlaps by symbol."""
    m = member_spans.select("symbol", F.col("valid_from").alias("_mf"), F.col("valid_until").alias("_mu"))
    j = selections.join(m, "symbol").where((F.col("effective_from") < F.col("_mu")) & (F.col("effective_until") > F.col("_mf")))
    return j.withColumns({"effective_from": F.greatest("effective_from", "_mf"), "effective_until": F.least("effective_until", "_mu")}).drop("_mf", "_mu")


def bar_problems(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars with ``problems``: which of five rules each breaks, joined by commas (empty: none)."""
    o, h, l, c = (F.col(x).cast("double") for x in ("open", "high", "low", "close"))
    rules = F.array_compact(F.array(
        F.when(F.least(o, h, l, c) <= 0, "non_positive_price"), F.when((h < F.greatest(o, c)) | (l > F.least(o, c)), "crossed_range"),
        F.when(F.col("volume") < F.col("taker_buy_base_volume"), "taker_above_volume"), F.when(F.unix_micros("interval_start") % (minutes * 60_000_000) != 0, "misaligned_start"),
        F.when(F.col("trade_count") < 1, "no_trades"),
    ))
    return bars.withColumn("problems", F.concat_ws(",", rules))


def partition_report(bars: DataFrame, gaps: DataFrame, minutes: int) -> DataFrame:
    """Per symbol and day: bars, bars due, missing ones, problems, worst gap, completeness."""
    due = 1440 // minutes
    b = bar_problems(bars, minutes).groupBy("symbol", F.date_trunc("day", "interval_start").alias("day")).agg(F.count("*").alias("n_bars"), F.count(F.when(F.col("problems") != "", 1)).alias("n_problems"))
    g = gaps.groupBy("symbol", "day").agg(F.max("n_missing").alias("worst_gap"), F.sum("n_missing").alias("n_missing"))
    return b.join(g, ["symbol", "day"], "left").select("symbol", "day", "n_bars", "n_problems", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), F.coalesce("worst_gap", F.lit(0)).cast("long").alias("worst_gap"), (F.col("n_bars") / due).alias("completeness"))


#: Ids of both sides that a task of ``uncovered`` compares, about.
IDS = 1_000_000


def uncovered(raw: DataFrame, images: DataFrame, key: str, lineage: str) -> DataFrame:
    """Rows without their counterpart on the other side: ``id, side``.

    Each side's ids are written once and dealt by id to as many tasks as their number calls for: ids shrink so well in a shuffle that
    tasks told by its bytes would hold many millions of them.
    """
    left = materialise(raw.select(F.col(key).alias("id")), "raw")
    right = materialise(images.select(F.col(lineage).alias("id")), "images")
    tasks = 1 + (left.count() + right.count()) // IDS
    both = left.withColumn("_raw", F.lit(True)).unionByName(right.withColumn("_raw", F.lit(False))).repartition(tasks, "id")
    w = Window.partitionBy("id")
    alone = both.withColumn("_met", F.max("_raw").over(w) & ~F.min("_raw").over(w)).where(F.col("id").isNull() | ~F.col("_met"))
    return alone.select("id", F.when(F.col("_raw"), "raw without image").otherwise("image without raw").alias("side"))


def unsupported_claims(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Gap claims that cite no report of their own symbol and day."""
    return claims.join(reports.select("report_id", "symbol", "day"), ["report_id", "symbol", "day"], "left_anti")


def listing_report(listings: DataFrame, chain: DataFrame) -> DataFrame:
    """Per symbol: observations, unresolved ones, ties, intervals, episodes, and whether its chain is sound."""
    tie = F.count("*").over(Window.partitionBy("symbol", "observed_at"))
    o = listings.withColumn("_tie", tie).groupBy("symbol").agg(F.count("*").alias("n_observations"), F.count(F.when(classify(F.col("source_status")) == "unresolved", 1)).alias("n_unresolved"), F.count(F.when(F.col("_tie") > 1, 1)).alias("n_tied"))
    c = chain.groupBy("symbol").agg(F.count("*").alias("n_intervals"), F.max("episode").alias("n_episodes"))
    return o.join(c, "symbol", "left").select("symbol", "n_observations", "n_unresolved", "n_tied", F.coalesce("n_intervals", F.lit(0)).cast("long").alias("n_intervals"), F.coalesce("n_episodes", F.lit(0)).cast("long").alias("n_episodes"), (F.col("n_tied") == 0).alias("sound"))


PAIRED_BY = ["dataset", "knowledge_cutoff", "snapshot"]


#: Features and prices of the same data that meet in one share of ``pair_manifests``, about.
SIDE = 1000


def pair_manifests(manifests: DataFrame) -> DataFrame:
    """Feature and price manifests over the same data: ``feature_hash, price_hash``; all shared columns must be equal.

    A row for each pair, so features times prices of the same data. Both are counted first and tell the number of tasks, as few bytes make
    many pairs. Where the same data has many manifests, both sides are dealt to shares of it, and each share of one side is sent to all of the other.
    """
    n_of = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    same = materialise(manifests.groupBy(*PAIRED_BY).agg(n_of("feature").alias("_f"), n_of("price").alias("_p")).where("_f > 0 and _p > 0"), "paired")
    tasks = 1 + (same.agg(F.sum(F.col("_f") * F.col("_p"))).first()[0] or 0) // SIDE**2
    m = manifests.join(same.select(*PAIRED_BY, F.ceil(F.col("_f") / SIDE).alias("_fs"), F.ceil(F.col("_p") / SIDE).alias("_ps")), PAIRED_BY)
    one = lambda n: F.pmod(F.xxhash64("content_hash"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = m.where("kind = 'feature'").select(F.col("content_hash").alias("feature_hash"), *PAIRED_BY, F.col("until").alias("_fu"), one("_fs").alias("_i"), each("_ps").alias("_j"))
    b = m.where("kind = 'price'").select(F.col("content_hash").alias("price_hash"), *PAIRED_BY, F.col("until").alias("_pu"), each("_fs").alias("_i"), one("_ps").alias("_j"))
    share = [*PAIRED_BY, "_i", "_j"]
    return a.repartition(tasks, *share).join(b.repartition(tasks, *share), share).where("_pu >= _fu").select("feature_hash", "price_hash")


def pair_members(manifests: DataFrame) -> DataFrame:
    """The pairs of ``pair_manifests`` as a row for each manifest: its class (the shared columns and ``until``) and ``n_links``.

    A feature is paired with every price of the same shared columns whose ``until`` is not below its own, and ``n_links``
    counts the manifests on the other side, repetitions included. Classes are counted first; only these counts are summed along ``until``.
    """
    m = manifests.where("kind in ('feature', 'price')").select("content_hash", "kind", *PAIRED_BY, "until")
    is_ = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    classes = m.where(reduce(and_, [F.col(c).isNotNull() for c in [*PAIRED_BY, "until"]])).groupBy(*PAIRED_BY, "until").agg(is_("feature").alias("_f"), is_("price").alias("_p"))
    w = Window.partitionBy(*PAIRED_BY)
    sums = classes.withColumns({"_prices": F.sum("_p").over(w.orderBy(F.desc("until"))), "_features": F.sum("_f").over(w.orderBy("until"))}).drop("_f", "_p")
    n = F.when(F.col("kind") == "feature", F.col("_prices")).otherwise(F.col("_features"))
    return m.join(sums, [*PAIRED_BY, "until"], "left").select("content_hash", "kind", *PAIRED_BY, "until", F.coalesce(n, F.lit(0)).alias("n_links"))


def answered(pages: DataFrame, by: Sequence[str] = ("request",)) -> tuple[DataFrame, DataFrame]:
    """What stored pages answered of a request, merged, and the gaps between: two frames ``by, start, end``."""
    merged = islands(pages, list(by), "start", "end").drop("n_spans")
    w = Window.partitionBy(*by).orderBy("start")
    gaps = merged.withColumn("_next", F.lead("start").over(w)).where("_next is not null").select(*by, F.col("end").alias("start"), F.col("_next").alias("end"))
    return merged, gaps
