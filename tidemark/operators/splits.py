"""Time-series splits: walk-forward windows, purged folds, sealed periods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import materialise
from tidemark.operators.statistics import ranked, within


def walk_forward_windows(rows: DataFrame, train_days: int, test_days: int, step_days: int, start: str = "start", end: str = "end") -> DataFrame:
    """``window_no, train_start, test_start, test_end``: windows over the time that the rows cover, as far as they fit.

    The first begins with the day of the earliest start; none ends after the day of the latest end.
    """
    covered = rows.agg(F.date_trunc("day", F.min(start)).alias("a"), F.date_trunc("day", F.max(end)).alias("z")).where("a is not null")
    out = covered.select("z", F.posexplode(F.sequence("a", "z", F.expr(f"interval {step_days} days"))).alias("window_no", "train_start"))
    out = out.withColumn("test_start", F.col("train_start") + F.expr(f"interval {train_days} days")).withColumn("test_end", F.col("test_start") + F.expr(f"interval {test_days} days"))
    return out.where("test_end <= z").drop("z")


def purge_label(start: Column, end: Column, test_start: Column, test_end: Column, embargo_s: int) -> Column:
    """``test``, ``purged`` (overlaps the test period), ``embargoed`` (starts within the embargo after it) or ``train``."""
    inside = (start >= test_start) & (start < test_end)
    after = (start >= test_end) & (start < test_end + F.make_interval(secs=F.lit(embargo_s)))
    return F.when(inside, "test").when((start < test_end) & (end > test_start), "purged").when(after, "embargoed").otherwise("train")


def walk_forward(spans: DataFrame, windows: DataFrame, embargo_s: int = 0) -> DataFrame:
    """Every window's rows, ``window_no, key, start, end, role``: training from train_start on, purged and embargoed around the test.

    Spans meet the windows that their start falls into by day buckets.
    """
    joined = within(spans, "start", windows, "train_start", "test_end")
    return joined.select("window_no", "key", "start", "end", purge_label(F.col("start"), F.col("end"), F.col("test_start"), F.col("test_end"), embargo_s).alias("role"))


def _fold_starts(spans: DataFrame, k: int) -> DataFrame:
    """One row ``_cuts``: ``(start, key)`` of the first span of each fold but the first, as an array in order.

    Days are counted, and only the spans of the at most k - 1 days in which a fold begins are ranked.
    """
    day = F.coalesce(F.unix_date(F.to_date("start")), F.lit(-(2**31)))
    sizes = spans.groupBy(day.alias("day")).agg(F.count("*").alias("c"))
    days = materialise(sizes.withColumn("b", F.sum("c").over(Window.orderBy("day")) - F.col("c")), "days")  # a row a day
    size, more = divmod(days.agg(F.sum("c")).first()[0] or 0, k)
    firsts = [f * size + min(f, more) for f in range(1, k) if size or f < more]
    begun = F.exists(F.array(*[F.lit(x) for x in firsts]), lambda x: (x >= F.col("b")) & (x < F.col("b") + F.col("c"))) if firsts else F.lit(False)
    chosen = days.where(begun).orderBy("day").collect()  # k - 1 rows
    before = {}
    for d in chosen:
        before[d.day] = d.b - sum(e.c for e in chosen if e.day < d.day)
    near = ranked(spans.where(day.isin(list(before))).select("start", "key"), [F.col("start"), F.col("key")], "_i")
    place = F.col("_i") + F.coalesce(*[F.when(day == d, F.lit(b)) for d, b in before.items()], F.lit(0))
    return near.where(place.isin(firsts)).agg(F.array_sort(F.collect_list(F.struct("start", "key"))).alias("_cuts"))


def fold_of(spans: DataFrame, k: int) -> DataFrame:
    """Spans with ``fold`` 0..k-1 in ``(start, key)`` order, the first folds one larger. No two spans may have the same start and key.

    Nothing is numbered or sorted as a whole: the folds' first spans are found (``_fold_starts``), and each span is compared with them.
    """
    spans = materialise(spans, "spans")  # read for the days, the days' spans, and the rows
    cuts = F.broadcast(materialise(_fold_starts(spans, k), "cuts"))  # one row
    reached = [F.coalesce((F.get("_cuts", F.lit(i)) <= F.struct("start", "key")).cast("int"), F.lit(0)) for i in range(k - 1)]
    return spans.crossJoin(cuts).withColumn("fold", reduce(add, reached, F.lit(0))).drop("_cuts")


def _folds_and_tests(spans: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    placed = fold_of(spans.select("start", "end", "key"), k)
    tests = placed.groupBy(F.col("fold").alias("test_fold")).agg(F.min("start").alias("test_start"), F.max("end").alias("test_end"))
    return placed, materialise(tests, "tests")  # k rows


def _fold_role(test: Callable[[str], Column], embargo_s: int) -> Column:
    start, end, first, last = F.col("start"), F.col("end"), test("test_start"), test("test_end")
    label = F.when(F.col("fold") == test("test_fold"), "test").when((start < last) & (end > first), "purged")
    return label.when((start >= last) & (start < last + F.make_interval(secs=F.lit(embargo_s))), "embargoed").otherwise("train")


def purged_k_fold(spans: DataFrame, k: int, embargo_s: int = 0) -> DataFrame:
    """``fold, key, role`` for every span and fold: test, purged, embargoed or train.

    The k test periods are one row each and are broadcast. A fold's test period runs from its first start to its last end.
    """
    placed, tests = _folds_and_tests(spans, k)
    return placed.crossJoin(F.broadcast(tests)).select(F.col("test_fold").alias("fold"), "key", _fold_role(F.col, embargo_s).alias("role"))


def fold_summary(spans: DataFrame, k: int, embargo_s: int = 0) -> DataFrame:
    """``fold, role, n, first_key`` of ``purged_k_fold``: spans are counted as they pass.

    Grouping by fold and role would sort k rows a span, as the least text of a group is not kept in a hash table; one row of aggregates needs no sort.
    """
    placed, tests = _folds_and_tests(spans, k)
    rows = placed.crossJoin(F.broadcast(tests.agg(F.array_sort(F.collect_list(F.struct("test_fold", "test_start", "test_end"))).alias("_tests"))))
    rows = rows.select("key", *[F.when(F.get("_tests", F.lit(i)).isNotNull(), _fold_role(lambda c, i=i: F.get("_tests", F.lit(i))[c], embargo_s)).alias(f"_{i}") for i in range(k)])
    asked = [(i, role) for i in range(k) for role in ("test", "purged", "embargoed", "train")]
    is_ = lambda i, role: F.col(f"_{i}") == role
    one = rows.agg(*[F.count(F.when(is_(*a), 1)).alias(f"n_{a[0]}_{a[1]}") for a in asked], *[F.min(F.when(is_(*a), F.col("key"))).alias(f"key_{a[0]}_{a[1]}") for a in asked])
    cells = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"), F.col(f"n_{i}_{role}").alias("n"), F.col(f"key_{i}_{role}").alias("first_key")) for i, role in asked])
    return one.select(F.inline(cells)).where("n > 0")


def research_spans(spans: DataFrame, first: str, boundary: str) -> DataFrame:
    """Spans that start in the research window and end before the sealed boundary."""
    b = F.lit(boundary).cast("timestamp")
    return spans.where((F.col("start") >= F.lit(first).cast("timestamp")) & (F.col("start") < b) & (F.col("end") < b))


def sealed(rows: DataFrame, ledger: DataFrame, boundary: str, time: str = "start", family: str = "family") -> DataFrame:
    """Rows before the boundary, and later ones of families that the ledger unseals exactly once."""
    once = ledger.groupBy(family).agg(F.count("*").alias("n")).where("n = 1").select(family)
    b = F.lit(boundary).cast("timestamp")
    return rows.where(F.col(time) < b).unionByName(rows.where(F.col(time) >= b).join(once, family, "left_semi").select(*rows.columns))


def decision_grid(bars: DataFrame, step_s: int, warmup_s: int, horizon_s: int, by: str = "symbol") -> DataFrame:
    """Decision times ``start + warmup + k * step`` whose horizon lies in the data: ``by, decision_time``."""
    ends = bars.groupBy(by).agg(F.unix_micros(F.min("interval_start")).alias("a"), F.unix_micros(F.max("interval_end")).alias("b"))
    first, last, step = F.col("a") + warmup_s * 1_000_000, F.col("b") - horizon_s * 1_000_000, step_s * 1_000_000
    usable = ends.where(first <= last)
    return usable.select(by, F.explode(F.sequence(first, last, F.lit(step))).alias("us")).select(by, F.timestamp_micros("us").alias("decision_time"))
