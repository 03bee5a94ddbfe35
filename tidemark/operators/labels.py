"""Forward-looking labels: entry bars, forward returns, barrier touches. Labels are outputs, never inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import materialise, ship
from tidemark.functions.windows import asof, with_runs

#: Positions of a run that are looked through together for touches.
STRETCH = 4096


def numbered_bars(bars: DataFrame) -> DataFrame:
    """Bars with ``run_id`` and ``no``, their position in the run, written once for all that read them."""
    no = F.row_number().over(Window.partitionBy("symbol", "run_id").orderBy("interval_start"))
    return materialise(with_runs(bars).withColumn("no", no), "bars")


def entry_bars(events: DataFrame, bars: DataFrame, bar_minutes: int) -> DataFrame:
    """Each event with its instrument's first bar that starts at or after it; none that starts a whole bar late.

    The columns of ``events`` (among them ``symbol, event_key, event_time``) with ``entry_start, entry_open, entry_run,
    entry_no`` (position of the bar in its run). One backward sort over the union of events and bars.
    """
    return _entries(events, numbered_bars(bars), bar_minutes)


def _entries(events: DataFrame, numbered: DataFrame, bar_minutes: int) -> DataFrame:
    bar = F.struct("interval_start", F.col("open").cast("double").alias("open"), "run_id", "no")
    kind = numbered.select(bar.alias("b")).schema["b"].dataType
    e = events.select("symbol", F.col("event_time").alias("t"), F.struct("*").alias("event"), F.lit(None).cast(kind).alias("bar"), F.lit(0).alias("side"))
    b = numbered.select("symbol", F.col("interval_start").alias("t"), F.lit(None).cast(e.schema["event"].dataType).alias("event"), bar.alias("bar"), F.lit(1).alias("side"))
    # sorted backwards: a frame that only grows is extended row by row, one that shrinks is read again for each row
    ahead = Window.partitionBy("symbol").orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    found = e.unionByName(b).withColumn("found", F.last("bar", ignorenulls=True).over(ahead)).where("side = 0")
    late = F.unix_micros("found.interval_start") - F.unix_micros("event.event_time") >= bar_minutes * 60_000_000
    f = F.when(~late, F.col("found"))
    return found.select("event.*", f["interval_start"].alias("entry_start"), f["open"].alias("entry_open"), f["run_id"].alias("entry_run"), f["no"].alias("entry_no"))


def label_windows(events: DataFrame, bars: DataFrame, bar_minutes: int, horizon_bars: int) -> DataFrame:
    """``entry_bars`` with ``exit_close, exit_end, known_at`` of the last of ``horizon_bars`` gap-free bars, or nulls.

    A window is gap-free if its last bar is the right number of positions further in the same run, so one equi-join
    finds it. ``known_at`` is when all its bars are available.
    """
    return _windows(events, numbered_bars(bars), bar_minutes, horizon_bars)


def _windows(events: DataFrame, numbered: DataFrame, bar_minutes: int, horizon_bars: int) -> DataFrame:
    w = Window.partitionBy("symbol", "run_id").orderBy("interval_start").rowsBetween(-(horizon_bars - 1), 0)
    ends = numbered.withColumn("known", F.max("available_time").over(w))
    ends = ends.select("symbol", F.col("run_id").alias("entry_run"), (F.col("no") - (horizon_bars - 1)).alias("entry_no"), F.col("close").cast("double").alias("exit_close"), F.col("interval_end").alias("exit_end"), F.col("known").alias("known_at"))
    return _entries(events, numbered, bar_minutes).join(ends, ["symbol", "entry_run", "entry_no"], "left")


def forward_return(events: DataFrame, bars: DataFrame, bar_minutes: int, horizon_bars: int) -> DataFrame:
    """``symbol, event_key, event_time, label, known_at``: exit close over entry open, less 1; null on a gap or at the end."""
    out = label_windows(events, bars, bar_minutes, horizon_bars)
    return out.select("symbol", "event_key", "event_time", (F.col("exit_close") / F.col("entry_open") - 1).alias("label"), "known_at")


def _first_touches(asked: DataFrame, path: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """``row, touch``: the first of the ``horizon`` bars from ``no`` on whose low or high reaches ``lo`` or ``hi``.

    Positions of a run are cut into stretches, each with the horizon after it, so a long run is many tasks. Within
    one, tables hold the lowest low, highest high and latest availability of 2^k bars from each on; from
    the largest k down, an event steps over 2^k bars that hold no touch. All events step together.
    """
    ship(asked.sparkSession)
    width = max(STRETCH, horizon)
    stretch = lambda no: F.floor(no / F.lit(width))
    events = asked.withColumn("stretch", stretch(F.col("no")))
    bars = path.withColumn("stretch", F.explode(F.sequence(stretch(F.col("no") - (horizon - 1)), stretch(F.col("no")))))

    def find(events: pa.Table, bars: pa.Table) -> pa.Table:
        e = {c: events.column(c).to_numpy() for c in ("row", "no", "hi", "lo")}
        order = np.argsort(bars.column("no").to_numpy(), kind="stable")
        b = {c: bars.column(c).to_numpy(zero_copy_only=False)[order] for c in ("no", "open", "high", "low", "available")}
        tables = [(b["low"].astype(float), b["high"].astype(float), b["available"].astype(np.int64))]
        while 2 ** len(tables) <= horizon and 2 ** len(tables) <= len(order):
            half, (lows, highs, times) = 2 ** (len(tables) - 1), tables[-1]
            tables.append((np.fmin(lows[:-half], lows[half:]), np.fmax(highs[:-half], highs[half:]), np.maximum(times[:-half], times[half:])))
        begin = np.searchsorted(b["no"], e["no"])
        passed, known = np.zeros(len(begin), np.int64), np.full(len(begin), np.iinfo(np.int64).min)
        for k in reversed(range(len(tables))):
            lows, highs, times = tables[k]
            at = np.minimum(begin + passed, len(lows) - 1)
            free = (passed + 2**k <= horizon) & (begin + passed < len(lows)) & ~(lows[at] <= e["lo"]) & ~(highs[at] >= e["hi"])
            passed += np.where(free, 2**k, 0)
            known = np.where(free, np.maximum(known, times[at]), known)
        hit = np.flatnonzero((passed < horizon) & (begin + passed < len(order)))
        at = (begin + passed)[hit]
        down = b["low"][at] <= e["lo"][hit]
        price = np.where(down, np.minimum(b["open"][at], e["lo"][hit]), np.maximum(b["open"][at], e["hi"][hit]))
        return pa.table({"row": e["row"][hit], "price": price, "side": np.where(down, -1, 1).astype(np.int32), "known": np.maximum(known[hit], b["available"][at])})

    keys = [*by, "stretch"]
    found = events.groupBy(*keys).cogroup(bars.groupBy(*keys)).applyInArrow(find, "row long, price double, side int, known long")
    return found.select("row", F.struct("price", "side", F.timestamp_micros("known").alias("known")).alias("touch"))


def triple_barrier(events: DataFrame, bars: DataFrame, bar_minutes: int, horizon_bars: int, upper: float, lower: float, volatility: str | None = None) -> DataFrame:
    """First touch within the window: ``label`` (return), ``side`` (1 upper, -1 lower, 0 time), ``known_at``.

    Barriers are ``entry_open * (1 + upper)`` and ``* (1 - lower)``, times the event's ``volatility`` column if one is
    named. A window with a gap has no label, whatever it touched. A bar that touches both counts as lower. A bar that opens
    beyond a barrier is left at its open. Without a touch the label is the return to the last close. A null volatility
    gives a null label; one that is not positive is an error row: ``side`` and ``label`` null, ``problem`` set.

    Every row of ``events`` is labelled by itself, also where symbols share a key or a row is repeated. Bars are numbered
    and written once; events and bars meet by run and stretch of positions, and ``_first_touches`` finds each
    event's touch by extremes over 2, 4, 8, ... bars: the work grows with the logarithm of the horizon.
    """
    numbered = numbered_bars(bars)
    entries = _windows(events, numbered, bar_minutes, horizon_bars)
    scale = F.col(volatility).cast("double") if volatility else F.lit(1.0)
    entries = entries.select("symbol", "event_key", "event_time", "entry_open", "entry_run", "entry_no", "exit_close", "known_at", scale.alias("vol"), F.monotonically_increasing_id().alias("row"))
    entries = materialise(entries, "label-entries")  # row numbers drawn once
    asked = entries.where("exit_close is not null and vol > 0").select(
        "row", "symbol", "entry_run", F.col("entry_no").cast("long").alias("no"), (F.col("entry_open") * (1 + upper * F.col("vol"))).alias("hi"), (F.col("entry_open") * (1 - lower * F.col("vol"))).alias("lo")
    )
    path = numbered.select("symbol", F.col("run_id").alias("entry_run"), F.col("no").cast("long").alias("no"), F.unix_micros("available_time").alias("available"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low")])
    touched = _first_touches(asked, path, ["symbol", "entry_run"], horizon_bars)
    out = entries.join(touched, "row", "left")
    good = F.col("exit_close").isNotNull() & (F.col("vol") > 0)
    label = F.coalesce(F.col("touch.price"), F.col("exit_close")) / F.col("entry_open") - 1
    return out.select(
        "symbol", "event_key", "event_time", F.when(good, label).alias("label"), F.when(good, F.coalesce("touch.side", F.lit(0))).alias("side"),
        F.when(good, F.coalesce("touch.known", "known_at")).alias("known_at"), F.when(F.col("vol") <= 0, "volatility is not positive").alias("problem"),
    )


def materialise_labels(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Checks of a label table against the events asked for, one row: events, labels, missing, repeated, unasked, null."""
    asked = events.select("event_key").distinct()
    got = labels.groupBy("event_key").agg(F.count("*").alias("n"), F.count("label").alias("known"))
    both = asked.withColumn("asked", F.lit(1)).join(got, "event_key", "full")
    return both.agg(
        F.count("asked").alias("n_events"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_labels"), F.count(F.when(F.col("n").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"), F.count(F.when(F.col("asked").isNull(), 1)).alias("n_unasked"), F.count(F.when(F.col("known") < F.col("n"), 1)).alias("n_null"),
    )


def volatility_at_entry(events: DataFrame, features: DataFrame, value: str, by: str = "symbol", max_age_seconds: float | None = None) -> DataFrame:
    """Events with the latest feature value at or before their time."""
    return asof(events, features, [by], "event_time", "available_time", value, max_age_seconds)


def known_as_of(labels: DataFrame, at: str) -> DataFrame:
    return labels.where(F.col("known_at") <= F.lit(at).cast("timestamp"))


def refuse_labels(df: DataFrame, names: set[str]) -> DataFrame:
    """The frame itself, unless it has a label column: labels never become inputs. Checked on the schema, before any job."""
    found = sorted(names & set(df.columns))
    if found:
        raise ValueError(f"label columns used as inputs: {found}")
    return df
