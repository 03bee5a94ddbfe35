"""Rows in blocks: what depends on earlier rows of a key is carried from block to block, so that no key is one task's.

A block is a range partition by key and order, written once. All but the first and the last key of a block lie inside it. What
those two hand on is summarised per block, the summaries of a key are folded in order (a row for each block that the key
meets), and each block is then worked through with what the blocks before it leave.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Context, Decimal, setcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.functions.session import materialise, ship


def in_ranges(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Rows in range partitions ``_rk_part`` by ``_rk_o``, written once: bounds are sampled, and all readers must see the same."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = df.withColumn("_rk_o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])).repartitionByRange(n, "_rk_o")
    return materialise(split.withColumn("_rk_part", F.spark_partition_id()), "ranges")


#: Rows of a key from which on it is cut into blocks.
BUSY = 1_000_000


@dataclass(frozen=True)
class Blocks:
    """Rows with the number ``_block`` of their block, dealt by it, so that windows and groups within blocks need no further shuffle.

    ``whole``: no key meets two blocks, so nothing has to be carried from one to another. ``ranged``: blocks are ranges of keys, so all but
    two keys of a block lie inside it, which ``carried`` builds on.
    """

    rows: DataFrame
    by: Sequence[str]
    order: Sequence[str]
    whole: bool = False
    ranged: bool = True

    def but(self, rows: DataFrame) -> Blocks:
        return replace(self, rows=rows)

    @property
    def window(self):
        return Window.partitionBy("_block", *self.by).orderBy(*self.order)


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], partitions: int | None = None) -> Blocks:
    """Rows in blocks: range partitions by key and order. While no key has more than ``BUSY`` rows, keys stay whole and are
    dealt by hash, which costs no write. ``partitions`` asks for so many ranges in any case."""
    if partitions is None:
        largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest <= BUSY:
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return Blocks(df.withColumn("_block", F.pmod(F.hash(*by), F.lit(n))).repartition("_block"), by, order, True)
    ranges = in_ranges(df, [F.col(c) for c in [*by, *order]], partitions)
    return Blocks(ranges.drop("_rk_o").withColumnRenamed("_rk_part", "_block").repartition("_block"), by, order)


def time_blocks(df: DataFrame, by: Sequence[str], order: str, width_us: int) -> Blocks:
    """Rows in blocks of time, the same for all keys: no count, sample or write comes before, and a busy key is as many tasks as it has blocks."""
    return Blocks(df.withColumn("_block", F.floor(F.unix_micros(order) / F.lit(width_us))), by, [order], ranged=False)


def from_before(blocks: Blocks, agg: Column, over: Callable[[Column, object], Column], name: str) -> DataFrame:
    """Each row with ``name``: what ``over(agg of a block, window of the key's blocks before)`` gives.

    The aggregates are one row for each key and block. Only keys that meet several blocks have blocks before; of ranges, their rows
    are written, so that Spark knows how few they are; of blocks of time, adaptive execution learns it from the aggregation's shuffle.
    """
    parts = blocks.rows.groupBy("_block", *blocks.by).agg(agg.alias("_agg"))
    w = Window.partitionBy(*blocks.by).orderBy("_block")
    before = parts.withColumn(name, over(F.col("_agg"), w)).where(F.col(name).isNotNull()).select("_block", *[F.col(c).alias(f"_by_{c}") for c in blocks.by], name)
    before = (materialise(before, "before") if blocks.ranged else before).withColumnRenamed("_block", "_of")
    same = F.col("_block") == F.col("_of")
    for c in blocks.by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return blocks.rows.join(before, same, "left").drop("_of", *[f"_by_{c}" for c in blocks.by])


def previous(blocks: Blocks, columns: dict[str, str]) -> Blocks:
    """Adds columns ``{new: old}`` with the values of the key's row before, across blocks."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    last = F.lag(packed).over(blocks.window)
    rows = blocks.rows
    if not blocks.whole:
        at = F.struct(*blocks.order) if len(blocks.order) > 1 else F.col(blocks.order[0])
        rows = from_before(blocks, F.max_by(packed, at), lambda a, w: F.lag(a).over(w), "_last")
        last = F.coalesce(last, F.col("_last"))
    return blocks.but(rows.withColumn("_last", last).withColumns({n: F.col("_last")[n] for n in columns}).drop("_last"))


def latest(blocks: Blocks, value: str, name: str) -> Blocks:
    """Adds the last ``value`` that is not null of the key's rows up to each one, across blocks."""
    own = F.last(value, ignorenulls=True).over(blocks.window.rowsBetween(Window.unboundedPreceding, 0))
    if blocks.whole:
        return blocks.but(blocks.rows.withColumn(name, own))
    known = F.when(F.col(value).isNotNull(), F.struct(*blocks.order))
    joined = from_before(blocks, F.max_by(value, known), lambda a, w: F.last(a, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_before")
    return blocks.but(joined.withColumn(name, F.coalesce(own, "_before")).drop("_before"))


def running_sum(blocks: Blocks, value: str, name: str, kind: str = "decimal(38,18)") -> Blocks:
    """Adds the sum of ``value`` over the key's rows up to each one, exact for decimals."""
    own = F.sum(value).over(blocks.window.rowsBetween(Window.unboundedPreceding, 0))
    if blocks.whole:
        return blocks.but(blocks.rows.withColumn(name, own.cast(kind)))
    joined = from_before(blocks, F.sum(value), lambda a, w: F.sum(a).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_before")
    less = kind.replace("(38,", "(37,")  # two decimals of all digits would be added with one digit less
    total = own.cast(less) + F.coalesce(F.col("_before").cast(less), F.lit(0).cast(less))
    return blocks.but(joined.withColumn(name, total.cast(kind)).drop("_before"))


def _pieces(rows: pa.Table, by: Sequence[str]) -> list[tuple[int, int]]:
    """Where each key's rows begin and end, in rows sorted by key."""
    n = rows.num_rows
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for c in by:
        codes = pd.factorize(rows.column(c).to_pandas(), use_na_sentinel=False)[0]
        fresh[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(fresh)
    return list(zip(begins.tolist(), [*begins[1:].tolist(), n], strict=True)) if n else []


def carried(blocks: Blocks, start: object, summarise: Callable[[pa.Table], object], fold: Callable[[object, object], object], apply: Callable[[pa.Table, object], dict], out: str) -> Blocks:
    """Columns ``out`` that depend on all earlier rows of the key.

    ``summarise(rows)`` is what a block's rows of a key do to any state, small whatever their number; ``fold(state, summary)``
    the state after them; ``apply(rows, state)`` gives the columns, as sequences, from the state before. The first row's
    state is ``start``. Rows come to the functions in order, as Arrow tables. All must be pure: tasks may run twice.
    """
    if not blocks.ranged:
        raise ValueError("blocks of time hold more than two keys that go on in others; use in_blocks")
    spark, rows, by, order = blocks.rows.sparkSession, blocks.rows, list(blocks.by), list(blocks.order)
    ship(spark)
    sort = [(c, "ascending") for c in [*by, *order]]
    names = [c.split()[0] for c in out.split(", ")]
    keys = [f for f in rows.schema if f.name in by] + [f for f in rows.schema if f.name == "_block"]
    whole = StructType([*rows.schema.fields, *[StructField(c.split()[0], {"boolean": BooleanType(), "long": LongType(), "double": DoubleType()}[c.split()[1]]) for c in out.split(", ")]])

    def edges(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(sort)
        pieces = _pieces(rows, by)
        pieces = pieces[:1] + pieces[1:][-1:]
        found = {c: rows.column(c).take(pa.array([a for a, _ in pieces], pa.int64())) for c in by}
        return pa.table({**found, "_block": rows.column("_block").slice(0, len(pieces)), "_does": pa.array([pickle.dumps(summarise(rows.slice(a, b - a))) for a, b in pieces], pa.binary())})

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, got = rows.sort_values("_block"), start, []
        for does in rows["_does"]:
            got.append(pickle.dumps(state))
            state = fold(state, pickle.loads(does))
        return rows.drop(columns="_does").assign(_state=got)

    def run(rows: pa.Table, before: pa.Table | None = None) -> pa.Table:
        rows = rows.sort_by(sort)
        known = {tuple(r[c] for c in by): pickle.loads(r["_state"]) for r in before.to_pylist()} if before is not None else {}
        got: dict[str, list] = {n: [] for n in names}
        for a, b in _pieces(rows, by):
            part = rows.slice(a, b - a)
            state = known.get(tuple(part.column(c)[0].as_py() for c in by), start) if known else start
            for n, values in apply(part, state).items():
                got[n].extend(values)
        for n in names:
            kind = pa.bool_() if f"{n} boolean" in out else pa.int64() if f"{n} long" in out else pa.float64()
            rows = rows.append_column(n, pa.array(got[n], kind, from_pandas=True))
        return rows

    if blocks.whole:
        return blocks.but(rows.groupBy("_block").applyInArrow(lambda t: run(t), whole))
    summaries = materialise(rows.groupBy("_block").applyInArrow(edges, StructType([*keys, StructField("_does", BinaryType())])), "summaries")
    before = materialise(summaries.groupBy(*by).applyInPandas(states, StructType([*keys, StructField("_state", BinaryType())])), "states")
    return blocks.but(rows.groupBy("_block").cogroup(before.groupBy("_block")).applyInArrow(run, whole))


def greedy_walk(blocks: Blocks, x: str, step: Decimal | int, start: Decimal | int | None) -> Blocks:
    """Adds ``kept boolean`` and ``walk long`` (rows kept before this one) of the walk that always keeps the next row with ``x >= base + step``.

    ``x`` never falls within a key, and the base is the last kept row's ``x``, at first ``start``; None keeps the first
    row. A block's summary is a table: a base up to so much leaves it with that base after so many kept rows. Each row
    has one next row, found by one pass of two pointers; chains from different bases meet, so few entries differ, and never more than rows
    lie within one step of the block's begin.
    """

    def values(rows: pa.Table) -> list:
        setcontext(Context(prec=80))
        return rows.column(x).to_pylist()

    def nexts(xs: list) -> list[int]:
        out, j, n = [], 0, len(xs)
        for v in xs:
            due = v + step
            while j < n and xs[j] < due:
                j += 1
            out.append(j)
        return out

    def summarise(rows: pa.Table) -> list[tuple]:
        xs = values(rows)
        after, n = nexts(xs), len(xs)
        last, count = list(range(n)), [1] * n
        for k in range(n - 1, -1, -1):
            if after[k] < n:
                last[k], count[k] = last[after[k]], count[after[k]] + 1
        table: list[tuple] = []
        for k in range(min(after[0] + 1, n)):
            entry = (xs[k] - step, xs[last[k]], count[k])
            if table and table[-1][1:] == entry[1:]:
                table.pop()
            table.append(entry)
        return table

    def fold(state: tuple, table: list[tuple]) -> tuple:
        base, walked = state
        at = 0 if base is None else bisect_left(table, base, key=lambda e: e[0])
        return (table[at][1], walked + table[at][2]) if at < len(table) else state

    def apply(rows: pa.Table, state: tuple) -> dict:
        xs = values(rows)
        base, walked = state
        kept = [False] * len(xs)
        at = 0 if base is None else bisect_left(xs, base + step)
        while at < len(xs):
            kept[at] = True
            at = bisect_left(xs, xs[at] + step, at + 1)
        total = np.cumsum(kept)
        return {"kept": kept, "walk": (walked + total - np.array(kept, int)).tolist()}

    return carried(blocks, (start, 0), summarise, fold, apply, "kept boolean, walk long")


@dataclass(frozen=True)
class Smoothing:
    """``y + alpha * (x - y)`` from the mean of the first ``period`` values of ``x`` on; null before that.

    Nulls before the first value are passed over; a later one, or an infinite value anywhere, ends it: null from there on.
    """

    x: str
    period: int
    alpha: float

    #: values so far up to ``period``, their sum, the mean, and whether it has ended
    START = (0, 0.0, 0.0, False)

    def summarise(self, values: np.ndarray) -> tuple:
        """The first values as they are; what the others do is affine: ``y`` becomes ``a * y + b``."""
        known = ~np.isnan(values)
        lead = int(np.argmax(known)) if known.any() else len(values)
        rest = values[lead:]
        ended = not np.isfinite(rest).all()
        rest = rest[: int(np.argmin(np.isfinite(rest)))] if ended else rest
        more = rest[self.period :]
        return lead > 0, rest[: self.period].tolist(), (1 - self.alpha) ** len(more), self._run(0.0, more)[-1] if len(more) else 0.0, ended

    def _run(self, y: float, values: np.ndarray) -> np.ndarray:
        return pd.Series(np.concatenate([[y], values])).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[1:]

    def fold(self, state: tuple, summary: tuple) -> tuple:
        n, total, y, over = state
        late, first, a, b, ended = summary
        if over or (late and n):
            return n, total, y, True
        for x in first:
            n, total, y = self._one(n, total, y, x)
        return n, total, a * y + b if n == self.period else y, ended

    def _one(self, n: int, total: float, y: float, x: float) -> tuple:
        if n == self.period:
            return n, total, y + self.alpha * (x - y)
        return n + 1, total + x, (total + x) / self.period if n + 1 == self.period else y

    def apply(self, values: np.ndarray, state: tuple) -> np.ndarray:
        out = np.full(len(values), np.nan)
        n, total, y, over = state
        late, first, _, _, ended = self.summarise(values)
        if over or (late and n):
            return out
        at = int(np.argmax(~np.isnan(values))) if first else 0
        for i, x in enumerate(first):
            n, total, y = self._one(n, total, y, x)
            if n == self.period:
                out[at + i] = y
        more = values[at + len(first) :]
        more = more[: int(np.argmin(np.isfinite(more)))] if not np.isfinite(more).all() else more
        if len(first) == self.period and len(more):
            out[at + len(first) : at + len(first) + len(more)] = self._run(y, more)
        return out


def smooth(blocks: Blocks, smoothings: dict[str, Smoothing]) -> Blocks:
    """Adds a column for each smoothing of a column of doubles, along the rows of each key."""

    def values(rows: pa.Table, s: Smoothing) -> np.ndarray:
        return rows.column(s.x).to_numpy(zero_copy_only=False).astype(float)

    return carried(
        blocks, {n: Smoothing.START for n in smoothings}, lambda rows: {n: s.summarise(values(rows, s)) for n, s in smoothings.items()},
        lambda state, does: {n: s.fold(state[n], does[n]) for n, s in smoothings.items()}, lambda rows, state: {n: s.apply(values(rows, s), state[n]) for n, s in smoothings.items()},
        ", ".join(f"{n} double" for n in smoothings),
    )
