"""User-defined providers: named functions from DataFrames to DataFrames, and a check that they never look ahead.

Kinds: ``feature`` and ``state`` (bars to ``symbol, time, value``), ``event`` (bars to ``key, event_time``), ``outcome``
(events and bars to ``event_key, label``), ``strategy`` (bars to ``time, instrument, target``), ``risk`` (targets to
targets). A provider is a plain function of DataFrames and keyword parameters, so it can be built on others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("feature", "state", "event", "outcome", "strategy", "risk")
OUTPUT = {"feature": {"symbol", "time", "value"}, "state": {"symbol", "time", "value"}, "event": {"key", "event_time"}, "outcome": {"event_key", "label"}, "strategy": {"time", "instrument", "target"}, "risk": {"time", "instrument", "target"}}


class Registry:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Callable[..., DataFrame]] = {}

    def register(self, kind: str, name: str) -> Callable:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")

        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if (kind, name) in self._known:
                raise ValueError(f"{kind} {name} is registered already")
            self._known[kind, name] = f
            return f

        return add

    def run(self, kind: str, name: str, *frames: DataFrame, **params) -> DataFrame:
        """Run a provider; its result must have the kind's columns, and states must be text."""
        out = self._known[kind, name](*frames, **params)
        missing = OUTPUT[kind] - set(out.columns)
        if missing:
            raise ValueError(f"{kind} {name} lacks {sorted(missing)}")
        if kind == "state" and out.schema["value"].dataType.simpleString() != "string":
            raise ValueError(f"state {name} must give text")
        return out


def causality(provider: Callable[[DataFrame], DataFrame], bars: DataFrame, at: str, time: str = "time", known: str = "available_time") -> DataFrame:
    """Rows up to a time that change when the input is cut there: empty for a provider that never looks ahead."""
    t = F.lit(at).cast("timestamp")
    full = provider(bars).where(F.col(time) <= t)
    cut = provider(bars.where(F.col(known) <= t)).where(F.col(time) <= t)
    return full.exceptAll(cut).withColumn("only_in", F.lit("full")).unionByName(cut.exceptAll(full).withColumn("only_in", F.lit("cut")))


def fit_predict(rows: DataFrame, fold: str, fit: dict[str, Column], predict: Column, key: str = "key", role: str = "role") -> DataFrame:
    """A fitted rule per fold: ``fit`` are aggregates over the fold's training rows, ``predict`` a column over its test rows
    and those aggregates: ``fold, key, side``. A fold without training rows has null aggregates.

    No fold is held in one task: the model is one row per fold and is broadcast to the test rows.
    """
    model = rows.where(F.col(role) == "train").groupBy(fold).agg(*[c.alias(n) for n, c in fit.items()])
    test = rows.where(F.col(role) == "test").join(F.broadcast(model), fold, "left")
    return test.select(F.col(fold).cast("long").alias("fold"), F.col(key).cast("string").alias("key"), predict.cast("double").alias("side"))
