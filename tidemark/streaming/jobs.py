"""Structured Streaming forms of the operators that make sense on a live stream.

Each takes and returns a streaming DataFrame; ``run_available`` drives one to completion over what is there. State is
bounded by the watermark, or holds one small record per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.functions.session import exists, ship

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTS = "spark.sql.shuffle.partitions"
#: The state store that jobs with keyed state (``_stateful``) need; set it before such a query starts.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all input that is available and return the table that the stream wrote under ``path``.

    Where the stream holds keyed state, the query starts with the state store ``ROCKS`` and, as each part of the state is a Python
    process and a store in every micro-batch whether it has keys or not, with no more parts than the session has cores.
    """
    spark = stream.sparkSession
    before = {c: spark.conf.get(c) for c in (STORE, PARTS)}
    if "TransformWithState" in stream._jdf.queryExecution().logical().toString():
        spark.conf.set(STORE, ROCKS)
        spark.conf.set(PARTS, min(int(before[PARTS]), spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def bars(trades: DataFrame, minutes: int, delay: str) -> DataFrame:
    """Time bars, each emitted once when the watermark passes its end; later trades of it no longer count."""
    order = F.struct("event_time", "venue_trade_id")
    grouped = trades.withWatermark("event_time", delay).groupBy("symbol", F.window("event_time", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trade_count"),
    )
    return grouped.select("symbol", F.col("w.start").alias("interval_start"), F.col("w.end").alias("interval_end"), "open", "high", "low", "close", "volume", "trade_count")


def separate_late(trades: DataFrame, path: str, minutes: int, delay: str) -> None:
    """Deal all available rows of a stream to two tables: ``path/on_time`` and, as a side output, ``path/late``.

    A row is late if its interval ended at or before the watermark of its micro-batch: the largest time of the batches before, in whole
    milliseconds, less ``delay``. ``bars`` over the rows that are on time drops none. Each micro-batch is a folder of either table, whole or absent, under its number: one that
    is run again after a failure finds its folders and leaves them, so every row is told once. Rows of a null time are on time.
    """
    spark = trades.sparkSession
    width = minutes * 60_000_000
    end = (F.floor(F.unix_micros("event_time") / F.lit(width)) + 1) * width  # window() would drop rows without a time
    slack = int(pd.Timedelta(delay).total_seconds() * 1_000_000)

    def deal(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema("us long, batch long").parquet(f"{path}/seen").where(F.col("batch") < number).agg(F.max("us")).first()[0] if exists(spark, f"{path}/seen") else None
        late = F.lit(False) if seen is None else F.coalesce(end <= seen // 1000 * 1000 - slack, F.lit(False))
        parts = {"late": batch.where(late), "on_time": batch.where(~late), "seen": batch.agg(F.max(F.unix_micros("event_time")).alias("us"))}
        for name, rows in parts.items():
            folder = f"{path}/{name}/batch={number}"
            if not exists(spark, f"{folder}/_SUCCESS"):
                rows.write.mode("overwrite").parquet(folder)

    trades.writeStream.foreachBatch(deal).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def dealt_rows(spark: SparkSession, path: str, name: str, schema: StructType, streaming: bool = False) -> DataFrame:
    """One of the tables of ``separate_late``, as a table or as a stream."""
    return (spark.readStream if streaming else spark.read).schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{name}")


def unconfirmed(earlier: DataFrame, later: DataFrame, at: str, time: str = "event_time") -> DataFrame:
    """Differences between results at a checkpoint and later results cut at it: ``retracted`` or ``future_confirmed`` rows."""
    cut = later.where(F.col(time) <= F.lit(at).cast("timestamp"))
    return earlier.exceptAll(cut).withColumn("problem", F.lit("retracted")).unionByName(cut.exceptAll(earlier).withColumn("problem", F.lit("future_confirmed")))


def deduplicated(revisions: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each id once, within the watermark's delay of its first arrival."""
    return revisions.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sequences(first: DataFrame, then: DataFrame, window_s: int, delay: str) -> DataFrame:
    """Pairs of one key with ``first < then <= first + window``; both sides' state ends with the window."""
    a = first.select(F.col("key").alias("a_key"), F.col("event_id").alias("first_id"), F.col("event_time").alias("first_time")).withWatermark("first_time", delay)
    b = then.select("key", "event_id", "event_time").withWatermark("event_time", delay)
    near = F.expr(f"key = a_key and event_time > first_time and event_time <= first_time + interval {window_s} seconds")
    return b.join(a, near).select("key", "event_id", "event_time", "first_id", "first_time")


def latest_sequences(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each later event the one with the latest first event (on a table of pairs, or in ``foreachBatch``)."""
    return pairs.groupBy("key", "event_id", "event_time").agg(F.max_by("first_id", F.struct("first_time", "first_id")).alias("first_id"))


def absences(anchor: DataFrame, absent: DataFrame, window_s: int, delay: str) -> DataFrame:
    """Anchors that no ``absent`` event of their key follows within the window; emitted when the window has ended."""
    a = anchor.select("key", "event_id", "event_time").withWatermark("event_time", delay)
    b = absent.select(F.col("key").alias("b_key"), F.col("event_time").alias("b_time")).withWatermark("b_time", delay)
    near = F.expr(f"key = b_key and b_time >= event_time and b_time <= event_time + interval {window_s} seconds")
    return a.join(b, near, "leftOuter").where("b_time is null").select("key", "event_id", "event_time")


def sliding_counts(events: DataFrame, window: str, slide: str, delay: str, at_least: int = 1) -> DataFrame:
    grouped = events.withWatermark("event_time", delay).groupBy("key", F.window("event_time", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= at_least).select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def session_clusters(spans: DataFrame, delay: str) -> DataFrame:
    """Clusters of overlapping spans per key; spans that only touch stay apart, hence a gap one microsecond shorter.

    ``spans``: ``key, start, length_us``.
    """
    gap = F.concat((F.col("length_us") - 1).cast("string"), F.lit(" microseconds"))
    grouped = spans.withWatermark("start", delay).groupBy("key", F.session_window("start", gap).alias("w")).agg(F.count("*").alias("n_spans"))
    return grouped.select("key", F.col("w.start").alias("cluster_start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("cluster_end"), "n_spans")


#: Spans of waiting rows within the delay.
SPANS = 64


class _InOrder(StatefulProcessor):
    """Applies ``step`` to each key's rows in the order of time, once the watermark has passed them.

    Waiting rows are a map from spans of time to their rows, an Arrow table each, so a micro-batch rewrites the spans that it adds to or that become due,
    whatever else waits, and no row is turned into state by itself. A timer at the earliest waiting row calls for what is due.
    """

    def __init__(self, step, values: dict[str, str], names: list[str], state: str, delay: str):
        self.step, self.values, self.names, self.record = step, values, names, state
        self.rows = pa.schema([("us", pa.int64()), ("order_id", pa.int64()), *[(s, pa.string() if s == "label" else pa.float64()) for s in values]])
        self.width = max(1000, int(pd.Timedelta(delay).total_seconds() * 1_000_000) // SPANS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span bigint", "rows binary")
        self.state = handle.getValueState("state", self.record)
        self.timer = handle.getValueState("timer", "ms bigint")

    def _call_at(self, ms: int) -> None:
        known = self.timer.get()
        if known is None or ms < known[0]:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _held(self, span: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.waiting.getValue((span,))[0])).read_all()

    def _hold(self, span: int, rows: pa.Table) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.rows) as writer:
            writer.write_table(rows.combine_chunks())
        self.waiting.updateValue((span,), (out.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, parts = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            us = batch["event_time"].astype("datetime64[us]").astype("int64")
            columns = [us, batch["order_id"], *[batch[c] for c in self.values.values()]]
            parts.append(pa.table([pa.Array.from_pandas(c, type=f.type) for c, f in zip(columns, self.rows, strict=True)], schema=self.rows))
        fresh = pa.concat_tables(parts) if parts else self.rows.empty_table()
        if len(fresh):
            fresh = fresh.sort_by("us")
            us = fresh["us"].to_numpy()
            spans = us // self.width
            starts = np.concatenate([[0], np.flatnonzero(np.diff(spans)) + 1, [len(us)]])
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                span, added = int(spans[low]), fresh.slice(low, high - low)
                self._hold(span, pa.concat_tables([self._held(span), added]) if self.waiting.containsKey((span,)) else added)
            self._call_at(max(int(us[0]) // 1000, mark + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        ready, following = [], None
        for span in sorted(k[0] for k in self.waiting.keys()):
            if span * self.width > mark * 1000:
                following = span * self.width if following is None else following
                break
            rows = self._held(span).sort_by([("us", "ascending"), ("order_id", "ascending")])
            due = int(np.searchsorted(rows["us"].to_numpy(), mark * 1000, side="right"))
            if due:
                ready.append(rows.slice(0, due))
            if due == len(rows):
                self.waiting.removeKey((span,))
            else:
                if due:
                    self._hold(span, rows.slice(due))
                following = rows["us"][due].as_py()
                break
        if following is not None:
            self._call_at(max(following // 1000, mark + 1))
        if ready:
            frame = pa.concat_tables(ready).to_pandas()
            frame["event_time"] = pd.to_datetime(frame["us"], unit="us")
            old = self.state.get()
            got, new = self.step(key[0], frame.rename(columns=self.values), None if old is None else tuple(old))
            self.state.update(tuple(new))
            if got:
                yield pd.DataFrame(got, columns=self.names)

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, values: dict[str, str], out: str, state: str, step, delay: str) -> DataFrame:
    """``step(key, rows in time order, state tuple or None) -> (output rows, new state tuple)`` over each key's rows.

    Rows wait in the state until the watermark, ``delay`` behind the latest time seen, has passed them, and are then
    applied in the order of time and ``order_id``: how they are dealt over micro-batches, and in which order they arrive
    within the delay, makes no difference. Rows later than that are dropped. State is what waits, at most the delay's rows
    of a key, and one record. The query needs the state store ``ROCKS``.
    """
    ship(stream.sparkSession)
    processor = _InOrder(step, values, [c.split()[0] for c in out.split(", ")], state, delay)
    return stream.withWatermark("event_time", delay).groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")


def volume_bars(trades: DataFrame, threshold: float, delay: str = "10 minutes") -> DataFrame:
    """Volume bars with the open bar as state. Input: ``symbol, event_time, order_id, price, quantity`` (doubles)."""

    def step(symbol, rows, held):
        held = list(held) if held else [0, 0.0, 0.0, 0.0, 0.0, 0]  # bar_no, volume, open, high, low, trades
        out = []
        for i, (p, q) in enumerate(zip(rows["price"].tolist(), rows["quantity"].tolist(), strict=True)):
            no, v, o, h, lo, n = held
            held = [no, v + q, o if n else p, max(h, p) if n else p, min(lo, p) if n else p, n + 1]
            if held[1] >= threshold:
                out.append((symbol, no, rows["event_time"].iat[i], held[2], held[3], held[4], p, held[1], n + 1))
                held = [no + 1, 0.0, 0.0, 0.0, 0.0, 0]
        return out, tuple(held)

    return _stateful(trades, "symbol", {"x": "price", "y": "quantity"}, "symbol string, bar_no int, last_time timestamp, open double, high double, low double, close double, volume double, trade_count int", "bar_no int, volume double, open double, high double, low double, trades int", step, delay)


def state_switches(labels: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes of a label per key. Input: ``symbol, event_time, order_id, label``."""

    def step(symbol, rows, held):
        last, out = (held[0] or None) if held else None, []
        for t, label in zip(rows["event_time"], rows["label"], strict=True):
            if last is not None and label is not None and label != last:
                out.append((symbol, t, last, label))
            last = label
        return out, (last or "",)

    return _stateful(labels, "symbol", {"label": "label"}, "symbol string, event_time timestamp, from_state string, to_state string", "label string", step, delay)


def drawdown_alerts(equity: DataFrame, limit: float, delay: str = "10 minutes") -> DataFrame:
    """One alert for each episode below ``peak * (1 - limit)``. Input: ``symbol, event_time, order_id, equity``."""

    def step(symbol, rows, held):
        peak, breached = held if held else (0.0, False)
        out = []
        for t, x in zip(rows["event_time"], rows["equity"], strict=True):
            peak = max(peak, x)
            deep = peak > 0 and 1 - x / peak > limit
            if deep and not breached:
                out.append((symbol, t, float(x), float(peak)))
            breached = deep
        return out, (float(peak), bool(breached))

    return _stateful(equity, "symbol", {"x": "equity"}, "symbol string, event_time timestamp, equity double, peak double", "peak double, breached boolean", step, delay)


def zscore_latch(closes: DataFrame, n: int, entry_z: float, exit_z: float, delay: str = "10 minutes") -> DataFrame:
    """Long under ``-entry_z``, flat above ``-exit_z``, on the last ``n`` closes kept as state; one row per change."""

    def step(symbol, rows, held):
        last, on = (list(held[0]), held[1]) if held else ([], False)
        out = []
        for t, x in zip(rows["event_time"], rows["close"], strict=True):
            last = [*last, float(x)][-n:]
            mean = sum(last) / len(last)
            sd = (sum((v - mean) ** 2 for v in last) / len(last)) ** 0.5
            z = (x - mean) / sd if len(last) == n and sd > 0 else None
            now = False if z is None or z > -exit_z else True if z < -entry_z else on
            if now != on:
                out.append((symbol, t, 1.0 if now else 0.0))
            on = now
        return out, (last, on)

    return _stateful(closes, "symbol", {"x": "close"}, "symbol string, event_time timestamp, target double", "closes array<double>, held boolean", step, delay)
