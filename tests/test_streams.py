"""Streams over several runs: late rows told once, waiting rows over restarts, and the batch form's results."""

import datetime
import os
import random

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.streaming import jobs as J

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "symbol string, order_id long, event_time timestamp, price double, quantity double"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def at(minutes):
    return BEGIN + datetime.timedelta(minutes=minutes)


def test_late_rows_are_told_once_over_restarts(spark, tmp_path):
    rows, path = f"{tmp_path}/rows", f"{tmp_path}/dealt"
    batches = [[(1, 5), (2, 70)], [(3, 10), (4, 130), (5, None)], [(6, 50), (7, 59), (8, 100), (9, 400)], [(10, 119), (11, 395), (12, 350)]]
    late, mark = [], None
    for k, batch in enumerate(batches):
        for i, minute in batch:
            if minute is not None and mark is not None and (minute // 60 + 1) * 60 <= mark - 30:
                late.append(i)
        mark = max([m for _, m in batch if m is not None] + [mark or 0])
        put(spark, rows, [("a", i, None if m is None else at(m), 1.0, 1.0) for i, m in batch])
        if k != 1:  # a run with one new batch, then one with two, ...
            J.separate_late(source(spark, rows), path, 60, "30 minutes")
    told = lambda name: sorted(r.order_id for r in J.dealt_rows(spark, path, name, source(spark, rows).schema).collect())
    assert told("late") == late and late
    assert sorted(told("late") + told("on_time")) == list(range(1, 13))
    os.remove(f"{path}/checkpoint/commits/3")  # the last batch's writer died before it could say so
    for name in ("/.3.crc",):
        if os.path.exists(f"{path}/checkpoint/commits{name}"):
            os.remove(f"{path}/checkpoint/commits{name}")
    J.separate_late(source(spark, rows), path, 60, "30 minutes")
    assert told("late") == late and len(told("on_time")) == 12 - len(late)
    on_time = J.dealt_rows(spark, path, "on_time", source(spark, rows).schema, streaming=True).where("event_time is not null").withColumn("venue_trade_id", F.col("order_id"))
    bars = J.run_available(J.bars(on_time, 60, "30 minutes"), f"{tmp_path}/bars").collect()
    assert sum(r.trade_count for r in bars) == sum(1 for b in batches for i, m in b if i not in late and m is not None and (m // 60 + 1) * 60 <= 400 - 30)


def trades(n, seed):
    rng = random.Random(seed)
    return [("ab"[rng.random() < 0.3], i, at(i) + datetime.timedelta(seconds=rng.randrange(60)), float(rng.randint(1, 99)), float(rng.randint(1, 9))) for i in range(n)]


def test_stream_bars_equal_batch_bars_over_restarts(spark, tmp_path):
    rows, path, all_ = f"{tmp_path}/rows", f"{tmp_path}/run", trades(400, 3)
    chunks = [all_[i : i + 100] for i in range(0, 400, 100)]
    for k in range(3):  # some rows come a batch late, within the delay
        moved = chunks[k][-8::3]
        chunks[k] = [r for r in chunks[k] if r not in moved]
        chunks[k + 1] = moved + chunks[k + 1]
    for k, chunk in enumerate(chunks):
        random.Random(k).shuffle(chunk)
        put(spark, rows, chunk)
        if k != 2:
            out = J.run_available(J.volume_bars(source(spark, rows), 40.0, "20 minutes"), path)
    got = sorted((r.symbol, r.bar_no, r.last_time, r.open, r.high, r.low, r.close, r.volume, r.trade_count) for r in out.collect())
    df = spark.createDataFrame(all_, SCHEMA).withColumn("venue_trade_id", F.col("order_id")).withColumn("available_time", F.col("event_time"))
    end = max(r[2] for r in all_) - datetime.timedelta(minutes=20)
    bars = B.volume_bars(df, 40, 5).where(F.col("last_time") <= end).collect()
    want = sorted((r.symbol, r.bar_no, r.last_time, *(float(r[c]) for c in ("open", "high", "low", "close", "volume")), r.trade_count) for r in bars)
    assert got == want and len(got) > 40


def test_a_key_with_many_waiting_rows(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select(F.lit("busy").alias("symbol"), F.col("id").alias("order_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 100).alias("event_time"), F.lit(1.0).alias("price"), F.lit(1.0).alias("quantity"))
    for k in range(6):
        rows.where(F.floor(F.col("order_id") / (n // 6)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    out = J.run_available(J.volume_bars(source(spark, f"{tmp_path}/rows"), 1000.0, "5 minutes"), f"{tmp_path}/run")
    assert out.agg(F.count("*"), F.sum("volume"), F.max("bar_no")).first()[:] == (30, 30_000.0, 29)
