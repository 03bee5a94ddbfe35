"""Windows over pieces of a busy symbol, and ranks in trailing windows, against plain counts."""

import bisect
import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.ranks import Wavelet, in_pieces
from tidemark.operators import features as X
from tidemark.operators import states as S
from tidemark.operators import targets as T

BEGIN = datetime.datetime(2024, 1, 1)


def test_wavelet_counts_equal_plain_counts():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 2), (200, 9), (500, 400)):
        ranks = rng.integers(0, top, n)
        low, high = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        than = rng.integers(0, top + 2, 300)
        got = Wavelet(ranks).less(low, high, than)
        assert got.tolist() == [int((ranks[a:b] < t).sum()) for a, b, t in zip(low, high, than, strict=True)]


def minute_bars(spark, n, seed=1):
    rng, rows, price = random.Random(seed), [], 100.0
    for i in range(n):
        if rng.random() > 0.04:  # gaps
            price += rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
            at = BEGIN + datetime.timedelta(minutes=i)
            rows.append(("busy", at, at + datetime.timedelta(minutes=1), price, price + 1, price - 1, price, float(rng.randint(1, 9))))
    return spark.createDataFrame(rows, "symbol string, interval_start timestamp, interval_end timestamp, open double, high double, low double, close double, volume double")


def test_pieces_give_the_windows_of_the_whole(spark):
    bars, n = minute_bars(spark, 500), 7
    features = {
        "e02": lambda b: b.withColumn("value", F.col("log_return")), "e03": lambda b: b.withColumn("value", X.realized_volatility(n)), "e04": lambda b: b.withColumn("value", X.volume_sum(n)),
        "e09": lambda b: b.withColumn("value", X.bollinger_percent_b(n, 2.0)), "e22": lambda b: b.withColumn("value", X.difference("close", n)),
        "e24": lambda b: X.add_rank_in_time(b, "log_return", n, "value"), "e25": lambda b: X.add_quantile_in_time(b, "log_return", n, 3, "value"),
    }
    for name, compute in features.items():
        whole = {r.interval_start: r.value for r in compute(X.with_returns(bars)).collect()}
        cut = X.over_bars(bars, compute, n, 1, piece_bars=40)
        got = {r.interval_start: r.value for r in cut.collect()}
        assert got.keys() == whole.keys() and cut.count() == len(whole), name
        assert all((a is None) == (whole[t] is None) and (a is None or abs(a - whole[t]) < 1e-9) for t, a in got.items()), name
    pieces = in_pieces(bars, lambda b: b.withColumn("piece", F.col("symbol._piece")), 0, 40 * 60_000_000)
    assert pieces.select("piece").distinct().count() == 13 and pieces.columns == [*bars.columns, "piece"]


def test_rank_in_time_equals_a_list_of_the_window(spark):
    bars, n = minute_bars(spark, 120, 5), 6
    rows = X.add_rank_in_time(X.with_returns(bars), "log_return", n, "rank").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.interval_start):
        by.setdefault(r.run_id, []).append(r)
    for run in by.values():
        for i, r in enumerate(run):
            past = [x.log_return for x in run[max(0, i - n + 1) : i + 1]]
            full = len(past) == n and None not in past
            want = (2 * sum(x < r.log_return for x in past) + past.count(r.log_return) - 1) / (2 * (n - 1)) if full else None
            assert r["rank"] == want


def test_regimes_of_long_windows(spark):
    rng, n, width = random.Random(9), 6_000, 4_000
    values = [None if rng.random() < 0.02 else rng.choice([rng.random(), 0.5]) for _ in range(n)]
    df = spark.createDataFrame([("s", BEGIN + datetime.timedelta(seconds=i), v) for i, v in enumerate(values)], "symbol string, interval_end timestamp, x double")
    got = {r.interval_end: r.state for r in S.quantile_regime(df, "x", [0.3, 0.7], ["low", "mid", "high"], 5, width).collect()}
    assert len(got) == n
    held = []
    for i, v in enumerate(values):
        if v is not None:
            bisect.insort(held, v)
        if i >= width and values[i - width] is not None:
            held.remove(values[i - width])
        less, count = bisect.bisect_left(held, v) if v is not None else 0, len(held)
        passed = sum(less >= max(1, int(np.ceil(c * count))) for c in (0.3, 0.7))
        assert got[BEGIN + datetime.timedelta(seconds=i)] == (["low", "mid", "high"][passed] if v is not None and count >= 5 else None), i


def runs_of(bars):
    """The bars of each run, in order."""
    runs = []
    for b in sorted(bars.collect(), key=lambda b: b.interval_start):
        if not runs or runs[-1][-1].interval_end != b.interval_start:
            runs.append([])
        runs[-1].append(b)
    return runs


def walked(runs, enters, leaves):
    """The target after each bar, by the end of the bar: one loop along each run."""
    out = {}
    for run in runs:
        held = 0.0
        for i, b in enumerate(run):
            held = 0.0 if leaves(run, i) else 1.0 if enters(run, i) else held
            out[b.interval_end] = held
    return out


def test_latches_hold_over_pieces_and_fall_at_gaps(spark):
    bars = minute_bars(spark, 700, 8).withColumns({"high": F.col("close") + 0.25, "low": F.col("close") - 0.25})
    runs = runs_of(bars)
    want = walked(runs, lambda r, i: i >= 6 and r[i].close > max(b.high for b in r[i - 4 : i]), lambda r, i: i >= 6 and r[i].close < min(b.low for b in r[i - 6 : i]))
    for piece in (11, 40, 4096):
        got = T.donchian_breakout(bars, 4, 6, 1, piece_bars=piece).collect()
        assert len(got) == len(want) and {r.time: r.target for r in got} == want
    assert 0 < sum(want.values()) < len(want)

    def z(r, i):
        c = np.array([b.close for b in r[max(0, i - 4) : i + 1]])
        return (c[-1] - c.mean()) / c.std() if len(c) == 5 and c.std() > 0 else None

    want = walked(runs, lambda r, i: z(r, i) < -1.0, lambda r, i: z(r, i) is None or z(r, i) > -0.2)
    for piece in (11, 4096):
        got = T.zscore_reversion(bars, 5, 1.0, 0.2, 1, piece_bars=piece).collect()
        assert len(got) == len(want) and {r.time: r.target for r in got} == want
    assert 0 < sum(want.values()) < len(want)
    assert T.donchian_breakout(bars.where("symbol = 'none'"), 4, 6, 1).count() == 0


def test_crosses_and_switches_meet_the_row_of_the_block_before(spark, monkeypatch):
    bars = minute_bars(spark, 300, 9).withColumn("x", F.when(F.col("volume") != 5, F.col("volume") - 6))
    rows = sorted(bars.collect(), key=lambda b: b.interval_start)
    bars = bars.withColumn("state", F.when(F.col("x") > 1, "high").when(F.col("x") < -1, "low"))
    pairs = list(zip(rows, rows[1:], strict=False))
    crossed = {b.interval_start: "up" if b.x > 0 else "down" for a, b in pairs if a.x is not None and b.x is not None and (a.x <= 0 < b.x or a.x >= 0 > b.x)}
    name = lambda x: None if x is None else "high" if x > 1 else "low" if x < -1 else None
    switched = {b.interval_start: (name(a.x), name(b.x)) for a, b in pairs if name(a.x) and name(b.x) and name(a.x) != name(b.x)}
    known = [name(r.x) for r in rows if name(r.x)]
    steps = {}
    for pair in zip(known, known[1:], strict=False):
        steps[pair] = steps.get(pair, 0) + 1
    for minutes in (7, 100_000):  # blocks of a few rows, some of them without any, and one block
        monkeypatch.setattr(S, "BLOCK_US", minutes * 60_000_000)
        assert {r.interval_start: r.direction for r in S.threshold_cross(bars, "x", 0.0).collect()} == crossed
        assert {r.interval_start: (r.from_state, r.to_state) for r in S.state_switch(bars).collect()} == switched
        assert {(r.from_state, r.to_state): r.n for r in S.transitions(bars).collect()} == steps
    assert crossed and switched
