"""First touches over long horizons, lag histograms of busy keys, and the statistics that no longer sort whole tables."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import labels as L
from tidemark.operators import statistics as T

BEGIN = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(("horizon", "stretch"), [(1, 4096), (5, 7), (33, 40), (64, 64), (100, 30)])
def test_first_touches_equal_a_walk(spark, monkeypatch, horizon, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch)
    rng, bars, price = random.Random(horizon), [], 100.0
    for i in range(400):
        price = max(20.0, price + rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]))
        start = BEGIN + datetime.timedelta(minutes=i + (5 if i > 250 else 0))  # a gap
        end = start + datetime.timedelta(minutes=1)
        bars.append(("s", start, end, price, price + rng.choice([0.0, 1.0]), price - rng.choice([0.0, 1.0]), price, end + datetime.timedelta(seconds=rng.randrange(600))))
    events = [("s", f"e{k}", BEGIN + datetime.timedelta(minutes=rng.randrange(405), seconds=rng.randrange(60)), rng.choice([0.5, 1.0, 0.0, None])) for k in range(120)]
    bars_df = spark.createDataFrame(bars, "symbol string, interval_start timestamp, interval_end timestamp, open double, high double, low double, close double, available_time timestamp")
    out = L.triple_barrier(spark.createDataFrame(events, "symbol string, event_key string, event_time timestamp, vol double"), bars_df, 1, horizon, 0.06, 0.05, "vol").collect()
    got = {r.event_key: r for r in out}
    assert len(out) == len(events)
    for _, key, time, vol in events:
        r, entry = got[key], next((i for i, b in enumerate(bars) if b[1] >= time), None)
        whole = entry is not None and bars[entry][1] - time < datetime.timedelta(minutes=1) and entry + horizon <= 400 and bars[entry + horizon - 1][1] - bars[entry][1] == datetime.timedelta(minutes=horizon - 1)
        if not whole or not vol:
            assert r.label is None and (r.problem is None) == (vol != 0.0)
            continue
        opened = bars[entry][3]
        hi, lo = opened * (1 + 0.06 * vol), opened * (1 - 0.05 * vol)
        side, out_at, known = 0, bars[entry + horizon - 1][6], max(b[7] for b in bars[entry : entry + horizon])
        for j, b in enumerate(bars[entry : entry + horizon]):
            if b[5] <= lo or b[4] >= hi:
                side, out_at = (-1, min(b[3], lo)) if b[5] <= lo else (1, max(b[3], hi))
                known = max(x[7] for x in bars[entry : entry + j + 1])
                break
        assert r.side == side and abs(r.label - (out_at / opened - 1)) < 1e-12 and r.known_at == known, key


@pytest.mark.parametrize("parts", [None, 6])
def test_lag_histogram_equals_all_pairs(spark, parts):
    rng = random.Random(1)
    a = [(rng.choice([1, 1, 1, 2]), rng.randrange(5_000)) for _ in range(300)]
    b = [(rng.choice([1, 1, 3]), rng.randrange(5_000)) for _ in range(300)]
    df = lambda rows: spark.createDataFrame(rows, "key long, s long").select("key", F.timestamp_seconds("s").alias("event_time"))
    for lag, width in ((60, 20), (50, 30), (100, 200)):
        n = -(-2 * lag // width)
        want = Counter(min((y - x + lag) // width, n - 1) for k, x in a for j, y in b if k == j and abs(y - x) <= lag)
        assert {r.bin: r.n for r in E.lead_lag(df(a), df(b), lag, width, parts).collect()} == want
    assert E.lead_lag(df(a), df(b[:0]), 60, 20, parts).count() == 0


def test_a_busy_key_makes_no_pairs(spark):
    times = spark.range(100_000).select(F.lit(1).cast("long").alias("key"), F.timestamp_millis(F.col("id") * 10).alias("event_time"))
    got = {r.bin: r.n for r in E.lead_lag(times, times, 100, 50, 8).collect()}
    assert sum(got.values()) == sum(min(99_999, i + 10_000) - max(0, i - 10_000) + 1 for i in range(100_000))


def test_draws_take_the_smallest_hashes(spark):
    rng = random.Random(3)
    pool = [(f"k{i}", rng.random() if i % 17 else None) for i in range(600)]
    seen = [(f"o{i}", rng.random(), rng.choice([1.0, -1.0])) for i in range(25)]
    import hashlib

    h = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    sides = [s for _, s in sorted((h(7, k), s) for k, _, s in seen)]
    own = sum(s * v for _, v, s in seen) / 25
    means = []
    for sim in range(12):
        taken = [v for _, v in sorted((h(7, k, sim), v) for k, v in pool if v is not None)[:25]]
        means.append(sum(s * v for s, v in zip(sides, taken, strict=True)) / 25)
    r = T.null_percentile(spark.createDataFrame(pool, "key string, label double"), spark.createDataFrame(seen, "key string, label double, side double"), 12, 7).first()
    assert r.sims == 12 and r.percentile == pytest.approx(100 * sum(m < own for m in means) / 12)


def test_state_matrix_counts_a_null_state(spark):
    rows = [("calm", float(i)) for i in range(10)] + [(None, 5.0), (None, -1.0)]
    got = {r.state: r for r in T.state_matrix(spark.createDataFrame(rows, "state string, net double"), 3).collect()}
    assert got["calm"].top_share == pytest.approx(24 / 45) and got[None].n == 2 and got[None].top_share == pytest.approx(1.0)
