"""Values over revised bars against a computation from scratch at every time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import revised as V

BEGIN = datetime.datetime(2024, 1, 1)
BARS = "symbol string, interval_start timestamp, interval_end timestamp, available_time timestamp, close double, revision_id int"


def bar(symbol, i, late, close, revision):
    start = BEGIN + datetime.timedelta(minutes=i)
    return symbol, start, start + datetime.timedelta(minutes=1), start + datetime.timedelta(minutes=1 + late), float(close), revision


def smooth_change(b):
    """A feature of a feature: the change of the mean return of two bars."""
    return X.with_returns(b).withColumn("mean", X.moving_average("log_return", 2)).withColumn("value", X.difference("mean", 1))


def test_a_bar_revised_after_three_evaluations(spark):
    rows = [bar("s", i, 0, 100 + i * i, 0) for i in range(8)] + [bar("s", 2, 3, 50, 1)]  # bar 2 is revised when bar 5 is there
    values = V.over_revisions(spark.createDataFrame(rows, BARS), smooth_change, 3, 1)
    times = sorted(r.valid_from for r in values.where(F.col("interval_start") == BEGIN + datetime.timedelta(minutes=4)).collect())
    assert times == [BEGIN + datetime.timedelta(minutes=5), BEGIN + datetime.timedelta(minutes=6)]
    before = {r.interval_start: r.value for r in V.values_at(values, str(BEGIN + datetime.timedelta(minutes=5, seconds=59))).collect()}
    after = {r.interval_start: r.value for r in V.values_at(values, str(BEGIN + datetime.timedelta(minutes=6))).collect()}
    changed = [t for t in before if before[t] != after[t]]
    assert changed and {t.minute for t in changed} <= {3, 4} and len(after) == len(before) + 1


def test_values_equal_a_computation_at_each_time(spark):
    rng, rows = random.Random(2), []
    for symbol in "ab":
        for i in range(40):
            if rng.random() < 0.06:
                continue  # a gap
            rows.append(bar(symbol, i, rng.choice([0, 0, 0, 0, 2.5, 6]), 100 + rng.randrange(20), 0))
            for n in range(1, rng.choice([1, 1, 1, 2, 4])):
                rows.append(bar(symbol, i, rng.choice([1, 3, 3, 9]), 100 + rng.randrange(20), n))
    df = spark.createDataFrame(rows, BARS)
    values = V.over_revisions(df, smooth_change, 3, 1)
    assert values.groupBy("symbol", "interval_start", "valid_from").count().where("count > 1").count() == 0
    values = values.collect()
    for minute in (3, 9.5, 20, 33, 60):
        at = BEGIN + datetime.timedelta(minutes=minute)
        seen = {}
        for r in sorted(rows, key=lambda r: (r[3], r[5])):
            if r[3] <= at:
                seen[r[0], r[1]] = r
        want = {(r.symbol, r.interval_start): r.value for r in smooth_change(spark.createDataFrame(list(seen.values()), BARS)).collect()}
        got = {}
        for r in sorted((r for r in values if r.valid_from <= at), key=lambda r: r.valid_from):
            got[r.symbol, r.interval_start] = r.value
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (v is None) == (got[k] is None) and (v is None or got[k] == pytest.approx(v, abs=1e-12)), (minute, k)
