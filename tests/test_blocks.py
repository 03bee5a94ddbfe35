"""What is carried from block to block: greedy walks, sums, previous rows; volume bars, archives in line order, sinks."""

import datetime
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.blocks import greedy_walk, in_blocks, previous, running_sum
from tidemark.operators import bars as B
from tidemark.operators import events as E
from tidemark.operators import features as X
from tidemark.sources import archives as A
from tidemark.sources import sinks as K

TRADES = "symbol string, venue_trade_id long, event_time timestamp, available_time timestamp, price decimal(38,18), quantity decimal(38,18)"


def trade(symbol, i, at, price, quantity, late=1):
    at = datetime.datetime.fromisoformat(at) if isinstance(at, str) else at
    return symbol, i, at, at + datetime.timedelta(seconds=late), Decimal(price), Decimal(quantity)


def test_volume_bars_cross_midnight_and_sum_exactly(spark):
    rows = [trade("b", 10, "2024-01-01T23:59:59", "100", "0.1"), trade("b", 11, "2024-01-02T00:00:01", "101", "0.2", 3), trade("b", 12, "2024-01-02T00:00:02", "99", "0.05")]
    rows += [trade("c", 1, "2024-02-01", "1", "0.6"), trade("c", 2, "2024-02-01T00:00:01", "2", "0.29")]
    for parts in (1, 5):
        out = {r.symbol: r for r in B.volume_bars(spark.createDataFrame(rows, TRADES), Decimal("0.3"), parts).collect()}
        b = out["b"]
        assert (b.open, b.high, b.low, b.close, b.volume) == tuple(map(Decimal, ("100", "101", "100", "101", "0.3"))) and b.trade_count == 2
        assert b.last_time == rows[1][2] and b.available_time == rows[1][3]
        assert out["c"].volume == Decimal("0.6") and len(out) == 2


def test_volume_bars_equal_a_plain_walk_in_any_number_of_blocks(spark):
    rng, rows, want = random.Random(4), [], []
    begin = datetime.datetime(2024, 1, 1)
    for symbol, n in (("a", 300), ("b", 1), ("c", 40), ("d", 3)):
        held, no, part = Decimal(0), 0, []
        for i in range(n):
            t = trade(symbol, i * 2, begin + datetime.timedelta(minutes=i // 3 * 97), str(rng.randint(1, 99)), rng.choice(["0.1", "0.7", "3", "0.000000000000000001"]))
            rows.append(t)
            part.append(t)
            held += t[5]
            if held >= Decimal("4.2"):
                want.append((symbol, no, part[0][2], t[2], t[3], part[0][4], max(x[4] for x in part), min(x[4] for x in part), t[4], held, len(part)))
                held, no, part = Decimal(0), no + 1, []
    rng.shuffle(rows)
    for parts in (None, 1, 3, 16):
        assert sorted(tuple(r) for r in B.volume_bars(spark.createDataFrame(rows, TRADES), "4.2", parts).collect()) == want
    assert B.volume_bars(spark.createDataFrame([], TRADES), 1, 2).count() == 0


def test_volume_bars_refuse_what_has_no_order(spark):
    good = [trade("a", 1, "2024-01-01", "1", "1"), trade("a", 2, "2024-01-01", "1", "1")]
    for bad in (trade("a", 2, "2024-01-01", "5", "1"), trade("a", 0, "2024-01-02", "1", "1"), trade("a", 3, "2024-01-02", "1", "0")):
        with pytest.raises(ValueError, match="ids repeat or fall"):
            B.volume_bars(spark.createDataFrame([*good, bad], TRADES), 1, 3)
    for threshold in (0, -1, "NaN", "Infinity"):
        with pytest.raises(ValueError, match="threshold"):
            B.volume_bars(spark.createDataFrame(good, TRADES), threshold)


def test_greedy_walk_and_sums_over_blocks(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(n * 3), i) for k, n in (("busy", 400), ("x", 1), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, x long, id long")
    for parts in (None, 1, 4, 11):
        blocks = in_blocks(df, ["key"], ["x", "id"], parts)
        got = greedy_walk(running_sum(previous(blocks, {"before": "id"}), "x", "total", "long"), "x", 10, None).rows.collect()
        for key in ("busy", "x", None):
            own = sorted((r for r in got if r.key == key), key=lambda r: (r.x, r.id))
            base, walked, total, last = None, 0, 0, None
            for r in own:
                keeps = base is None or r.x >= base + 10
                total += r.x
                assert (r.kept, r.walk, r.total, r.before) == (keeps, walked, total, last), (key, r)
                base, walked, last = (r.x, walked + 1, r.id) if keeps else (base, walked, r.id)


def test_independent_events_of_a_busy_key(spark):
    rng = random.Random(2)
    times = sorted(rng.randrange(50_000) for _ in range(500))
    kept, last = 0, None
    for t in times:
        if last is None or t - last >= 60:
            kept, last = kept + 1, t
    df = spark.createDataFrame([(1, t) for t in times] + [(2, 5)], "key long, s long").select("key", F.timestamp_seconds("s").alias("event_time"))
    assert {r.key: r.n_independent for r in E.independent_count(df, 60, 7).collect()} == {1: kept, 2: 1}


DAY = datetime.datetime(2024, 3, 5, tzinfo=datetime.timezone.utc)
BASE = int(DAY.timestamp() * 1000)


def agg(i, at, first=None, last=None):
    return f"{i},1.0,1.0,{first or i * 10},{last or i * 10 + 5},{BASE + at},False,True"


def kline(minute, quote="5", taker="0", shift=0):
    start = BASE + minute * 60_000
    return f"{start},2,3,1,2,10,{start + 59_999 + shift},{quote},4,1,{taker},0"


def judged(spark, tmp_path, reader, files):
    for name, lines in files.items():
        folder = tmp_path / f"{name}-{DAY:%Y-%m-%d}"
        folder.mkdir(parents=True)
        (folder / "part.csv").write_text("\n".join(lines) + "\n")
    good, rejects = reader(spark, str(tmp_path) + "/*")
    name = lambda f: re.search(r"/([a-z_]+)-\d{4}", f)[1]
    n = {}
    for r in good.select("file").collect():
        n[name(r.file)] = n.get(name(r.file), 0) + 1
    return n, {name(r.file): (r.reason, r.n_broken) for r in rejects.collect()}


@pytest.mark.parametrize("block", ["128m", "200b", "3k"])
def test_trade_files_keep_the_order_of_their_lines(spark, tmp_path, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        many = [agg(i, i) for i in range(1, 200)]
        files = {
            "good": many, "gaps": [agg(1, 0), agg(9, 0)], "swapped": [agg(1, 0), agg(3, 2), agg(2, 1)], "repeated": [agg(1, 0), agg(2, 1), agg(2, 1)],
            "time": [agg(1, 5), agg(2, 4)], "ranges": [agg(1, 0, 10, 20), agg(2, 0, 20, 25)], "far": [*many[:150], agg(149, 149), *many[150:]], "both": [agg(2, 1), agg(1, 0), "x,y"],
            "day": [agg(1, 0), agg(2, 86_400_000)],
        }
        n, rejects = judged(spark, tmp_path, A.trade_archives, files)
        assert n == {"good": 199, "gaps": 2}
        assert {k: v[0] for k, v in rejects.items()} == {"swapped": "id falls", "repeated": "repeated id", "time": "time falls", "ranges": "id ranges overlap", "far": "id falls", "both": "id falls", "day": "outside the day"}
        assert rejects["far"] == ("id falls", 1) and rejects["both"][1] == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("block", ["128m", "200b"])
def test_bar_files_keep_the_order_of_their_lines(spark, tmp_path, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        files = {
            "good": [kline(i) for i in range(60)], "missing": [kline(0), kline(5), kline(1439)], "swapped": [kline(1), kline(0)], "repeated": [kline(0), kline(1), kline(1)],
            "taker": [kline(0, "5", "5"), kline(1, "5", "5.01")], "close": [kline(0), kline(1, shift=1)], "day": [kline(0), kline(1440)], "header": ["open_time,open,high,low,close,volume,close_time,q,n,tb,tq,x", kline(0)],
        }
        n, rejects = judged(spark, tmp_path, A.bar_archives, files)
        assert n == {"good": 60, "missing": 3}
        assert {k: v[0] for k, v in rejects.items()} == {"swapped": "bar falls", "repeated": "repeated bar", "taker": "taker quote above quote volume", "close": "wrong close time", "day": "outside the day", "header": "unparsable"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_batch_ids_are_texts(spark, tmp_path):
    root, ids = str(tmp_path), ["001", "1", "2024-01-01", "1e5", "a/b=c", "é %2F", "", "true"]
    for k, name in enumerate(ids):
        assert K.append_batch(spark.range(k + 1), root, name) == "written"
        got = K.read_batches(spark, root)
        assert {r.batch_id: r["count"] for r in got.groupBy("batch_id").count().collect()} == {b: i + 1 for i, b in enumerate(ids[: k + 1])}
    assert {r.batch_id for r in K.read_batches(spark, root, ["001", "é %2F", "unknown"]).collect()} == {"001", "é %2F"}
    assert K.append_batch(spark.range(0), root, "none") == "written" and K.append_batch(spark.range(0), root, "none") == "replayed"
    assert K.read_batches(spark, root, ["none"]).count() == 0
    spark.range(50).withColumn("batch_id", F.lit("dead")).write.parquet(f"{root}/rows/folder={K._folder('dead')}")  # its writer died before the ledger
    assert K.read_batches(spark, root).where("batch_id = 'dead'").count() == 0
    assert K.append_batch(spark.range(2), root, "dead") == "written" and K.read_batches(spark, root, ["dead"]).count() == 2


def test_runs_are_whole_or_absent(spark, tmp_path):
    root = str(tmp_path)
    empty = spark.range(0).withColumn("label", F.lit("x"))
    key = K.put_run(empty, root, "id")
    assert K.get_run(spark, root, key).columns == ["id", "label"] and K.get_run(spark, root, key).count() == 0
    run = spark.range(5)
    own = K.fingerprint(run).first()
    folder = f"{root}/run={own.n_rows}-{own.sum1}-{own.sum2}"
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(folder)  # what a writer that died has left
    with pytest.raises(KeyError, match="not stored whole"):
        K.get_run(spark, root, folder.rpartition("=")[2])
    key = K.put_run(run, root, "id")
    assert sorted(r.id for r in K.get_run(spark, root, key).collect()) == list(range(5)) and K.put_run(run.repartition(3), root, "id") == key
    with pytest.raises(ValueError, match="not 0..n-1"):
        K.put_run(spark.range(1, 4), root, "id")


def test_smoothing_over_blocks_equals_one_pass(spark):
    rng = random.Random(6)
    begin = datetime.datetime(2024, 1, 1)
    rows = []
    for symbol, run, n in (("a", 1, 240), ("a", 2, 3), ("b", 1, 30), ("c", 1, 12)):
        price = 100.0
        for i in range(n):
            price += rng.choice([-1.5, -0.5, 0.0, 0.7, 1.1]) if symbol != "c" else 0.0
            spread = rng.random() if symbol != "c" else 0.0
            rows.append((symbol, run, begin + datetime.timedelta(minutes=i), price + spread, price - spread, price))
    df = spark.createDataFrame(rows, "symbol string, run_id long, interval_start timestamp, high double, low double, close double")
    rng.shuffle(rows)

    def smoothed(xs, period, alpha):
        out, y = [], None
        for i, x in enumerate(xs):
            y = None if i + 1 < period else sum(xs[:period]) / period if i + 1 == period else y + alpha * (x - y)
            out.append(y)
        return out

    def plain(bars, period=5):
        bars = sorted(bars, key=lambda r: r[2])
        steps = list(zip(bars, bars[1:], strict=False))
        tr = [max(b[3] - b[4], abs(b[3] - a[5]), abs(b[4] - a[5])) for a, b in steps]
        up, down = [max(b[5] - a[5], 0.0) for a, b in steps], [max(a[5] - b[5], 0.0) for a, b in steps]
        gain, loss = smoothed(up, period, 1 / period), smoothed(down, period, 1 / period)
        rsi = [None, *[None if g is None else 100.0 if x == 0 else 100 - 100 / (1 + g / x) for g, x in zip(gain, loss, strict=True)]]
        close = [b[5] for b in bars]
        fast, slow = smoothed(close, 7, 2 / 4), smoothed(close, 7, 2 / 8)
        line = [None if f is None else f - s for f, s in zip(fast, slow, strict=True)]
        known = [x for x in line if x is not None]
        signal = [None] * (len(line) - len(known)) + smoothed(known, 4, 2 / 5)
        rise = [b[3] - a[3] if b[3] - a[3] > a[4] - b[4] and b[3] > a[3] else 0.0 for a, b in steps]
        fall = [a[4] - b[4] if a[4] - b[4] > b[3] - a[3] and a[4] > b[4] else 0.0 for a, b in steps]
        dx = []
        for t, p, m in zip(*(smoothed(x, period, 1 / period) for x in (tr, rise, fall)), strict=True):
            if t is not None:
                if t == 0 or p + m == 0:
                    break
                dx.append(100 * abs(p - m) / (p + m))
        adx = smoothed(dx, period, 1 / period)
        adx = [None] * period + adx + [None] * (len(bars) - period - len(adx))
        return [None, *smoothed(tr, period, 1 / period)], rsi, line, signal, adx[: len(bars)]

    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if r[:2] == key]
        for r, values in zip(sorted(own, key=lambda r: r[2]), zip(*plain(own), strict=True), strict=True):
            want[r[0], r[1], r[2]] = values
    for parts in (None, 1, 9, 40):
        tables = X.atr(df, 5, parts), X.rsi(df, 5, parts), X.macd(df, 3, 7, 4, parts), X.adx(df, 5, parts)
        got = [{(r.symbol, r.run_id, r.interval_start): r[3:] for r in t.collect()} for t in tables]
        for key, values in want.items():
            found = [v for t in got for v in t[key]]
            assert [v is None for v in found] == [v is None for v in values], key
            assert found == pytest.approx(list(values), abs=1e-9), key
