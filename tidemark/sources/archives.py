"""Sources: trade and bar archives, REST pages, instrument snapshots. Each gives good rows and rejects in one batch job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import Blocks, previous
from tidemark.functions.scalars import ticks_to_time

TRADE_SCHEMA = "agg_trade_id long, price decimal(38,18), quantity decimal(38,18), first_trade_id long, last_trade_id long, ticks long, is_buyer_maker boolean, is_best_match boolean, _bad string"
BAR_SCHEMA = "open_ticks long, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume decimal(38,18), close_ticks long, quote_volume decimal(38,18), trade_count long, taker_buy_base_volume decimal(38,18), taker_buy_quote_volume decimal(38,18), _ignore string, _bad string"


def _first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def _file_day() -> Column:
    """The last date in the file's path: the day that it is filed under."""
    return F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})(?!.*\d{4}-\d{2}-\d{2})", 1))


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with their file, its day, and their place in it.

    A large file is read in several blocks. ``_block`` is where a line's block begins in the file, and within a block ids
    rise in the order of lines; so the two give the order of lines, whichever task reads what.
    """
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    at = {"file": F.col("_metadata.file_path"), "day": _file_day(), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    return raw.drop("filed").select("*", *[c.alias(n) for n, c in at.items()])


def _verdicts(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of sound files, and one reject per broken file: the first reason in line order."""
    judged = rows.withColumn("reason", reason)
    broken = judged.where("reason is not null").groupBy("file").agg(F.min_by("reason", F.struct("_block", "_line")).alias("reason"), F.count("*").alias("n_broken"))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return judged.join(broken.select("file"), "file", "left_anti").select(*kept), broken


def trade_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headerless trade files named by day: good rows and rejected files. One broken row rejects its whole file.

    Row rules: parsable, positive price and quantity, first id not above last, time inside the file's day. Order rules, from
    each line to the next: ids rise, times do not fall, id ranges do not overlap. Lines keep their order when a file is read in several
    blocks: each block's last line is carried to the first of the next. Ids may have gaps, and times may be equal.
    """
    rows = _lines(spark, path, TRADE_SCHEMA)
    rows = rows.withColumn("event_time", ticks_to_time(F.col("ticks"), F.col("day")))
    rows = previous(Blocks(rows, ["file"], ["_line"]), {"_id0": "agg_trade_id", "_t0": "ticks", "_last0": "last_trade_id"}).rows
    reason = _first_reason([
        (F.col("_bad").isNotNull(), "unparsable"), (F.col("agg_trade_id").isNull() | F.col("ticks").isNull() | F.col("price").isNull() | F.col("quantity").isNull() | F.col("is_buyer_maker").isNull() | F.col("is_best_match").isNull(), "missing field"),
        (F.col("price") <= 0, "price not positive"), (F.col("quantity") <= 0, "quantity not positive"), (F.col("first_trade_id") > F.col("last_trade_id"), "ids reversed"),
        (F.to_date("event_time") != F.col("day"), "outside the day"), (F.col("agg_trade_id") == F.col("_id0"), "repeated id"), (F.col("agg_trade_id") < F.col("_id0"), "id falls"),
        (F.col("ticks") < F.col("_t0"), "time falls"), (F.col("first_trade_id") <= F.col("_last0"), "id ranges overlap"),
    ])
    return _verdicts(rows, reason)


def bar_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headerless minute-bar files named by day: good rows and rejected files; bars rise from line to line, minutes may lack."""
    rows = _lines(spark, path, BAR_SCHEMA)
    rows = rows.withColumns({"interval_start": ticks_to_time(F.col("open_ticks"), F.col("day")), "close_time": ticks_to_time(F.col("close_ticks"), F.col("day"))})
    tick = F.when(F.col("day") < F.lit("2025-01-01").cast("date"), 1_000).otherwise(1)
    rows = previous(Blocks(rows, ["file"], ["_line"]), {"_s0": "open_ticks"}).rows
    lowest, highest = F.least("open", "high", "low", "close"), F.greatest("open", "close")
    missing = [F.col(c).isNull() for c in ("open_ticks", "open", "high", "low", "close", "volume", "close_ticks", "quote_volume", "trade_count", "taker_buy_base_volume", "taker_buy_quote_volume")]
    reason = _first_reason([
        (F.col("_bad").isNotNull(), "unparsable"), (reduce(or_, missing), "missing field"), (lowest <= 0, "price not positive"),
        ((F.col("high") < highest) | (F.col("low") > F.least("open", "close")), "crossed range"), (F.col("taker_buy_base_volume") > F.col("volume"), "taker above volume"),
        (F.col("taker_buy_quote_volume") > F.col("quote_volume"), "taker quote above quote volume"), (F.to_date("interval_start") != F.col("day"), "outside the day"),
        (F.unix_micros("interval_start") % 60_000_000 != 0, "misaligned start"), (F.unix_micros("close_time") != F.unix_micros("interval_start") + 60_000_000 - tick, "wrong close time"),
        (F.col("open_ticks") == F.col("_s0"), "repeated bar"), (F.col("open_ticks") < F.col("_s0"), "bar falls"),
    ])
    return _verdicts(rows, reason)


PAGE_SCHEMA = "array<struct<a:bigint,p:string,q:string,f:bigint,l:bigint,T:bigint,m:boolean>>"


def rest_pages(pages: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored page bodies, ``request, page_no, body``: rows, quarantined pages, and facts about each page.

    A page is quarantined if its body does not parse, its ids do not rise, or it starts at or before the end of the page
    before. Facts: rows, next cursor, and why paging stops after it (``short page`` or ``empty page``; null: it goes on).
    """
    parsed = pages.withColumn("items", F.from_json("body", PAGE_SCHEMA))
    ids = F.transform("items", lambda x: x["a"])
    rising = ids == F.array_sort(F.array_distinct(ids))
    w = Window.partitionBy("request").orderBy("page_no")
    checked = parsed.withColumns({"n": F.size("items"), "first_id": F.array_min(ids), "last_id": F.array_max(ids), "rising": rising})
    checked = checked.withColumn("before", F.lag("last_id").over(w))
    problem = F.when(F.col("items").isNull(), "unparsable").when(~F.col("rising"), "ids do not rise").when(F.col("first_id") <= F.col("before"), "overlaps the page before")
    checked = checked.withColumn("problem", problem)
    rows = checked.where("problem is null").select("request", "page_no", F.posexplode("items").alias("row_no", "x")).select(
        "request", "page_no", "row_no", F.col("x.a").alias("agg_trade_id"), F.col("x.p").try_cast("decimal(38,18)").alias("price"), F.col("x.q").try_cast("decimal(38,18)").alias("quantity"), F.timestamp_millis("x.T").alias("event_time"), F.col("x.m").alias("is_buyer_maker")
    )
    facts = checked.select("request", "page_no", F.greatest("n", F.lit(0)).alias("n_rows"), (F.col("last_id") + 1).alias("next_cursor"), F.when(F.col("n") == 0, "empty page").when(F.col("n") < limit, "short page").alias("stop_reason"))
    return rows, checked.where("problem is not null").select("request", "page_no", "problem"), facts


SNAPSHOT_SCHEMA = "struct<serverTime:bigint,symbols:array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string>>>"


def instrument_snapshot(documents: DataFrame, requested: DataFrame) -> DataFrame:
    """Status, base and quote of each requested symbol in each snapshot document: ``observed_at, symbol, source_status, base, quote``.

    A requested symbol that a document lacks has the status ``ABSENT``.
    """
    d = documents.withColumn("d", F.from_json("body", SNAPSHOT_SCHEMA)).select(F.timestamp_millis("d.serverTime").alias("observed_at"), "d.symbols")
    found = d.select("observed_at", F.explode("symbols").alias("x")).select("observed_at", "x.symbol", "x.status", "x.baseAsset", "x.quoteAsset")
    due = d.select("observed_at").crossJoin(requested.select("symbol").distinct())  # a row for each of them is the result
    return due.join(found, ["observed_at", "symbol"], "left").select("observed_at", "symbol", F.coalesce("status", F.lit("ABSENT")).alias("source_status"), F.col("baseAsset").alias("base"), F.col("quoteAsset").alias("quote"))
