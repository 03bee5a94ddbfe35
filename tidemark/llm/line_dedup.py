"""Line dedup: drop the lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialise, text_key, with_columns

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines holding such a character would be changed by lower() beyond A-Z.
WIDE_UPPER = r"[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}&&[^\x00-\x7F]]"


def line_key(line: Column) -> Column:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z (and no other letter) in lower case."""
    return F.when(line.rlike(WIDE_UPPER), F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)).otherwise(F.lower(F.btrim(line, F.lit(STRIP))))


def _hashes(text: Column, min_chars: int) -> Column:
    """For each line 128 bits of its key, or null where the key is shorter than ``min_chars`` code points."""

    def one(line: Column) -> Column:
        key = line_key(line)
        h1, h2 = text_key(key)
        return F.when(F.char_length(key) >= min_chars, F.struct(h1.alias("k1"), h2.alias("k2")))

    return F.transform(F.split(text, "\n", -1), one)


def _distinct_texts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``h1, h2, n, keys``: each distinct text with its number of rows and its lines' key hashes, written once.

    Copies meet in an aggregation with partial results, so a text that makes up a third of the rows costs a row per task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2 = text_key(body)
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), _hashes(body, min_chars).alias("keys"))
    return materialise(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("keys").alias("keys")), "line-keys")


def _common(texts: DataFrame, min_docs: int) -> DataFrame:
    lines = texts.select("n", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    return lines.groupBy("key.k1", "key.k2").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """128-bit hashes of the keys found in at least ``min_docs`` documents: ``k1 long, k2 long, n_docs long``.

    Each row of ``docs`` is one document. Within a document a key counts once, so the counting needs one
    aggregation with partial sums; a line that sits in a third of all documents costs one row per task.
    """
    return _common(_distinct_texts(docs, text, min_chars), min_docs)


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Remove, in every document, all lines whose key at least ``min_docs`` documents hold.

    Returns the columns of ``docs`` with ``kept_text string, n_lines long, n_dropped long`` (these replace columns
    of the same names, in any case of letters). Lines are split at ``\\n`` and kept lines are joined by it, in their order. A null or empty
    text is one empty line, which is too short to be dropped: its ``kept_text`` is empty. Where all lines go,
    ``kept_text`` is empty as well. Repeated rows are documents of their own. No row is added or lost.

    Lines are cut and hashed once per distinct text (128-bit hash), and which positions go is gathered once per distinct
    text and joined back to the rows: text crosses the network once at most. The common keys and the gathered positions
    are written before they are joined. So Spark knows their size: small ones are broadcast; and beyond that the shuffles
    feed the joins directly, which lets adaptive execution split a hot line or a hot text.
    """
    texts = _distinct_texts(docs, text, min_chars)
    common = materialise(_common(texts, min_docs).select("k1", "k2"), "line-common")
    lines = texts.select("h1", "h2", F.posexplode("keys").alias("pos", "key")).where("key is not null").select("h1", "h2", "pos", "key.k1", "key.k2")
    gone = materialise(lines.join(common, ["k1", "k2"]).groupBy("h1", "h2").agg(F.collect_list("pos").alias("gone")), "line-gone")
    discard(common, texts)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    h1, h2 = text_key(F.col("body"))
    parts = F.split(F.col("body"), "\n", -1)
    joined = rows.withColumns({"h1": h1, "h2": h2}).join(gone, ["h1", "h2"], "left").withColumn("n_all", F.size(parts).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_all").cast("int") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return with_columns(joined, "row", {"kept_text": kept, "n_lines": F.col("n_all"), "n_dropped": F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long"))})
