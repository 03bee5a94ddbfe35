"""Sinks on Parquet folders: replay-safe appends, pinned reads, chunked writes, content-addressed runs and manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.session import exists
from tidemark.operators.revisions import fingerprint
from tidemark.operators.statistics import ranked


class Conflict(ValueError):
    """The same identity with other content."""


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _folder(batch_id: str) -> str:
    """A batch's folder, whatever its id looks like: neither a number, a date nor a slash in it means anything here."""
    return "b" + hashlib.sha256(batch_id.encode("utf-8", "surrogatepass")).hexdigest()


def append_batch(df: DataFrame, root: str, batch_id: str) -> str:
    """Append a batch once: ``written``, or ``replayed`` if the same content is there already; other content is a Conflict.

    The ledger has one row per batch with the fingerprint of its content, and is written last. A batch has a folder of its
    own, which is replaced: rows left by a writer that died before the ledger are gone once the batch is written again.
    Only batches of the ledger count; ``read_batches`` reads those. Different batches may be written at the same time; of
    one batch there must be one writer at a time. A column ``batch_id`` of ``df`` is replaced; a batch may be empty.
    """
    spark = df.sparkSession
    own = fingerprint(df).first()
    print_ = f"{own.n_rows}:{own.sum1}:{own.sum2}"
    ledger = _read(spark, f"{root}/ledger")
    if ledger is not None:
        seen = ledger.where(F.col("batch_id") == batch_id).select("fingerprint").first()
        if seen is not None:
            if seen.fingerprint != print_:
                raise Conflict(f"batch {batch_id} is stored with other content")
            return "replayed"
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/rows/folder={_folder(batch_id)}")
    spark.createDataFrame([(batch_id, print_)], "batch_id string, fingerprint string").write.mode("append").parquet(f"{root}/ledger")
    return "written"


def read_batches(spark: SparkSession, root: str, pinned: Sequence[str] | None = None) -> DataFrame:
    """The rows of the batches that the ledger lists, or of the ``pinned`` ones among them: a table as it was, whatever came later.

    Batches are folders, so a pinned read scans no others. ``batch_id`` is the text that it was stored under.
    """
    done = spark.read.parquet(f"{root}/ledger").select("batch_id").distinct()
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    if pinned is not None:
        rows = rows.where(F.col("folder").isin(*[_folder(b) for b in pinned]))
    return rows.drop("folder").join(done, "batch_id", "left_semi")


def ingest_revisions(rows: DataFrame, root: str) -> int:
    """Append rows whose content id is not stored yet; returns how many. Ids are hashes of all columns, so replays add nothing."""
    spark = rows.sparkSession
    named = rows.withColumn("revision_id", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).dropDuplicates(["revision_id"])
    stored = _read(spark, root)
    if stored is not None:
        named = named.join(stored.select("revision_id"), "revision_id", "left_anti")
    before = 0 if stored is None else stored.count()
    named.write.mode("append").parquet(root)
    return spark.read.parquet(root).count() - before


def write_chunks(df: DataFrame, root: str, selection_id: str, order: list[str], chunk_rows: int) -> DataFrame:
    """Rows in order, cut into chunks of ``chunk_rows``; returns ``chunk_index, n_rows`` after checking that none is missing or short."""
    spark = df.sparkSession
    numbered = ranked(df, [F.col(c) for c in order], "row_no").withColumn("chunk_index", F.floor(F.col("row_no") / chunk_rows).cast("int"))
    path = f"{root}/selection_id={selection_id}"
    numbered.repartition("chunk_index").sortWithinPartitions("row_no").write.partitionBy("chunk_index").parquet(path)
    sizes = spark.read.parquet(path).groupBy("chunk_index").agg(F.count("*").alias("n_rows"))
    last = F.max("chunk_index").over(Window.partitionBy())  # one row per chunk
    bad = sizes.withColumn("last", last).where((F.col("chunk_index") < F.col("last")) & (F.col("n_rows") != chunk_rows)).limit(1).count()
    n = sizes.agg(F.count("*").alias("n"), F.max("chunk_index").alias("m")).first()
    if bad or (n.n and n.n != n.m + 1):
        raise ValueError("a chunk is missing or short")
    return sizes


def read_chunks(spark: SparkSession, root: str, selection_id: str, first: int, last: int) -> DataFrame:
    return spark.read.parquet(f"{root}/selection_id={selection_id}").where(F.col("chunk_index").between(first, last))


def put_run(df: DataFrame, root: str, index: str | None = None) -> str:
    """Store a run under the hash of its content, once; returns the hash. ``index``: a column that must be 0..n-1.

    A run is a folder of its own, and counts once Spark has marked the folder as whole. What a writer that died has left is
    replaced by the next one. A run without rows is a run.
    """
    own = fingerprint(df).first()
    key = f"{own.n_rows}-{own.sum1}-{own.sum2}"
    if index is not None:
        facts = df.agg(F.count("*").alias("n"), F.countDistinct(index).alias("k"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
        if facts.n and not (facts.n == facts.k and facts.lo == 0 and facts.hi == facts.n - 1):
            raise ValueError(f"{index} is not 0..n-1")
    if not exists(df.sparkSession, f"{root}/run={key}/_SUCCESS"):
        df.write.mode("overwrite").parquet(f"{root}/run={key}")
    return key


def get_run(spark: SparkSession, root: str, key: str) -> DataFrame:
    """A stored run, verified against its hash."""
    if not exists(spark, f"{root}/run={key}/_SUCCESS"):
        raise KeyError(f"run {key} is not stored whole")
    df = spark.read.parquet(f"{root}/run={key}")
    own = fingerprint(df).first()
    if f"{own.n_rows}-{own.sum1}-{own.sum2}" != key:
        raise Conflict(f"run {key} does not match its hash")
    return df


def store_manifests(manifests: DataFrame, root: str) -> DataFrame:
    """Append manifests, one a row, as canonical JSON under their content hash; those that are stored already stay as they are.

    Returns all that are stored: ``content_hash, body``.
    """
    spark = manifests.sparkSession
    body = F.to_json(F.struct(*sorted(manifests.columns)))
    rows = manifests.select(F.sha2(body, 256).alias("content_hash"), body.alias("body")).dropDuplicates(["content_hash"])
    stored = _read(spark, root)
    if stored is not None:
        rows = rows.join(stored.select("content_hash"), "content_hash", "left_anti")
    rows.write.mode("append").parquet(root)
    return spark.read.parquet(root)


def bad_manifests(stored: DataFrame) -> DataFrame:
    """Stored manifests whose body does not give their hash."""
    return stored.where(F.sha2("body", 256) != F.col("content_hash"))


FAILURE = "subject string, family string, reason string, terminal_state string, gate_id string"


def log_failures(failed: DataFrame, root: str) -> None:
    """Append failure records, a row each, to a JSON log."""
    failed.select(*[F.col(c.split()[0]).cast("string") for c in FAILURE.split(", ")]).write.mode("append").json(root)


def failures(spark: SparkSession, root: str, **wanted: str) -> DataFrame:
    df = spark.read.schema(FAILURE).json(root)
    for name, value in wanted.items():
        df = df.where(F.col(name) == value)
    return df


def verified_bars(bars: DataFrame, selection: DataFrame, key: str = "revision_id") -> DataFrame:
    """Bars of a selection, refused unless selection and bars name exactly the same revisions."""
    found = bars.join(selection.select(key), key, "left_semi")
    if selection.select(key).distinct().join(found.select(key), key, "left_anti").limit(1).count():
        raise Conflict("the selection names revisions that the bars lack")
    return found


def observations(bars: DataFrame, complete_only: bool = True) -> DataFrame:
    """Bars as feature observations; of derived bars only complete ones."""
    if complete_only and "complete" in bars.columns:
        bars = bars.where("complete")
    return bars.select("symbol", "interval_start", "interval_end", "available_time", "open", "high", "low", "close", "volume")


def lineage_inputs(features: DataFrame, source: str) -> DataFrame:
    """Feature or state values as event inputs: available when evaluated, with a hash of what they are."""
    return features.select(F.lit(source).alias("source"), "symbol", "evaluation_time", F.col("evaluation_time").alias("available_time"), "value", F.sha2(F.to_json(F.struct(F.lit(source).alias("source"), "symbol", "evaluation_time", "value")), 256).alias("lineage_hash"))
