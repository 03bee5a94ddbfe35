"""A content-addressed store of token ids: unique chunks, document recipes, Merkle manifests.

A rolling hash over the ids cuts every document's stream into chunks, so equal passages give equal chunks. Unique chunks
are stored once under their digest; a recipe lists a document's chunks in order; the manifest of a recipe file holds the
Merkle root of its documents. Files are Parquet in the shared folder:

``chunks``   digest binary, n_ids int, ids binary (little-endian, 16 bits an id where all ids fit, else 32)
``recipes``  part, block, doc_id, within, n_tokens, root binary, digests array<binary>; files and rows in ascending doc_id order
``manifest`` part, before, n_docs, n_ids, root; a document's ids start at ``before + within``
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.pretokens import as_texts, bytes_of, ids_of
from tidemark.llm.shared import delete, shared_path, ship

#: Ids that the rolling hash sees, and bounds of a chunk's length; a cut falls after one id in ``MEAN`` on average.
SPAN, LEAST, MEAN, MOST = 16, 128, 512, 4096
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: Bytes of text that are encoded together, about; documents of one leaf of a range's Merkle tree.
BLOCK, LEAF = 1_000_000, 1024


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: where a polynomial hash of the last ``SPAN`` ids is 0 modulo ``MEAN``."""
    h, power, k = (ids.astype(np.uint64) + np.uint64(1)) * _MIX, _BASE, 1
    while k < SPAN:  # the hash of 2 k ids from those of k
        longer = h.copy()
        longer[k:] += h[:-k] * power
        h, power, k = longer, np.uint64(int(power) ** 2 % 2**64), 2 * k
    h ^= h >> np.uint64(32)
    h *= _MIX
    return np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1


def ends_of(marked: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids, at marks that are ``LEAST`` to ``MOST`` ids apart."""
    ends, last = [], 0
    for e in [*marked, n]:
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST or (e == n and last < n):
            ends.append(e)
            last = e
    return ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document. A mark before ``LEAST`` ids is never an end, so none depends on what precedes a document."""
    return ends_of(marks(ids).tolist(), len(ids))


def digest(ids: np.ndarray) -> bytes:
    return hashlib.sha256(np.ascontiguousarray(ids, "<u4")).digest()[:16]


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest()[:16] for i in range(0, len(level), 2)]
    return level[0]


def _apply(images: list[int], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= images[i]
        x >>= 1
        i += 1
    return out


def _one_zero_byte() -> list[int]:
    def push(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    return [push(1 << i) for i in range(32)]


@cache
def _zeros(k: int) -> np.ndarray:
    """The linear map that ``2**k`` zero bytes apply to a crc32, as the images of the 256 values of each of its bytes."""
    images, tables = _one_zero_byte(), np.zeros((4, 256), np.uint32)
    for _ in range(k):
        images = [_apply(images, x) for x in images]
    for bit, image in enumerate(images):
        tables[bit // 8, np.arange(256) >> bit % 8 & 1 == 1] ^= np.uint32(image)
    return tables


def crc_push(crcs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``n`` further bytes make of each crc32, but for their own crc32, which is to be added."""
    crcs, k = crcs.astype(np.uint32), 0
    while (left := n >> k).any():
        own = np.flatnonzero(left & 1)
        x = crcs[own]
        crcs[own] = np.bitwise_xor.reduce([table[x >> np.uint32(8 * i) & np.uint32(255)] for i, table in enumerate(_zeros(k))])
        k += 1
    return crcs


def crc_join(first: int, second: int, n_second: int) -> int:
    """crc32 of two byte strings, one after the other, from the crc32 of each."""
    return int(crc_push(np.array([first]), np.array([n_second]))[0]) ^ second


@dataclass
class Store:
    """Paths of one store, and the session that reads it."""

    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    def recipes(self) -> DataFrame:
        """Recipes with ``start``: the ids of all documents before. The manifest has a row per range of documents."""
        own = self.spark.read.parquet(f"{self.path}/recipes")
        return own.join(F.broadcast(self.manifest().select("part", "before")), "part").withColumn("start", F.col("before") + F.col("within")).drop("before")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of a batch (null: empty) in blocks of about ``BLOCK`` bytes."""
    texts, begin = as_texts(batch.column(1)), 0
    bounds = bytes_of(texts)[1]
    while begin < len(texts):
        end = min(len(texts), int(np.searchsorted(bounds, bounds[begin] + BLOCK, "right")))
        yield batch.column(0).slice(begin, end - begin), texts.slice(begin, end - begin)
        begin = end


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, partitions: int | None = None) -> Store:
    """Encode every whole text, append ``end_id``, and store the ids; see the module for the files.

    A null text is an empty one: its stream is the end id alone. Repeated rows have recipes of their own, and share
    chunks. Rows are stored in ascending order of ``doc_id``, of any type that sorts (nulls first); ties go by the Merkle root of their ids.
    An empty table gives empty files. Columns other than ``doc_id`` and ``text`` are not used.

    Texts are tokenised once, into a table of recipes with the chunks' bytes; its chunks are shuffled by digest,
    which keeps one of each (first in each task, then over all), and only digests are sorted by document, once: a recipe
    holds its offset within its range of documents, the manifest that of the range.
    """
    spark = docs.sparkSession
    ship(spark)
    path = shared_path(spark, "id-store")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, written = ids_of(tokenizer_path), set()
        names = ["doc_id", "n_tokens", "root", "digests", "digest", "n_ids", "ids"]
        kinds = [None, pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            for keys, texts in _blocks(batch):
                flat, sizes = encoder.encode_block(texts)
                flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
                bounds = np.append(0, np.cumsum(sizes + 1))
                marked = marks(flat)
                own = np.searchsorted(marked, bounds, "right")
                recipes, roots, new = [], [], []
                for i, begin in enumerate(bounds[:-1].tolist()):
                    digests, at = [], begin
                    for end in ends_of((marked[own[i] : own[i + 1]] - begin).tolist(), int(sizes[i]) + 1):
                        part = flat[at : begin + end]
                        key = digest(part)
                        digests.append(key)
                        if key not in written:
                            if len(written) > 200_000:
                                written.clear()
                            written.add(key)
                            new.append((key, len(part), packed(part)))
                        at = begin + end
                    recipes.append(digests)
                    roots.append(merkle_root(digests))
                kinds[0] = keys.type
                filled = [keys, pa.array(sizes + 1), pa.array(roots, pa.binary()), pa.array(recipes, kinds[3])]
                yield pa.RecordBatch.from_arrays(filled + [pa.nulls(len(keys), t) for t in kinds[4:]], names)
                filled = [pa.array(column, t) for column, t in zip(zip(*new, strict=True), kinds[4:], strict=True)] if new else [pa.nulls(0, t) for t in kinds[4:]]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(new), t) for t in kinds[:4]] + filled, names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = total = 0
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            within = total + np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(within), pa.array((rows + np.arange(len(sizes))) // LEAF), *batch.columns], ["within", "block", *batch.schema.names])
            rows, total = rows + len(sizes), total + int(sizes.sum())

    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, root binary, digests array<binary>, digest binary, n_ids int, ids binary")
    raw.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(raw.schema).parquet(f"{path}/staged")
    chunks = staged.where("digest is not null").select("digest", "n_ids", "ids")
    chunks.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staged.where("digests is not null").select("doc_id", "n_tokens", "root", "digests")
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the root lets documents of one id, or of none, be dealt to several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc()]
    ordered = recipes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = ordered.mapInArrow(place, f"within long, block long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ordered.schema)}")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/staged")

    manifest = _manifest(spark.read.schema(placed.schema).parquet(f"{path}/recipes"))
    # one row per range: at most n rows meet in the window without a key
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    manifest.withColumn("before", before).write.parquet(f"{path}/manifest")
    return Store(spark, path)


def _manifest(recipes: DataFrame) -> DataFrame:
    """Per range of documents: their number, their ids, and the Merkle root over the roots of ``LEAF`` documents each."""
    blocks = recipes.groupBy("part", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("within", "root"))), lambda x: F.hex(x["root"])), ""), 256).alias("leaf"))
    return blocks.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("root"))


def verify_manifest(store: Store) -> DataFrame:
    """Ranges whose recipes no longer give the manifest's root: empty for a sound store."""
    return store.manifest().drop("before").exceptAll(_manifest(store.recipes()))


def read_documents(store: Store) -> DataFrame:
    """The stored ids again, ``doc_id, start, ids array<long>``, each document joined from its chunks in order."""
    ship(store.spark)

    @F.pandas_udf("array<long>")
    def ids(data: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([unpacked(d, k).astype(np.int64).tolist() for d, k in zip(data, n, strict=True)])

    parts = store.recipes().select("doc_id", "start", F.posexplode("digests").alias("seq", "digest")).join(store.chunks(), "digest")
    whole = parts.select("doc_id", "start", "seq", ids("ids", "n_ids").alias("ids")).groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def check_documents(store: Store) -> DataFrame:
    """Every document as the files give it: ``doc_id, start, n_tokens, ids_crc32, verified``.

    Each stored chunk is read once: its ids are decoded, their digest is compared with its address, and their crc32 is
    taken. A document's crc32 follows from those of its chunks (crc32 is linear), so that digests, not ids, meet in the
    join. ``verified`` tells that all chunks are there, sound, and of the recorded length, and that the Merkle root of the
    recipe's digests is the recorded one.
    """
    ship(store.spark)

    @F.pandas_udf("crc long, sound boolean")
    def examine(key: pd.Series, n: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = [(zlib.crc32(ids.tobytes()), digest(ids) == k) for k, ids in ((k, unpacked(d, m)) for k, m, d in zip(key, n, data, strict=True))]
        return pd.DataFrame(rows, columns=["crc", "sound"])

    @F.arrow_udf("crc long, n long, sound boolean")
    def combine(parts: pa.Array, root: pa.Array) -> pa.Array:
        bounds, own = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
        sizes = np.diff(bounds)
        order = np.lexsort((own.field("seq").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)))
        column = lambda name, other: pc.fill_null(own.field(name), other).to_numpy(zero_copy_only=False)[order]
        lost, sound, n = own.field("crc").is_null().to_numpy(zero_copy_only=False)[order], column("sound", False), column("n_ids", 0).astype(np.int64)
        total, begins = np.add.reduceat(n, bounds[:-1]), bounds[:-1]
        after = np.repeat(total + np.cumsum(n)[begins] - n[begins], sizes) - np.cumsum(n)
        crc = np.bitwise_xor.reduceat(crc_push(column("crc", 0), 4 * after), begins).astype(np.int64)
        digests = own.field("digest").to_numpy(zero_copy_only=False)[order]
        roots = [merkle_root(digests[a:b].tolist()) == top for a, b, top in zip(begins.tolist(), bounds[1:].tolist(), root.to_pylist(), strict=True)]
        some = np.logical_or.reduceat(lost, begins)  # a chunk is lost
        fit = np.logical_and.reduceat(sound, begins) & np.array(roots, bool) & ~some
        return pa.StructArray.from_arrays([pa.array(crc, mask=some), pa.array(total, mask=some), pa.array(fit)], ["crc", "n", "sound"])

    facts = store.chunks().select("digest", "n_ids", examine("digest", "n_ids", "ids").alias("x")).select("digest", "n_ids", "x.crc", "x.sound")
    parts = store.recipes().select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("seq", "digest"))
    # a digest that very many documents hold sits on the exploded side alone, whose shuffle feeds the join directly: it can be split
    met = parts.join(facts.hint("merge"), "digest", "left")
    own = [F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root")]
    whole = met.groupBy("start").agg(*own, F.collect_list(F.struct("seq", "digest", "n_ids", "crc", "sound")).alias("parts"))
    joined = whole.withColumn("x", combine("parts", "root"))
    return joined.select("doc_id", "start", "n_tokens", F.col("x.crc").alias("ids_crc32"), (F.col("x.sound") & F.coalesce(F.col("x.n") == F.col("n_tokens"), F.lit(False))).alias("verified"))
