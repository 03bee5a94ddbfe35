"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import delete, discard, materialise, shared_folder, ship

__all__ = ["delete", "discard", "held_out", "materialise", "shared_path", "ship", "table", "text_key", "with_columns"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: two differently seeded 64-bit hashes."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def with_columns(packed: DataFrame, row: str, added: dict[str, Column]) -> DataFrame:
    """Unpack the struct ``row`` beside the columns ``added``; an added column replaces those of the same name, whatever their case."""
    taken = {n.lower() for n in added}
    old = [f for f in packed.schema[row].dataType.names if f.lower() not in taken]
    return packed.select(*[F.col(row)[f].alias(f) for f in old], *[c.alias(n) for n, c in added.items()])
