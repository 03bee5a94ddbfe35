"""A corpus pipeline of five operators: each stage reads what the one before wrote as Parquet.

What all stages do with odd inputs: a null text counts as an empty one, and empty texts are kept (but for copies of one another, of which the
near dedup keeps one); very long texts are worked on whole; repeated rows are documents of their own; nulls in other columns are kept; ties are
broken by id or hash, so results do not depend on the order of rows; an empty table gives an empty one. Columns beyond
the five of ``documents`` are not passed on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, order_minhash, sentencepiece_codec, source_mixing, toxicity
from tidemark.llm.shared import discard, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; labels come from the table, texts to learn from are those of the stage's input.

    A document without a label, or with a null id, is scored like any other. What follows from labels of one kind, or none, is told at ``score_toxicity``.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that 10 documents or more share; ``n_chars`` follows the new text.

    No document is lost: one that loses all its lines, and one whose text is null, has an empty text.
    """
    out = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Equal texts, empty and null ones among them, are one class, and of rows that repeat an id and text one stays. Rows with a null id stay.
    """
    return order_minhash.keep_one_per_class(docs, least=0.8).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source's share follows the square root of its size, shuffled.

    A null source is a source. How often a document comes depends on its id alone, so repeated rows come equally often.
    """
    return source_mixing.mix_sources(docs, temperature=0.5, target_ratio=1.0, seed=17).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document kept, with the check that they decode to its text; an empty text has no ids."""
    out = sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "piece_ids", "n_pieces", "round_trip")


STAGES = [("toxicity", keep_clean), ("line dedup", drop_lines), ("near dedup", keep_distinct), ("source mixing", mix), ("sentencepiece", encode)]

#: The first, third and last stage have no SQL form; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    A stage's table is deleted once the next one is written. The result is lazy and reads the last, which stays.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
