"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by frequency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import counts_of, is_common
from tidemark.llm.shared import ship

#: Characters whose texts are joined to one batch of pre-tokens.
BLOCK = 2_000_000


def _count_block(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text: a table of (document, stretch, frequency), joined to the pieces of the distinct stretches.

    A stretch is what stands between white space: one pre-token, or a few, such as a word and its comma.
    """
    counts = counts_of(path)
    code: dict[str, int] = {}
    docs, words, times = [], [], []
    out = np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        if not is_common(text):
            out[d] = counts.of_text(text)
            continue
        own = Counter(text.lower().split())
        docs.append(np.full(len(own), d))
        words += [code.setdefault(w, len(code)) for w in own]
        times += own.values()
    if words:
        pieces = counts.of(list(code))
        out += np.bincount(np.concatenate(docs), pieces[words] * np.array(times), len(texts)).astype(np.int64)
    return out


def token_count_column(text: Column, tokenizer_path: str, spark) -> Column:
    ship(spark)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = [t or "" for t in texts]
            out, begin, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > BLOCK or i == len(texts) - 1:
                    out.append(_count_block(texts[begin : i + 1], tokenizer_path))
                    begin, size = i + 1, 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return count(text)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (more than limit)``.

    The counts are those of the tokenizers library for a word-end BPE file that lower-cases and drops white space, without
    added special tokens; a special token's string inside a text counts as the library counts it. A null text is an empty
    one: no bytes, no tokens. Repeated rows are counted alike, very long texts whole; no row is added or lost, and other
    columns are not used.

    The per-document frequencies meet the piece counts inside each task. As rows of a shuffle they would be many times the
    size of the text (most pre-tokens of a document occur once); inside a task they cost no network and no disk, and each
    worker asks the library once for each distinct pre-token that it has met.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count_column(F.col("text"), tokenizer_path, docs.sparkSession).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
