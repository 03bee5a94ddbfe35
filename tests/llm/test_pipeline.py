"""The pipeline against a plain version without Spark, and its stages on odd inputs."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, SCHEMA, brute_classes

from tidemark.llm import toxicity


def plain_lines(texts):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    return ["\n".join(x for x in t.split("\n") if held[key(x)] < 10) for t in texts]


def plain_copies(rows):
    """How often each document is drawn: the inverse of a Poisson distribution at a hashed number."""
    sizes = Counter(source for _, source in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    out = {}
    for doc_id, source in rows:
        rate = math.sqrt(sizes[source]) / total * len(rows) / sizes[source]
        pieces = max(1, math.ceil(rate / 16))
        n = 0
        for k in range(1, pieces + 1):
            u, p, cdf = int(hashlib.md5(f"17:{doc_id}:{k}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate / pieces), math.exp(-rate / pieces)
            i = 0
            while u >= cdf:
                i += 1
                p *= rate / pieces / i
                cdf += p
                n += 1
        out[doc_id] = n
    return out


def test_run_equals_a_plain_version(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    local = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(d, t or "", s) for d, t, s in zip(local.doc_id, local.text, local.source, strict=True) if scorer(t) < 0.7]
    rows = [(d, t, s) for (d, _, s), t in zip(rows, plain_lines([t for _, t, _ in rows]), strict=True)]
    classes = brute_classes([(d, t) for d, t, _ in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    copies = plain_copies([(d, s) for d, _, s in rows])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter({(d, tuple(library.encode(t))): copies[d] for d, t, _ in rows if copies[d]})
    got = Counter((r.doc_id, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(rows) < len(local)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_inputs(spark, sf, name, stage):
    """Nulls, empty and odd texts, repeated rows and ids, clashing columns, and an empty table."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 0), (3, "a", "en", "s", 0), (5, "another text", None, None, None), (None, "a", None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    clash = odd.withColumns({"h1": F.lit("x"), "row": F.lit(1), "node": F.lit(2), "toxic_label": F.lit(3), "mix_rate": F.lit(4), "N_Lines": F.lit(5)})
    last = stage is corpus_pipeline.STAGES[-1][1]
    for docs in (odd, clash):
        out = stage(spark, docs, sf)
        assert out.columns == (["doc_id", "piece_ids", "n_pieces", "round_trip"] if last else corpus_pipeline.COLUMNS)
        n = out.count()
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name in ("toxicity", "line dedup", "sentencepiece"):
            assert n == len(rows)
        elif name == "near dedup":
            assert kept == {r[0] for r in rows} - {1} and n == len(kept) + 1  # two texts under id 5 are two documents
        assert kept <= {r[0] for r in rows}
    assert stage(spark, odd.limit(0), sf).count() == 0
