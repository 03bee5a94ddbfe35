"""Source divergence audit: how far the term distributions of the sources of a language lie apart.

Terms are counted once in each task and summed. Kept terms are dealt to blocks; a block holds some terms' counts of all
sources of its language, row-major (a source's terms) and term-major (a term's sources). Each source scatters its terms
through the term-major index into a dense accumulator over its peers. What a source has at a term that it lacks is its
baseline, which the smoothing makes greater than 0: sums start from baselines, and the scatter corrects what both hold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialise, ship

#: Bytes that belong to no term become spaces, A-Z become a-z.
FOLD = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Terms that a task's tables hold before they are passed on.
HELD = 300_000
#: Entries of a block: at least and at most, and between them so many for each pair of sources that it sends.
BLOCK, BLOCK_MOST, PER_PAIR = 50_000, 4_000_000, 4
#: Postings looked at together.
STEP = 1 << 20
SCALE, SMOOTH = 1_000_000_000, 5


def count_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``lang, source, term, n long, n_docs long``: occurrences, and documents that hold the term.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z (and no other letter) in lower case. Null text, lang and source
    count as empty. Each group has a row of its own with a null term and no counts, so a group without terms is there too.
    Tasks send one row per group and term for each ``HELD`` terms that they have met, whatever their number in a text.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        told: set[tuple[str, str]] = set()

        def rows() -> pd.DataFrame:
            out = [(lang, source, term, n, holders[term]) for (lang, source), (times, holders) in tables.items() for term, n in times.items()]
            out += [(lang, source, None, 0, 0) for lang, source in tables if (lang, source) not in told]
            told.update(tables)
            tables.clear()
            return pd.DataFrame(out, columns=["lang", "source", "term", "n", "n_docs"])

        held = 0
        for batch in batches:
            for lang, source, body in zip(batch["lang"], batch["source"], batch["body"], strict=True):
                times, holders = tables.setdefault((lang, source), (Counter(), Counter()))
                words, before = bytes(body).translate(FOLD).split(), len(times)
                times.update(words)
                holders.update(set(words))
                held += len(times) - before + 1
                if held >= HELD:
                    yield rows()
                    held = 0
        if tables:
            yield rows()

    blank = F.lit("")
    slim = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce(F.col(text), blank).cast("binary").alias("body"))
    parts = slim.mapInPandas(count, "lang string, source string, term binary, n long, n_docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def smoothed(count: str, total: str, terms: str) -> str:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) in decimals, which no count of this world exceeds."""
    return f"1 + cast(({SCALE} * cast({count} + {SMOOTH} as decimal(28,0))) div cast({total} + {SMOOTH} * {terms} as decimal(28,0)) as long)"


def accumulate(row: np.ndarray, term: np.ndarray, share: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source its sums of ``|p - q|`` with every source, over the terms of a block.

    ``row, term, share``: one entry for each term that a source holds; ``base``: each source's share at terms that it lacks.
    All sums are of 64-bit integers. The accumulator of source i starts from baselines at all terms, takes in own terms
    against the peers' baselines and the peers' terms against the own one, and is corrected where both hold a term.
    """
    if not len(row):
        for i in range(len(base)):
            yield i, np.zeros(len(base), np.int64)
        return
    n_terms, n = int(term.max()) + 1, len(base)
    order = np.lexsort((share, row))  # row-major, by share
    r_row, r_term, r_share = row[order], term[order], share[order]
    r_begin = np.searchsorted(r_row, np.arange(n + 1))
    r_sum = np.concatenate([[0], np.cumsum(r_share)])
    r_key = (r_row.astype(np.int64) << 31) | r_share
    order = np.argsort(term, kind="stable")  # term-major
    t_row, t_share = row[order], share[order]
    t_begin = np.searchsorted(term[order], np.arange(n_terms + 1))
    peers, sizes = np.arange(n, dtype=np.int64), np.diff(r_begin)
    for i in range(n):
        a, b = r_begin[i], r_begin[i + 1]
        apart = np.abs(base[i] - base)
        acc = apart * (n_terms - sizes - (b - a))
        # own terms against what each peer has at terms that it lacks
        below = a + np.searchsorted(r_share[a:b], base)
        acc += (r_sum[b] - r_sum[below]) - base * (b - below) + base * (below - a) - (r_sum[below] - r_sum[a])
        # each peer's terms against the own baseline
        below = np.searchsorted(r_key, (peers << 31) | base[i])
        acc += (r_sum[r_begin[1:]] - r_sum[below]) - base[i] * (r_begin[1:] - below) + base[i] * (below - r_begin[:-1]) - (r_sum[below] - r_sum[r_begin[:-1]])
        # what both hold
        lengths = t_begin[r_term[a:b] + 1] - t_begin[r_term[a:b]]
        ends = np.cumsum(lengths)
        at = 0
        while at < b - a:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            size = lengths[at:to]
            post = np.arange(size.sum()) + np.repeat(t_begin[r_term[a + at : a + to]] - (np.cumsum(size) - size), size)
            own, peer, theirs = np.repeat(r_share[a + at : a + to], size), t_row[post], t_share[post]
            np.add.at(acc, peer, np.abs(own - theirs) - np.abs(own - base[peer]) - np.abs(base[i] - theirs) + apart[peer])
            at = to
        acc[i] = 0
        yield i, acc


def pair_sums(entries: DataFrame, groups: DataFrame, block: int | None = None) -> DataFrame:
    """``lang, source, item, value``: the sum of ``|p - q|`` over all kept terms, for each source and each other source.

    ``entries``: ``lang, source, term, share``; ``groups``: ``lang, source, base``, all groups. Entries are dealt to blocks by
    language and term; every block of a language gets the language's groups, and sends one row for each pair of them, whose
    sums over blocks are the result. ``block``: entries a block; by default as many as the pairs are worth.
    """
    spark = entries.sparkSession
    ship(spark)
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    block = block or min(BLOCK_MOST, max(BLOCK, PER_PAIR * widest * widest))
    blocks = max(1, -(-entries.count() // block))
    dealt = entries.withColumn("block", F.expr(f"pmod(xxhash64(term), {blocks})").cast("int"))
    known = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def sums(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(groups["source"].to_numpy(dtype=object))
        base = groups.set_index("source")["base"].reindex(names).to_numpy(np.int64)
        row = pd.Index(names).get_indexer(entries["source"])
        term = pd.factorize(entries["term"])[0]
        parts = [pd.DataFrame({"lang": groups["lang"].iat[0] if len(groups) else "", "source": names[i], "item": np.delete(names, i), "value": np.delete(acc, i)}) for i, acc in accumulate(row, term, entries["share"].to_numpy(np.int64), base)]
        return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})

    of_blocks = dealt.groupBy("lang", "block").cogroup(known.groupBy("lang", "block")).applyInPandas(sums, "lang string, source string, item string, value long")
    return of_blocks.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """Distances of sources from one another and the terms that set each apart: ``lang, source, part, item, value long, rank int``.

    A language keeps the V terms that at least ``least_docs`` of its documents hold. A group (language and source), and each
    language, gives a kept term ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, N being the group's occurrences of kept terms.
    Part ``pair``: for each other source of the language the sum of ``|p - q|`` over all kept terms, 0 where the language keeps
    none. Part ``term``: terms that the group holds with p above the language's q, with ``p - q``, the first ``most_terms``.
    Ranks go by value, falling, then by item in UTF-8 order.

    Null text, lang and source count as empty strings; a group without terms is a group. Repeated rows are documents of
    their own, and ties of values are broken by item, so the result does not depend on the order of rows. An empty table and a language of one source
    give no pairs. Other columns are not used. A source that holds a third of all documents costs a row for each term and
    task; no rows of a pair of postings are made. Counts are exact at any size (shares are computed in decimals).
    """
    counts = materialise(count_terms(docs, text), "term-counts")
    kept = materialise(
        counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_lang")).where(F.col("n_docs") >= least_docs).drop("n_docs"), "terms-kept"
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("total_lang"))
    held = materialise(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "terms-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "n_terms", "total_lang"])
    base = F.expr(f"case when n_terms > 0 then {smoothed('0', 'total', 'n_terms')} else 0 end")
    groups = materialise(groups.withColumn("base", base), "term-groups")
    shares = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", F.expr(smoothed("n", "total", "n_terms")).alias("share"), F.expr(smoothed("n_lang", "total_lang", "n_terms")).alias("usual")
    )
    shares = materialise(shares, "term-shares")
    discard(counts, kept, held)
    pairs = pair_sums(shares.select("lang", "source", "term", "share"), groups.select("lang", "source", "base"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    above = shares.where("share > usual").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("usual")).alias("value"))
    return ranked.unionByName(above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms))
