"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import with_columns

#: A Poisson variable with a larger mean is drawn as a sum of independent ones, so that exp(-mean) stays far from 0.
PIECE = 16.0
#: Terms of the distribution that are summed for one piece; what lies beyond has a probability below 2**-52.
TERMS = 96
#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by ``:``."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(2**52))


def poisson_table(mean: Column) -> Column:
    """The Poisson(``mean``) distribution function at 0, 1, ... (mean at most 16)."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["cdf"])


def poisson_inverse(u: Column, cdf: Column) -> Column:
    """The smallest count whose distribution function, as in ``poisson_table``, exceeds ``u``."""
    return F.size(F.filter(cdf, lambda x: u >= x))


def source_rates(docs: DataFrame, source: str = "source", temperature: float = 0.5, target_ratio: float = 1.0, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean repetitions of a document of each source: ``source, n_docs, weight, rate``.

    ``weights`` gives each source's share of the result (sources that it lacks get 0); without it the share is in
    proportion to ``n_docs ** temperature``. The expected size of the result is ``target_ratio`` times the input.
    A null source is a source of its own, weighed like the others, or by the key None.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        counts = counts.withColumn("raw", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
        counts = counts.withColumn("raw", raw)
    total = counts.agg(F.sum("raw").alias("raw_all"), F.sum("n_docs").alias("docs_all"))
    counts = counts.crossJoin(F.broadcast(total))  # one row
    share = F.when(F.col("raw_all") > 0, F.col("raw") / F.col("raw_all")).otherwise(F.lit(0.0))
    return counts.select("source", "n_docs", share.alias("weight"), (share * F.lit(float(target_ratio)) * F.col("docs_all") / F.col("n_docs")).alias("rate"))


def mix_sources(
    docs: DataFrame, key: str = "doc_id", source: str = "source", temperature: float = 0.5, target_ratio: float = 1.0,
    weights: dict[str, float] | None = None, seed: int = 17, shuffle: bool = True,
) -> DataFrame:
    """Repeat each document a Poisson number of times, so that sources meet their target weights, and shuffle all copies.

    Returns the columns of ``docs`` with ``copy_no long`` (from 0) and ``rate double`` (these replace columns of the
    same names), one row per copy. A document's count is drawn by inverting Poisson(rate) at a number hashed from
    the seed and its key: it depends neither on other documents nor on how the rows are dealt. Repeated rows share
    key and draw. A null key or source is hashed as an empty one. Documents drawn 0 times leave: this is sampling by
    design. With ``shuffle`` the copies of the whole table are dealt out and ordered by a hash of seed, key and copy number.

    The rates are one row per source, with the distribution function that belongs to the rate, so no row computes it;
    they are broadcast up to 10,000 sources and joined by a shuffle beyond. The shuffle deals copies to tasks by a hash
    and sorts them within: unlike a sort by ranges it needs no first pass over the input for bounds.
    """
    rates = source_rates(docs, source, temperature, target_ratio, weights)
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE).cast("int"), F.lit(1))
    rates = rates.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), pieces.alias("mix_pieces"), poisson_table(F.col("rate") / pieces).alias("mix_cdf"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    packed = docs.select(F.struct("*").alias("row"))
    joined = packed.join(rates, F.col("row")[source].eqNullSafe(F.col("mix_source")))
    name = F.coalesce(F.col("row")[key].cast("string"), F.lit(""))
    count = F.aggregate(F.sequence(F.lit(1), F.col("mix_pieces")), F.lit(0), lambda acc, k: acc + poisson_inverse(hash_uniform(F.lit(seed), name, k), F.col("mix_cdf")))
    copies = joined.withColumn("mix_n", count).drop("mix_cdf").where("mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_n").cast("long") - 1)))
    if shuffle:
        order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("mix_copy").cast("string")).cast("binary"))
        copies = copies.withColumn("mix_order", order).repartition("mix_order").sortWithinPartitions("mix_order")
    return with_columns(copies, "row", {"copy_no": F.col("mix_copy"), "rate": F.col("mix_rate")})
