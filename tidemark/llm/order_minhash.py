"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment.

A sketch of a document takes, under a random order of its occurrence-labelled shingles, the three smallest and keeps
them in text order: two documents agree in it if they share these shingles and have them in the same order. Sixteen
sketches of each distinct text make its buckets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialise, ship, text_key, with_columns

WORD = re.compile(r"\w+")
SHINGLE = 5
SKETCHES, TAKEN = 16, 3
#: For the order of shingles alone, which bears on speed and not on results: texts counted, and shingles told apart as frequent.
ORDER_TEXTS, ORDER_SHINGLES = 200_000, 1 << 17
#: Share of a round's comparisons that must be links for another round; the exact pass takes over below.
WORTH = 0.05
#: Rows of one key that a task of the pair join meets at most on its salted side.
SALT_ROWS = 512
_P = np.uint64(0x100000001B3)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text, in order; a text of fewer words is one shingle, one of none has none."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = pd.util.hash_array(np.array(words, dtype=object), categorize=True)
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _P + w[i : len(w) - k + 1 + i]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its occurrence, as one hash: all are then distinct."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return h
    at = np.arange(len(s))
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    out = h.copy()
    out[order] = np.where(number > 0, _mix(s + number.astype(np.uint64) * _SEEDS[0]), s)
    return out


def sketch(text: str | None) -> tuple[int, list[int]]:
    """The number of shingles of a text and its Order MinHash sketches as signed 64-bit numbers; none without words."""
    h = shingles(text)
    if not len(h):
        return 0, []
    h = labelled(h)
    take, out = min(TAKEN, len(h)), []
    for group in range(0, SKETCHES, 4):  # four orders at once; the matrix stays small for long texts
        keys = _mix(h[None, :] ^ _SEEDS[group : group + 4, None])
        low = np.argpartition(keys, take - 1, axis=1)[:, :take] if take < len(h) else np.tile(np.arange(len(h)), (4, 1))
        low.sort(axis=1)  # text order
        value = np.full(len(low), np.uint64(take))
        for i in range(take):
            value = _mix(value * _P + h[low[:, i]])
        out += value.view(np.int64).tolist()
    return len(h), out


def aligned_similarity(a: np.ndarray, b: np.ndarray, band: int, least: float) -> float:
    """Share of the distinct shingles of both texts that a banded alignment matches in order; 0 where it is below ``least``.

    Occurrence-labelled shingles are distinct, so the longest alignment is the longest increasing run of matched
    positions. Matches more than ``band`` positions from the middle diagonal do not count. ``a``, ``b``: labelled shingles.
    """
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    here = np.flatnonzero(b[order[at]] == a)
    if len(here) < least * (len(a) + len(b) - len(here)):
        return 0.0
    there = order[at[here]]
    shift = there - here
    near = np.abs(shift - int(np.median(shift))) <= band
    there = there[near]
    if len(there) > 1 and not (np.diff(there) > 0).all():
        tails: list[int] = []
        for x in there.tolist():
            i = bisect_left(tails, x)
            tails[i : i + 1] = [x]
        matched = len(tails)
    else:
        matched = len(there)
    s = matched / (len(a) + len(b) - matched)
    return s if s >= least else 0.0


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``node, h1, h2, rep, n_copies, size, sketches``: one row per distinct text, written once.

    A text is known by 128 bits (``h1``, ``h2``); ``node`` numbers it, ``rep`` is the smallest id that it stands under,
    ``size`` the number of its shingles. Copies meet in an aggregation with partial results, so a text that makes up a
    third of the rows costs a row per task.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("size int, sketches array<long>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch(t) for t in texts], columns=["size", "sketches"])

    h1, h2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), sketches("text").alias("own"))
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("own").alias("own"))
    # numbers drawn in the one write that keeps them
    return materialise(texts.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", "n_copies", "own.size", "own.sketches"), "omh-texts")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, band: int) -> DataFrame:
    """The pairs ``a, b`` whose texts align: joined to the texts of both sides, judged in batches.

    Both joins read tables that are written, so adaptive execution splits the pairs of a leader that very many texts have.
    """

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        last, own, out = None, None, []
        for x, y in zip(left, right, strict=True):
            if x is not last and x != last:
                last, own = x, labelled(shingles(x))
            out.append(aligned_similarity(own, labelled(shingles(y)), max(band, len(own) // 4), least) > 0)
        return pd.Series(out, dtype=bool)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # texts are the larger side at any size that matters: the same join at every size
    return pairs.hint("merge").join(right, "b").hint("merge").join(left, "a").where(similar("text_a", "text_b")).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, class``: the smallest node that each node of ``a, b`` is linked to, over any number of links.

    Labels spread along the links and then jump to their label's label; each round is written to the shared folder. The
    links come as stars, so a few rounds do; the loop ends when a round changes nothing.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("class")), name)
    while True:
        heard = both.join(labels.select(F.col("node").alias("v"), F.col("class").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        spread = labels.join(heard, F.col("node") == F.col("u")).select("node", F.col("class").alias("old"), F.least("class", "c").alias("class"))
        up = labels.select(F.col("node").alias("at"), F.col("class").alias("above"))
        before, jumped = labels, materialise(spread.join(up, F.col("class") == F.col("at")).select("node", "old", F.least("class", "above").alias("class")), name)
        if not jumped.where("old <> class").limit(1).count():
            discard(both, jumped)
            return before  # the round changed nothing
        discard(before)
        labels = jumped


def merged(label: DataFrame | None, found: DataFrame, name: str) -> DataFrame:
    """The classes ``node, class`` after the links ``a, b`` are added: only classes that a new link touches are looked at."""
    if label is None:
        return components(found, name)
    out = found
    for end in ("a", "b"):
        own = label.select(F.col("node").alias(end), F.col("class").alias(f"c_{end}"))
        out = out.join(own, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    up = components(out.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).where("a <> b").distinct(), name)
    raised = label.join(up.select(F.col("node").alias("class"), F.col("class").alias("above")), "class", "left").select("node", F.coalesce("above", "class").alias("class"))
    out = materialise(raised.union(up.join(label.select("node"), "node", "left_anti").select("node", "class")), name)
    discard(up)
    return out


def needed(a: int, b: int, least: float) -> int:
    """Shingles that texts of ``a`` and ``b`` shingles share at least, if they are linked."""
    return max(ceil(least / (1 + least) * (a + b) - 1e-6), 1)


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample share, sorted, and the number of those texts; a bounded number of them.

    Any order of the shingles gives the same pairs: one that misses a frequent shingle only makes more candidates.
    """

    @F.pandas_udf("array<long>")
    def marks(batch: pd.Series) -> pd.Series:
        return pd.Series([labelled(shingles(t)).view(np.int64) for t in batch], dtype=object)

    every = max(texts.count() // ORDER_TEXTS, 1)
    sample = texts.where(F.pmod(F.xxhash64(F.lit("order"), "node"), F.lit(every)) == 0)
    counts = sample.select(F.explode(marks("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialise(counts, "omh-counts")
    lowest, total = 2, 0
    # numbers of texts from the largest down, while their shingles fit; there are about as many as square roots of the texts
    for row in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toLocalIterator():
        total += row.m
        if total > ORDER_SHINGLES:
            lowest = row.n + 1
            break
    known = counts.where(F.col("n") >= lowest).toArrow().sort_by("token")
    return known["token"].to_numpy(), known["n"].to_numpy()


def rarest(texts: DataFrame, least: float) -> DataFrame:
    """``token, node, class, n, pos, leads``: of each text of ``n`` shingles the rarest, by which it meets any text it is linked to.

    In one order of all shingles, the first that two linked texts share stands in both within the first
    ``n - needed + 1``: for the shorter text (``leads``) with a partner at least as long, for the longer with one of ``least`` its length.
    """
    known = texts.sparkSession.sparkContext.broadcast(frequent(texts))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, counts = known.value
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for node, cls, text in zip(batch["node"], batch["class"], batch["text"], strict=True):
                h = labelled(shingles(text))
                n = len(h)
                if not n:
                    continue
                own = h.view(np.int64)
                often = np.zeros(n, np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                    often = np.where(tokens[at] == own, counts[at], 0)
                own = own[np.lexsort((_mix(h), often))][: n - max(ceil(least * n - 1e-6), 1) + 1]
                parts.append((own, np.full(len(own), node), np.full(len(own), cls), np.full(len(own), n), np.arange(len(own)), np.arange(len(own)) <= n - needed(n, n, least)))
                held += len(own)
                if held > 100_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))
                    parts, held = [], 0
            if parts:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    names = ["token", "node", "class", "n", "pos", "leads"]
    return texts.select("node", "class", "text").mapInPandas(keys, "token long, node long, class long, n long, pos long, leads boolean")


def met_by_rarest(texts: DataFrame, least: float) -> DataFrame:
    """``a, b``: every pair of texts of different classes that share a shingle of their rarest and can still be linked.

    ``texts``: node, class, text. No key is capped: the rows of a key that many texts have are dealt to several tasks.
    """
    keyed = materialise(rarest(texts, least), "omh-rarest")
    # a key that one class has, or no shorter text, makes no pair
    useful = keyed.groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("m"), F.max("leads").alias("any")).where("c0 <> c1 and any").select("token", F.ceil(F.col("m") / SALT_ROWS).cast("int").alias("salts"))
    rows = materialise(keyed.join(useful, "token"), "omh-keys")
    short = rows.where("leads").select("token", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_s") for c in ("node", "class", "n", "pos")])
    long = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    share = F.ceil(F.lit(least / (1 + least)) * (F.col("n_s") + F.col("n")) - 1e-6)
    later = (F.col("n_s") < F.col("n")) | ((F.col("n_s") == F.col("n")) & (F.col("node_s") < F.col("node")))
    fits = (F.col("class_s") != F.col("class")) & later & (F.least(F.col("n_s") - F.col("pos_s"), F.col("n") - F.col("pos")) >= share)
    met = short.hint("merge").join(long, ["token", "salt"]).where(fits)
    return met.select(F.least("node_s", "node").alias("a"), F.greatest("node_s", "node").alias("b")).distinct()


def duplicate_classes(docs: DataFrame, least: float = 0.8, band: int = 64) -> DataFrame:
    """Class of every row: ``doc_id, rep, class_id, n_copies, class_no``.

    ``rep`` is the smallest id of the same text, ``class_id`` the smallest id linked to it over any number of links, and
    ``class_no`` a number of the class within this result, which also tells two classes apart that go by the same id,
    because rows with different texts repeat it. A link is a similarity of at least ``least``: the five-word shingles (words: lower-cased
    runs of letters, digits and underscores) that a banded alignment matches in order, as a share of those of both
    texts. Shingles further than ``band`` positions (or a quarter of the text) from the middle diagonal do not match.

    Exact copies meet first: from there on distinct texts are compared, whatever their ids. Each is compared, in each of
    its 16 buckets, with the bucket's leader: the text whose own buckets are fullest, so the one least changed within a
    family of copies. Texts not yet in their leader's class meet the next leaders, one a round, while at least ``WORTH`` of
    a round's comparisons are links. A bucket of n texts thus costs n comparisons a round, not n * n, and no bucket
    is capped.

    The texts of buckets that then still hold more than one class are finished exactly: those that share one of their
    rarest shingles, as any two linked texts do, and can still reach ``least`` are compared.

    Texts without words, null ones included, are linked to their exact copies alone. Repeated rows and repeated ids are
    kept, each with its class; a null ``doc_id`` has a null ``rep`` and class unless a copy has an id. Columns of ``docs`` other than
    ``doc_id`` and ``text`` are not used. No row is added or lost. Tables of the rounds are deleted before the result is
    returned; one remains, which it reads.
    """
    named = _named_texts(docs, least, band)
    h1, h2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"))
    return rows.join(named, ["h1", "h2"], "left").select("doc_id", "rep", "class_id", "n_copies", "class_no")


def _named_texts(docs: DataFrame, least: float, band: int) -> DataFrame:
    """``h1, h2, rep, n_copies, class_no, class_id`` of every distinct text of a row with an id, written once."""
    base = distinct_texts(docs.where("doc_id is not null"))
    label, made = _classes(docs, base, least, band)
    named = base.select("node", "h1", "h2", "rep", "n_copies")
    if label is None:
        out = materialise(named.select("h1", "h2", "rep", "n_copies", F.col("node").alias("class_no"), F.col("rep").alias("class_id")), "omh-named")
        discard(base, *made)
        return out
    linked = materialise(named.join(label, "node"), "omh-linked")
    # a class of a third of all texts costs the aggregation a row per task, and its name returns to a plain table
    first = materialise(linked.groupBy("class").agg(F.min("rep").alias("class_id")), "omh-names")
    alone = named.join(label.select("node"), "node", "left_anti").select("h1", "h2", "rep", "n_copies", F.col("node").alias("class_no"), F.col("rep").alias("class_id"))
    out = materialise(linked.join(first, "class").select("h1", "h2", "rep", "n_copies", F.col("class").alias("class_no"), "class_id").union(alone), "omh-named")
    discard(base, label, linked, first, *made)
    return out


def _classes(docs: DataFrame, base: DataFrame, least: float, band: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """``node, class`` of the texts that have links (None: there are none), and the tables written on the way."""
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    member = base.select("node", "size", F.posexplode("sketches").alias("no", "value"))
    sizes = keep(member.groupBy("no", "value").agg(F.count("*").alias("n")).where("n > 1"), "omh-sizes")
    shared = keep(member.join(sizes, ["no", "value"]), "omh-members")
    weight = keep(shared.groupBy("node").agg(F.sum("n").alias("weight")), "omh-weights")
    # a bucket is its two numbers; a text's weight tells how central it is
    buckets = keep(shared.select("no", "value", "node", "size").join(weight, "node"), "omh-buckets")
    wanted = base.select("node", F.col("rep").alias("doc_id"), "h1", "h2").join(weight.select("node"), "node", "left_semi")
    h1, h2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    bodies = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    texts = keep(bodies.hint("merge").join(keep(wanted, "omh-wanted"), ["doc_id", "h1", "h2"]).select("node", "text").dropDuplicates(["node"]), "omh-bodies")
    label = tried = None
    rows = buckets.withColumn("class", F.col("node"))
    k = 0
    while True:
        # within a bucket, each class is asked but the leader's own
        todo = rows
        if k:  # another order each round: by weight disturbed by a hash of the round, so that other texts lead
            todo = todo.withColumn("weight", F.col("weight") * (F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1000)) + 1))
        first = todo.groupBy("no", "value").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "class", "size")).alias("top"))
        first = keep(first.select("no", "value", (-F.col("top.minus")).alias("lead"), F.col("top.class").alias("lead_class"), F.col("top.size").alias("lead_size")), "omh-leads")
        near = F.least("size", "lead_size") >= F.lit(least) * F.greatest("size", "lead_size")
        pairs = todo.join(first, ["no", "value"]).where((F.col("class") != F.col("lead_class")) & near).select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        if k:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = keep(pairs, "omh-pairs")
        found = keep(_verified(pairs, texts, least, band), "omh-links")
        tried = pairs if k == 0 else tried.union(pairs)
        n_pairs, n_found = pairs.count(), found.count()
        if n_found:
            label = merged(label, found, "omh-classes")
            made.append(label)
            # the buckets that hold more than one class, each row with its class
            rows = keep(rows.drop("class").join(label, "node", "left").withColumn("class", F.coalesce("class", "node")), "omh-classed")
            many = rows.groupBy("no", "value").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("no", "value")
            rows = rows.join(keep(many, "omh-many"), ["no", "value"])
        if n_found < WORTH * n_pairs or not n_pairs:
            break
        k += 1
    left = rows.select("node", "class").distinct()
    left = keep(left.hint("merge").join(texts, "node"), "omh-open")
    pairs = keep(met_by_rarest(left, least).join(tried, ["a", "b"], "left_anti"), "omh-pairs")
    found = keep(_verified(pairs, texts, least, band), "omh-links")
    if found.limit(1).count():
        made.append(label)
        label = merged(label, found, "omh-classes")
    return label, [t for t in made if t is not None and t is not label]


def keep_one_per_class(docs: DataFrame, least: float = 0.8, band: int = 64) -> DataFrame:
    """The rows of ``docs``, whole and unchanged, that stand for their class: one of each.

    It is the row with the class's smallest id; where rows with different texts of the class repeat that id, the one with
    the smallest hash of its text; and of repeated rows of both, the one with the smallest hash of all columns. Rows with
    a null id have no class and stay.
    """
    named = _named_texts(docs, least, band)
    best = named.where("rep = class_id").groupBy("class_no").agg(F.min(F.struct(F.col("rep").alias("keep_id"), F.col("h1").alias("keep_h1"), F.col("h2").alias("keep_h2"))).alias("best"))
    best = materialise(best.select("best.*"), "omh-best")
    h1, h2 = text_key(F.coalesce(F.col("row")["text"], F.lit("")))
    packed = docs.select(F.struct("*").alias("row"))
    rows = packed.withColumns({"keep_id": F.col("row")["doc_id"], "keep_h1": h1, "keep_h2": h2})
    key = ["keep_id", "keep_h1", "keep_h2"]
    kept = rows.where("keep_id is not null").join(best, key, "left_semi")
    if kept.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.groupBy(*key).agg(F.min_by("row", F.struct(F.xxhash64("row"), F.xxhash64(F.lit("second"), "row"))).alias("row"))
    discard(named)
    return with_columns(kept.select("row").union(rows.where("keep_id is null").select("row")), "row", {})
