"""Bitemporal revisions: precedence, maximal heads, point-in-time selection, channel comparison, graph checks.

Revisions are ``observation_key, revision_id, payload_hash, event_time, available_time, knowledge_time`` rows; edges say
that one revision supersedes another, ``revision_id, superseded_revision_id, knowledge_time``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.session import materialise


def precedence(revisions: DataFrame) -> DataFrame:
    """Neighbouring revisions of a key by declared time: ``observation_key, revision_id, other_id, verdict``.

    ``replay`` where the payload is the same, ``newer`` where the declared time is later, ``competing`` where it is equal.
    Comparing neighbours suffices: precedence follows the declared time.
    """
    w = Window.partitionBy("observation_key").orderBy("available_time", "revision_id")
    b = revisions.withColumns({"other_id": F.lag("revision_id").over(w), "_hash": F.lag("payload_hash").over(w), "_at": F.lag("available_time").over(w)}).where("other_id is not null")
    verdict = F.when(F.col("payload_hash") == F.col("_hash"), "replay").when(F.col("available_time") > F.col("_at"), "newer").otherwise("competing")
    return b.select("observation_key", "revision_id", "other_id", verdict.alias("verdict"))


def compare_channels(left: DataFrame, right: DataFrame, fields: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows of two channels by observation key: EQUAL, MISMATCH, INCOMPARABLE (one side only, or a null field), INTEGRITY_VIOLATION (repeated key)."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        one = df.groupBy("observation_key").agg(F.count("*").alias(f"n_{tag}"), *[F.first(f).alias(f"{f}_{tag}") for f in fields])
        return one

    j = side(left, "l").join(side(right, "r"), "observation_key", "full")
    missing = F.col("n_l").isNull() | F.col("n_r").isNull()
    unknown = missing
    same = F.lit(True)
    for f in fields:
        a, b = F.col(f"{f}_l"), F.col(f"{f}_r")
        unknown = unknown | a.isNull() | b.isNull()
        same = same & (F.abs(a - b) <= tolerance if tolerance else a.eqNullSafe(b))
    verdict = F.when((F.col("n_l") > 1) | (F.col("n_r") > 1), "INTEGRITY_VIOLATION").when(unknown, "INCOMPARABLE").when(same, "EQUAL").otherwise("MISMATCH")
    return j.select("observation_key", verdict.alias("verdict"))


def missing_edges(compared: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges for EQUAL keys that are not written yet: ``edge_id, observation_key``."""
    due = compared.where("verdict = 'EQUAL'").select(F.sha2(F.concat_ws("|", F.lit("edge"), F.col("observation_key").cast("string")), 256).alias("edge_id"), "observation_key")
    return due.join(existing.select("edge_id"), "edge_id", "left_anti")


def map_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Raw edges as edges between canonical revisions, known when the last of the three is: ``revision_id, superseded_revision_id, knowledge_time, n_matches``.

    ``canonical``: ``lineage_id, revision_id, knowledge_time``; more than one match shows in ``n_matches``.
    """
    a = canonical.select(F.col("lineage_id").alias("revision_id"), F.col("revision_id").alias("new_id"), F.col("knowledge_time").alias("new_known"))
    b = canonical.select(F.col("lineage_id").alias("superseded_revision_id"), F.col("revision_id").alias("old_id"), F.col("knowledge_time").alias("old_known"))
    j = edges.join(a, "revision_id").join(b, "superseded_revision_id")
    w = Window.partitionBy("revision_id", "superseded_revision_id")
    return j.select(F.col("new_id").alias("revision_id"), F.col("old_id").alias("superseded_revision_id"), F.greatest("knowledge_time", "new_known", "old_known").alias("knowledge_time"), F.count("*").over(w).alias("n_matches"))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One step from a set of ids along the edges: ``revision_id``."""
    return frontier.join(edges, "revision_id").select(F.col("superseded_revision_id").alias("revision_id")).distinct()


def maximal_heads(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that no candidate supersedes, directly or through any known revision; one on a cycle supersedes itself.

    A candidate ends a walk at once; stretches of other revisions are jumped over by doubled pointers, so the rounds grow
    with the logarithm of the longest stretch.
    """
    now = F.timestamp_seconds(F.lit(0))
    beaten = superseded_from(candidates.select("revision_id").distinct().withColumn("available_time", now), edges, earliest=now)
    return candidates.join(beaten.where("beaten_at is not null").select("revision_id"), "revision_id", "left_anti")


def chased(links: DataFrame, done: Column, to_circles: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pointers followed to their end by doubling: ``links`` (``v, up, m``) with ``up`` the last that is reached and ``m`` the least on the way.

    A pointer ends at what has no link of its own, or where ``done`` holds. Every round doubles what is followed, so there are a logarithm
    of the longest chain. Returns all links, those that run in a circle and so never end (followed for more steps than there are links), and
    the links of every round, each twice as far as those of the round before.

    ``to_circles``: what never ends is followed only until it points into its circle, and ``m`` of it is not to be used. That is so once a round
    ends no pointer (then none will) and leaves as many different targets (then following permutes them).
    """
    ends = links.select(F.col("v").alias("up"), F.lit(True).alias("_goes"))
    pending = materialise(links.join(ends, "up", "left").select("v", "up", "m", (F.col("_goes").isNull() | done).alias("ended")), "links")
    n, parts, rounds, before = pending.count(), [], [], None
    while True:
        parts.append(pending.where("ended").select("v", "up", "m"))
        pending = pending.where("not ended")
        known = parts[0].withColumn("ended", F.lit(True))
        for part in parts[1:]:
            known = known.unionByName(part.withColumn("ended", F.lit(True)))
        known = known.unionByName(pending)
        rounds.append(known.select("v", "up", "m"))
        if len(rounds) > n.bit_length() + 1 or not pending.limit(1).count():
            return known.select("v", "up", "m"), pending.select("v", "up", "m"), rounds
        if to_circles:
            now = pending.agg(F.count("*"), F.count_distinct("up")).first()[:]
            if now == before:
                return known.select("v", "up", "m"), pending.select("v", "up", "m"), rounds
            before = now
        ahead = known.select(F.col("v").alias("up"), F.col("up").alias("_up"), F.col("m").alias("_m"), F.col("ended").alias("_ended"))
        further = pending.join(ahead, "up").select("v", F.col("_up").alias("up"), F.least("m", "_m").alias("m"), F.col("_ended").alias("ended"))
        pending = materialise(further.withColumn("ended", F.col("ended") | done), "links")


def superseded_from(revisions: DataFrame, edges: DataFrame, earliest: Column | None = None) -> DataFrame:
    """``revision_id, beaten_at``: the earliest time at which a revision that supersedes it, directly or through others, is available.

    A revision is a head from its own time until then, so one pass answers for all times. Superseding revisions are
    nearly always the later ones: if no edge leads forward in time (an aggregate tells), direct ones are final. Else chains of
    revisions with one superseding revision each are walked by doubled pointers (``chased``), and only those with several are
    told times round by round, from one to the next over whole chains. ``earliest``: a time that no other comes
    before; who has it is done. Revisions that ``revisions`` lacks have no time, and pass on those of others.
    """
    times = revisions.select("revision_id", F.col("available_time").alias("at"))
    step = edges.select(F.col("revision_id").alias("a"), F.col("superseded_revision_id").alias("v"))
    step = step.join(times.withColumnsRenamed({"revision_id": "a"}), "a", "left").join(times.select(F.col("revision_id").alias("v"), F.col("at").alias("own")), "v", "left")
    step = materialise(step, "edges")
    forward = step.where(F.coalesce(F.col("at") < F.col("own"), F.lit(True))).limit(1).count()
    direct = step.groupBy("v").agg(F.min("at").alias("m"), (F.min("a") == F.max("a")).alias("single"), F.min("a").alias("up"))
    if not forward:
        return direct.select(F.col("v").alias("revision_id"), F.col("m").alias("beaten_at"))
    direct = materialise(direct, "beaten")
    done = F.coalesce(F.col("m") <= earliest, F.lit(False)) if earliest is not None else F.lit(False)
    chains = chased(direct.where("single").select("v", "up", "m"), done)[0]
    several = direct.where("not single").select("v", "m")
    if several.limit(1).count():
        reach = chains.select(F.col("v").alias("a"), F.col("up").alias("x"), F.col("m").alias("passed"))
        arcs = step.join(several.select("v"), "v", "left_semi").join(reach, "a", "left")
        arcs = materialise(arcs.select(F.coalesce("x", "a").alias("x"), "v", F.least("at", "passed").alias("m")), "arcs")
        best = news = materialise(arcs.groupBy("v").agg(F.min("m").alias("m")), "beaten")
        while True:
            told = arcs.select("x", "v").join(news.select(F.col("v").alias("x"), "m"), "x").groupBy("v").agg(F.min("m").alias("told"))
            news = materialise(told.join(best, "v").where("told < m or (m is null and told is not null)").select("v", F.col("told").alias("m")), "news")
            if not news.limit(1).count():
                break
            best = materialise(best.unionByName(news).groupBy("v").agg(F.min("m").alias("m")), "beaten")
        above = best.select(F.col("v").alias("up"), F.col("m").alias("above"))
        chains = chains.join(above, "up", "left").select("v", F.least("m", "above").alias("m")).unionByName(best)
    return chains.select(F.col("v").alias("revision_id"), F.col("m").alias("beaten_at"))


def on_cycles(arcs: DataFrame) -> DataFrame:
    """``v``: the nodes of a directed graph ``a, v`` that lie on a cycle.

    Nodes with one arc in are chains, which doubled pointers contract: what is left are nodes with several, with an arc from each
    node that a chain leads down from. A chain that has no end runs in a circle. The rest is cut to its strongly connected parts by
    colours: each node takes the largest that reaches it, and what goes back from a colour's own node within the
    colour is one part. Last, chains between two nodes of one part are marked by the pointers' rounds. All of it is rows in
    proportion to the arcs, whatever the paths between them.
    """
    arcs = materialise(arcs.distinct(), "arcs")
    into = arcs.groupBy("v").agg(F.min("a").alias("up"), F.count("*").alias("n"))
    links, circling, rounds = chased(into.where("n = 1").select("v", "up", F.lit(0).alias("m")), F.lit(False), to_circles=True)
    found = circling.select(F.col("up").alias("v")).distinct()
    several = materialise(into.where("n > 1").select("v"), "several")
    if not several.limit(1).count():
        return found
    down = links.select(F.col("v").alias("a"), F.col("up").alias("x"))
    whole = materialise(arcs.join(several, "v").join(down, "a", "left").select(F.coalesce("x", "a").alias("x"), "a", "v"), "arcs")
    left = whole.select("x", "v").where("x <> v").distinct()
    parts = [whole.where("x = v").select(F.col("v"), F.col("v").alias("part"))]
    while True:
        left = _trimmed(left)
        if not left.limit(1).count():
            break
        colours = _coloured(left)
        coloured = left.join(colours.withColumnsRenamed({"v": "x", "colour": "cx"}), "x").join(colours, "v").where("cx = colour").select("x", "v", "colour")
        back = _reached(coloured)
        parts.append(back.select("v", F.col("colour").alias("part")))
        left = materialise(left.join(back.select(F.col("v").alias("x")), "x", "left_anti").join(back.select("v"), "v", "left_anti"), "arcs")
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    members = materialise(members.distinct(), "parts")
    closing = whole.join(members.withColumnsRenamed({"v": "x", "part": "px"}), "x").join(members, "v").where("px = part")
    marked = closing.select(F.col("a").alias("v")).distinct()
    for jump in rounds:  # who is 1, 2, 4, ... further up the chain
        marked = materialise(marked.unionByName(marked.join(jump.select("v", "up"), "v").select(F.col("up").alias("v"))).distinct(), "marked")
    return found.unionByName(members.select("v")).unionByName(marked).distinct()


def _trimmed(arcs: DataFrame) -> DataFrame:
    """The arcs without those at nodes with none in or none out, again and again."""
    arcs = materialise(arcs, "arcs")
    while True:
        kept = materialise(arcs.join(arcs.select(F.col("v").alias("x")), "x", "left_semi").join(arcs.select(F.col("x").alias("v")), "v", "left_semi"), "arcs")
        if kept.count() == arcs.count():
            return kept
        arcs = kept


def _coloured(arcs: DataFrame) -> DataFrame:
    """``v, colour``: the largest node from which a path leads to the node, itself included."""
    colours = materialise(arcs.select(F.col("x").alias("v")).union(arcs.select("v")).distinct().withColumn("colour", F.col("v")), "colours")
    news = colours
    while True:
        told = arcs.join(news.withColumnRenamed("v", "x"), "x").groupBy("v").agg(F.max("colour").alias("told"))
        news = materialise(told.join(colours, "v").where("told > colour").select("v", F.col("told").alias("colour")), "news")
        if not news.limit(1).count():
            return colours
        colours = materialise(colours.unionByName(news).groupBy("v").agg(F.max("colour").alias("colour")), "colours")


def _reached(arcs: DataFrame) -> DataFrame:
    """``v, colour``: the nodes from which a path within the colour leads to the colour's own node."""
    reached = news = materialise(arcs.where("v = colour").select("v", "colour").distinct(), "reached")
    while True:
        news = materialise(arcs.join(news, ["v", "colour"]).select(F.col("x").alias("v"), "colour").distinct().join(reached, ["v", "colour"], "left_anti"), "reached")
        if not news.limit(1).count():
            return reached
        reached = materialise(reached.unionByName(news), "reached")


def graph_problems(revisions: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, revision_id``: dangling ends, edges between keys, and revisions on a cycle within a key.

    A cycle has an edge whose newer end is not the later one, by available time and id. Only edges between the ends of such
    edges, within their key, are looked at (``on_cycles``): edges that all lead back in time cost two joins, however long the chain.
    """
    at = F.struct("available_time", "revision_id")
    ids = revisions.select("revision_id", F.col("observation_key").alias("k"), at.alias("at"))
    a = edges.join(ids, "revision_id", "left").withColumnsRenamed({"k": "ka", "at": "at_a"})
    b = a.join(ids.select(F.col("revision_id").alias("superseded_revision_id"), F.col("k").alias("kb"), F.col("at").alias("at_b")), "superseded_revision_id", "left")
    b = materialise(b, "graph")
    dangling = b.where("ka is null or kb is null").select(F.lit("dangling").alias("problem"), "revision_id")
    crossing = b.where("ka <> kb").select(F.lit("crosses keys").alias("problem"), "revision_id")
    inside = b.where("ka = kb")
    ranges = inside.where("at_a <= at_b").groupBy("ka").agg(F.min("at_a").alias("low"), F.max("at_b").alias("high"))
    suspect = inside.join(ranges, "ka").where("at_a between low and high and at_b between low and high")
    cycle = on_cycles(suspect.select(F.col("revision_id").alias("a"), F.col("superseded_revision_id").alias("v")))
    return dangling.union(crossing).union(cycle.select(F.lit("cycle").alias("problem"), F.col("v").alias("revision_id")))


def select_at(revisions: DataFrame, edges: DataFrame, at: str, cutoff: str) -> DataFrame:
    """Per key at one time: ``observation_key, status, revision_id, n_heads``.

    Known are revisions and edges with knowledge up to the cutoff; candidates are known revisions available at the time.
    SELECTED with one head, CONFLICT with several (``revision_id`` null), ABSENT with none.
    """
    c, t = F.lit(cutoff).cast("timestamp"), F.lit(at).cast("timestamp")
    known = revisions.where(F.col("knowledge_time") <= c)
    beaten = superseded_from(known, edges.where(F.col("knowledge_time") <= c)).where(F.col("beaten_at") <= t)
    heads = known.where(F.col("available_time") <= t).join(beaten, "revision_id", "left_anti")
    per = heads.groupBy("observation_key").agg(F.count("*").alias("n_heads"), F.min("revision_id").alias("one"))
    keys = revisions.select("observation_key").distinct()
    n = F.coalesce("n_heads", F.lit(0))
    return keys.join(per, "observation_key", "left").select("observation_key", _status(n).alias("status"), F.when(n == 1, F.col("one")).alias("revision_id"), n.cast("long").alias("n_heads"))


def _status(n: Column) -> Column:
    return F.when(n == 0, "ABSENT").when(n == 1, "SELECTED").otherwise("CONFLICT")


def select_over(revisions: DataFrame, edges: DataFrame, start: str, end: str, cutoff: str) -> DataFrame:
    """Selection of each key over a period, as spans: ``observation_key, valid_from, valid_until, status, revision_id``.

    Each revision is a head for one span of time: from when it is available until a revision that supersedes it is. A key's
    answer follows from how many such spans are open, so each revision adds two rows to one sweep along its key's time,
    however many others the key has. Equal neighbours are merged.
    """
    c, s, e = (F.lit(x).cast("timestamp") for x in (cutoff, start, end))
    known = revisions.where(F.col("knowledge_time") <= c).select("observation_key", "revision_id", "available_time")
    number = F.row_number().over(Window.partitionBy("observation_key").orderBy("revision_id"))
    spans = known.withColumn("no", number.cast("long")).join(superseded_from(known, edges.where(F.col("knowledge_time") <= c)), "revision_id", "left")
    spans = materialise(spans.select("observation_key", "revision_id", "no", "available_time", "beaten_at"), "head-spans")
    live = spans.where((F.col("available_time") < e) & F.coalesce((F.col("beaten_at") > F.col("available_time")) & (F.col("beaten_at") > s), F.lit(True)))
    steps = [
        live.select("observation_key", F.greatest("available_time", s).alias("t"), F.lit(1).alias("dn"), F.col("no").alias("dno")),
        live.where(F.col("beaten_at") < e).select("observation_key", F.col("beaten_at").alias("t"), F.lit(-1), -F.col("no")),
        spans.select("observation_key", s, F.lit(0), F.lit(0)).distinct(),
    ]
    w = Window.partitionBy("observation_key").orderBy("t")
    turns = steps[0].union(steps[1]).union(steps[2]).groupBy("observation_key", "t").agg(F.sum("dn").alias("dn"), F.sum("dno").alias("dno"))
    asked = turns.select("observation_key", "t", F.sum("dn").over(w).alias("n"), F.sum("dno").over(w).alias("no"))
    # while one span is open, the open numbers add up to its own
    asked = asked.select("observation_key", "t", _status(F.col("n")).alias("status"), F.when(F.col("n") == 1, F.col("no")).alias("no"))
    same = F.col("status").eqNullSafe(F.lag("status").over(w)) & F.col("no").eqNullSafe(F.lag("no").over(w))
    kept = asked.withColumn("_same", same).where("not _same").select("observation_key", F.col("t").alias("valid_from"), F.coalesce(F.lead("t").over(w), e).alias("valid_until"), "status", "no")
    return kept.join(spans.select("observation_key", "no", "revision_id"), ["observation_key", "no"], "left").select("observation_key", "valid_from", "valid_until", "status", "revision_id")


def asof_revisions(revisions: DataFrame) -> DataFrame:
    """Each revision with the period in which it is its key's latest: ``..., valid_from, valid_until`` (null: open)."""
    w = Window.partitionBy("observation_key").orderBy("available_time", "revision_id")
    return revisions.withColumns({"valid_from": F.col("available_time"), "valid_until": F.lead("available_time").over(w)})


def key_closure(window: DataFrame, revisions: DataFrame) -> DataFrame:
    """All revisions of the keys in the window, also those dated outside it."""
    return revisions.join(window.select("observation_key").distinct(), "observation_key", "left_semi")


def conflict_heads(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Heads of keys that have several, numbered from 0 by id within the key."""
    heads = maximal_heads(candidates, edges)
    w = Window.partitionBy("observation_key")
    return heads.withColumns({"n_heads": F.count("*").over(w), "ordinal": F.row_number().over(w.orderBy("revision_id")) - 1}).where("n_heads > 1")


def availability(ingest: Column, observable: Column, source_time: Column, bound_s: int | None, latency_s: int) -> Column:
    """``struct<available_time, gap, refused>``: the source's time with its evidence bound, or the ingest time with a gap token.

    Ingest before the observable time is refused.
    """
    shift = F.make_interval(secs=F.lit(latency_s + (bound_s or 0)))
    proven = source_time.isNotNull() if bound_s is not None else F.lit(False)
    return F.struct(
        F.when(proven, F.greatest(observable, source_time) + shift).otherwise(ingest).alias("available_time"),
        F.when(proven, F.lit(None).cast("string")).otherwise("no_availability_evidence").alias("gap"), (ingest < observable).alias("refused"),
    )


def canonical_availability(event_end: Column, raw_available: Column, raw_knowledge: Column, ready: Column, latency_s: int) -> Column:
    shift = F.make_interval(secs=F.lit(latency_s))
    return F.struct(F.greatest(event_end, raw_available + shift).alias("available_time"), F.greatest(ready, raw_knowledge).alias("knowledge_time"), (ready < raw_knowledge).alias("refused"))


def assumed_availability(stored: Column, observable: Column, gap: Column, named_gap: str, bound_s: int = 5) -> Column:
    """The stored time, or 5 seconds after the observable one if that is earlier and the row has the named gap."""
    return F.when(gap == named_gap, F.least(stored, observable + F.make_interval(secs=F.lit(bound_s)))).otherwise(stored)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side: empty if the stored rows equal the derived ones, repetitions included."""
    return a.exceptAll(b).withColumn("only_in", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("derived")))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def row_hash(*columns: str, salt: str = "") -> Column:
    """60 bits of a row's md5: of its values in the given order as text, each marked as there or null."""
    marked = [F.coalesce(F.concat(F.lit("="), F.replace(F.replace(F.col(c).cast("string"), F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C"))), F.lit("!")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *marked).cast("binary")), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-free content digest of a batch: row count and sums of two row hashes, as exact decimals.

    Nulls are marked, so moving one to another column changes the digest; columns of arrays, maps or structs enter as JSON.
    """
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    cols = [c for c in sorted(df.columns) if c not in by]
    h1, h2 = row_hash(*cols), row_hash(*cols, salt="second")
    return flat.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(h1.cast("decimal(38,0)")).alias("sum1"), F.sum(h2.cast("decimal(38,0)")).alias("sum2"))
