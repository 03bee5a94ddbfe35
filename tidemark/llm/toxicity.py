"""Toxicity scored by a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols (insult, threat, target, negation, reported speech, other) with weights
learned from labels. A cascade of further transducers rewrites insults and threats by what stands around them in the
clause: negated, reported, aimed at a target before or (read from right to left) after them. Each clause gives one
match, whose kind is that of its strongest part, and a document's score comes from its matched clauses, never from a word
by itself: a threat that nobody is the target of and one that somebody is are two kinds of match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, held_out, materialise, ship, text_key

TOKEN = re.compile(r"[^\W_]+|[.!?;\n\"«»“”]")
CLAUSE_END = frozenset(".!?;\n")
QUOTES = frozenset('"«»“”')

#: Cue words in the four languages: who is addressed or spoken of, what negates, what reports, what threatens.
TARGETS = frozenset("you your yours he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils elles usted ustedes ellos ellas él ella vosotros".split())
NEGATIONS = frozenset("not never neither nor cannot nicht kein keine keinen niemals nie jamais aucun aucune nunca jamás tampoco ningún".split())
REPORTS = frozenset("said says say wrote writes quoted quote called calls claimed sagte sagt schrieb nannte zitiert disait dijo dice escribió llamó".split())
THREATS = frozenset("kill hurt destroy shoot stab beat murder töten umbringen schlagen tuer frapper matar golpear".split())

#: Input symbols of the clause machine.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PASSED = (OTHER, 0.0)
#: How far, in words, a negation and a target reach.
NEGATION_REACH, TARGET_REACH = 3, 5
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Kinds of match, from the weakest to the strongest: the features in this order, and with what share of its weight each counts in its clause.
KINDS = ("negated", "reported", "threat", "plain", "targeted", "aimed")
SHARE = {"negated": 0.3, "reported": 0.4, "threat": 0.5, "plain": 1.0, "targeted": 1.0, "aimed": 1.0}
#: Where the logistic fit is drawn to: the kinds, then the strongest clause, the number of matched clauses, weight per 100 words.
PRIOR = np.array([0.3, 0.4, 0.5, 1.0, 1.2, 1.2, 0.5, 0.5, 0.5])
#: Lengths of words that enter the lexicon; threat words of the list keep a weight within these bounds.
SHORTEST, LONGEST = 3, 60
THREAT_WEIGHTS = (0.2, 4.0)


@dataclass
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (next state, symbol put out)``; what has no arc passes and leads to ``decay[state]``."""

    arcs: dict[tuple[int, object], tuple[int, object]] = field(default_factory=dict)
    decay: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: object) -> tuple[int, object]:
        return self.arcs.get((state, symbol)) or (self.decay.get(state, state), symbol)


def within(trigger: int, reach: int, rewrite: dict[object, object]) -> Transducer:
    """Rewrite symbols that come at most ``reach`` words after ``trigger``."""
    t = Transducer(decay={s: s - 1 for s in range(1, reach + 1)})
    for s in range(reach + 1):
        t.arcs[s, trigger] = (reach, trigger)
        if s:
            t.arcs |= {(s, a): (s - 1, b) for a, b in rewrite.items()}
    return t


def rest_of_clause(trigger: int, rewrite: dict[object, object]) -> Transducer:
    """Rewrite symbols that come anywhere after ``trigger`` in the clause."""
    return Transducer({(0, trigger): (1, trigger)} | {(1, a): (1, b) for a, b in rewrite.items()})


def compose(machines: list[Transducer], symbols: list[object]) -> dict[tuple[tuple[int, ...], object], tuple[tuple[int, ...], object]]:
    """The cascade of the machines, each reading what the one before puts out, as one table over reachable states."""
    table, todo, start = {}, [tuple(0 for _ in machines)], tuple(0 for _ in machines)
    seen = {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            out, ends = symbol, []
            for machine, s in zip(machines, state, strict=True):
                s, out = machine.step(s, out)
                ends.append(s)
            end = tuple(ends)
            table[state, symbol] = (end, out)
            if end not in seen:
                seen.add(end)
                todo.append(end)
    return table


INPUTS = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
AIMED = {INSULT: "targeted", THREAT: "aimed"}


def clause_machines() -> tuple[dict, dict]:
    """The cascade read from left to right, and the one that reads its output from right to left."""
    negated, reported = {INSULT: "negated", THREAT: "negated"}, {INSULT: "reported", THREAT: "reported"}
    ahead = compose([within(NEGATION, NEGATION_REACH, negated), rest_of_clause(REPORT, reported), within(TARGET, TARGET_REACH, AIMED)], INPUTS)
    return ahead, compose([within(TARGET, TARGET_REACH, AIMED)], [*INPUTS, *KINDS])


class Grammar:
    """The composed machines with their lexicon: stems and words of insults, and threats, with weights."""

    def __init__(self, stems: dict[str, float], words: dict[str, float], threats: dict[str, float] | None = None):
        self.stems, self.words = stems, words
        self.threats = dict.fromkeys(THREATS, 1.0) | (threats or {})
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.ahead, self.back = clause_machines()
        self.start, self.end = (next(iter(m))[0] for m in (self.ahead, self.back))
        self.seen: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: the word's symbol, and for an insult the largest weight of a stem or word that matches."""
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        if word in self.threats:
            return THREAT, self.threats[word]
        weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths if len(word) >= k)])
        if weight > 0:
            return INSULT, weight
        return (TARGET, 0.0) if word in TARGETS else PASSED

    def match(self, clause: list[tuple[int, float]], quoted: list[bool]) -> tuple[str, float] | None:
        """Kind and weight of a clause's match, from the symbols of its words and whether each stands in quotes."""
        state, out = self.start, []
        for symbol, _ in clause:
            state, put = self.ahead[state, symbol]
            out.append(put)
        state, total, kinds = self.end, 0.0, []
        for i in range(len(out) - 1, -1, -1):
            state, put = self.back[state, out[i]]
            if clause[i][0] in (INSULT, THREAT):
                kind = "plain" if put == INSULT else "threat" if put == THREAT else put
                kind = "reported" if quoted[i] and kind != "negated" else kind
                kinds.append(kind)
                total += clause[i][1] * SHARE[kind]
        return (max(kinds, key=KINDS.index), total) if kinds else None

    def features(self, text: str | None) -> np.ndarray:
        """Per kind log1p of the weights of its clauses; then of the strongest clause, the number of clauses, the weight per 100 words."""
        out = np.zeros(len(KINDS) + 3)
        tokens = TOKEN.findall(text.lower()) if text else []
        seen = self.seen
        if len(seen) > 150_000:
            seen.clear()
        distinct = set(tokens)
        for t in distinct:
            if t not in seen:
                seen[t] = self.symbol(t)
        hot = {t for t in distinct if seen[t][0] in (INSULT, THREAT)}
        if not hot:
            return out
        sums, found = dict.fromkeys(KINDS, 0.0), []
        clause, flags, quoted, due = [], [], False, False
        for t in [*tokens, "\n"]:
            if t in CLAUSE_END:
                if due and (m := self.match(clause, flags)):
                    sums[m[0]] += m[1]
                    found.append(m[1])
                clause, flags, due = [], [], False
                quoted = quoted and t != "\n"
            elif t in QUOTES:
                quoted = not quoted
            else:
                clause.append(seen[t])
                flags.append(quoted)
                due = due or t in hot
        out[: len(KINDS)] = np.log1p([sums[k] for k in KINDS])
        out[len(KINDS) :] = np.log1p([max(found), len(found), 100 * sum(found) / len(tokens)])
        return out


class Scorer:
    """A logistic model on the grammar's features; picklable."""

    def __init__(self, grammar: Grammar, weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = grammar, weights, bias

    def __call__(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.grammar.features(text) @ self.weights + self.bias, -50, 50))))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` different labelled documents that are not held out, ``text, toxic``: those with the smallest hash of the id.

    A document with several labels counts as toxic if one says so; rows that repeat an id and a text count once. The keys
    chosen are broadcast: at most ``size`` rows of four numbers.
    """
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    h1, h2 = text_key(F.coalesce(F.col("text"), F.lit("")))
    rows, key = docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")), ["doc_id", "h1", "h2"]
    chosen = rows.select(*key).join(train, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), *key).limit(size)
    return rows.join(F.broadcast(chosen), key).dropDuplicates(key).select("text", "toxic")


def learn_lexicon(sample: DataFrame, size: int = 4_000) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Stems and words that toxic documents hold far oftener than others, and the threat words, each with its log odds.

    Document frequencies of words of ``SHORTEST`` to ``LONGEST`` characters are counted in Spark; the ``size`` most
    significant terms reach the driver. A term needs 4 toxic documents, log odds of 1.2 and a z-score of 3. A longer term
    stays only where it says more than a shorter one. A threat word's odds are smoothed and kept within ``THREAT_WEIGHTS``.
    """
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    words = sample.where("text is not null").select(F.xxhash64("text").alias("h"), "toxic", word).where(F.char_length("word").between(SHORTEST, LONGEST)).distinct()
    terms = F.concat(F.array(F.concat(F.lit("="), F.col("word"))), *[F.when(F.char_length("word") > k, F.array(F.substring("word", 1, k))).otherwise(F.array().cast("array<string>")) for k in PREFIXES])
    found = words.select("h", "toxic", F.explode(terms).alias("term")).distinct().groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    total = sample.where("text is not null").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("nt"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("nc")).first()
    nt, nc = int(total.nt), int(total.nc)
    if not nt or not nc:
        return {}, {}, {}

    def odds(add: float) -> Column:
        return F.log((F.col("t") + add) / (nt + 2 * add)) - F.log((F.col("c") + add) / (nc + 2 * add))

    found = materialise(found.where("t >= 4").union(found.where(F.col("term").isin(*[f"={t}" for t in sorted(THREATS)]) & (F.col("t") < 4))), "toxic-terms")
    z = odds(0.5) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = found.where("t >= 4").withColumns({"odds": odds(0.5), "z": z}).where("odds >= 1.2 and z >= 3").orderBy(F.desc("z"), "term").limit(size).collect()
    threats = found.where(F.col("term").isin(*[f"={t}" for t in sorted(THREATS)])).select("term", odds(3.0).alias("odds")).collect()
    discard(found)
    stems: dict[str, float] = {}
    words_: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (r.term[0] == "=", len(r.term), r.term)):
        whole, term = r.term[0] == "=", r.term.removeprefix("=")
        shorter = max((stems.get(term[:k], 0.0) for k in PREFIXES if k < len(term) + whole), default=0.0)
        if r.odds > shorter + 0.4:
            (words_ if whole else stems)[term] = float(r.odds)
    return stems, words_, {r.term[1:]: float(np.clip(r.odds, *THREAT_WEIGHTS)) for r in threats}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000) -> Scorer:
    """Learn the lexicon and the weights of the kinds of match from ``labelled_sample(docs, labels, sample)``.

    The driver gets at most ``sample`` rows of 10 numbers. The weights are drawn towards a prior (a targeted match
    counts more, a negated or reported one less), which decides where labels say nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = materialise(labelled_sample(docs, labels, sample), "toxic-sample")
    grammar = Grammar(*learn_lexicon(rows))
    shared = spark.sparkContext.broadcast(grammar)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.features(t).tolist() for t in texts])

    got = rows.select(features("text").alias("x"), "toxic").toPandas()
    discard(rows)
    width = len(KINDS) + 3
    x = np.array(got["x"].tolist(), float).reshape(-1, width)
    y = got["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Scorer(grammar, np.zeros(width), -4.0 if not len(y) or y.max() == 0 else 4.0)
    w, b, ridge = PRIOR.copy(), -4.0, 2.0
    a = np.column_stack([x, np.ones(len(x))])
    theta, pull, centre = np.append(w, b), np.append(np.full(width, ridge), 1e-3), np.append(PRIOR, b)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (p - y) + pull * (theta - centre)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        theta = theta - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(grammar, theta[:-1], float(theta[-1]))


def score_column(scorer: Scorer, text: Column, spark) -> Column:
    ship(spark)
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value(t) for t in texts], dtype=float)

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 10_000) -> DataFrame:
    """Score every whole text: ``doc_id, held_out boolean, score double, predicted int`` (1 if score >= threshold).

    Only labels of documents that are not held out are learned from, and only ``text`` enters a score. Null and empty
    texts, and texts without a match, get the score of a document without matches. Without labels of both kinds every
    score is near 0 (or near 1 if all are toxic). Repeated rows are scored alike; no row is added or lost; a null id
    counts as not held out.
    """
    scorer = fit(docs, labels, sample)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score_column(scorer, F.col("text"), docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 10_000) -> DataFrame:
    """The rows of ``docs``, whole and unchanged, whose text scores below ``threshold``."""
    scorer = fit(docs, labels, sample)
    packed = docs.select(F.struct("*").alias("row"), score_column(scorer, F.col("text"), docs.sparkSession).alias("toxic_score"))
    return packed.where(F.col("toxic_score") < threshold).select("row.*")
