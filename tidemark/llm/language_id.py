"""Language identification by words first, backing off to ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, held_out, materialise, ship, text_key

#: What counts as a word character without being a letter or a decimal digit: Roman numerals, fractions, powers.
_OTHER = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
#: The same as two patterns: a set within the first plane is looked up fast, and few texts have characters of the others.
NUMERALS, _BEYOND = re.compile("[" + "".join(c for c in _OTHER if c <= "\uffff") + "]"), re.compile("[\U00010000-\U0010ffff]")
_FAR = frozenset(c for c in _OTHER if c > "\uffff")
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        if NUMERALS.search(text):
            text = NUMERALS.sub(" ", text)
        if _BEYOND.search(text):
            text = _BEYOND.sub(lambda m: " " if m.group() in _FAR else m.group(), text)
    return _RUN.findall(text)


ORDERS = (4, 3, 2, 1)
#: Added to each count.
SMOOTH = 0.1
#: Words whose vectors a worker keeps.
KEPT_WORDS = 400_000


def labelled_sample(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` different training rows, ``lang, text``: those with the smallest hash of the id.

    Training rows are those with an id, a language and a text that are not held out; repeated ones count once. The keys
    chosen are broadcast: at most ``size`` rows of two numbers, an id and a language.
    """
    train = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h1, h2 = text_key(F.col("text"))
    train = train.select("doc_id", "lang", "text", h1.alias("h1"), h2.alias("h2"))
    key = ["doc_id", "lang", "h1", "h2"]
    chosen = train.select(*key).distinct().orderBy(F.xxhash64("doc_id"), *key).limit(size)
    return train.join(F.broadcast(chosen), key, "left_semi").dropDuplicates(key).select("lang", "text")


class Model:
    """Log frequencies by language of each language's commonest words and n-grams; picklable."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = sorted(langs)
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.words = self._logs(words, at)
        self.grams = {}
        for k in ORDERS:
            self.grams |= self._logs([x for x in grams if len(x[1]) == k], at)

    def _logs(self, rows: list[tuple[str, str, int]], at: dict[str, int]) -> dict[str, np.ndarray]:
        terms = sorted({t for _, t, _ in rows})
        if not terms:
            return {}
        row = {t: i for i, t in enumerate(terms)}
        counts = np.full((len(terms), len(at)), SMOOTH)
        for lang, term, n in rows:
            counts[row[term], at[lang]] += n
        logs = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        return dict(zip(terms, logs - logs.mean(axis=1, keepdims=True), strict=True))

    def score(self, word: str) -> np.ndarray:
        """Centred log frequencies of the word, or the mean over its n-grams of the longest order that has a known one.

        A word none of whose letters is known says nothing: zeros. The marks at its ends alone are no n-gram.
        """
        known = self.words.get(word)
        if known is not None:
            return known
        padded = f"^{word}$"
        for k in ORDERS:
            found = [v for i in range(len(padded) - k + 1) if (v := self.grams.get(padded[i : i + k])) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs), np.float32)


def _commonest(counts: DataFrame, term: str, each: int) -> list[tuple[str, str, int]]:
    order = Window.partitionBy("lang").orderBy(F.desc("n"), term)
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    return [tuple(r) for r in top.select("lang", term, "n").collect()]


def fit(docs: DataFrame, sample: int = 8_000, vocabulary: int = 60_000) -> Model:
    """Count words and n-grams by language over ``labelled_sample(docs, sample)``.

    The model knows every language of the sample, and of each its commonest words and as many n-grams: ``vocabulary``
    divided by the number of languages, one at least. So what reaches the driver is bounded by the two parameters,
    whatever the corpus, and a small language keeps as many terms as a large one.
    """
    rows = materialise(labelled_sample(docs, sample), "language-sample")
    langs = [r.lang for r in rows.select("lang").distinct().collect()]
    each = max(1, vocabulary // max(len(langs), 1))
    pieces = F.split(F.lower("text"), r"[^\p{L}]+")
    words = rows.select("lang", F.explode(pieces).alias("term")).where("term <> ''").groupBy("lang", "term").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("^"), F.col("term"), F.lit("$"))
    starts = [F.greatest(F.char_length(padded) - (k - 1), F.lit(0)) for k in ORDERS]
    cut = [F.transform(F.slice(F.sequence(F.lit(1), n + 1), F.lit(1), n), lambda i, k=k: F.substr(padded, i, F.lit(k))) for k, n in zip(ORDERS, starts, strict=True)]
    grams = words.select("lang", "n", F.explode(F.concat(*cut)).alias("gram")).where(~F.col("gram").isin("^", "$")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = Model(langs, _commonest(words, "term", each), _commonest(grams, "gram", each))
    discard(rows)
    return model


class _Scorer:
    """Scores texts; keeps the vectors of the words met so far, at most ``KEPT_WORDS``."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((1024, len(model.langs)), np.float32)

    def _row(self, word: str) -> int:
        i = self.at.get(word)
        if i is None:
            i = len(self.at)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.at[word], self.rows[i] = i, self.model.score(word)
        return i

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.at) > KEPT_WORDS:
            self.at = {}
        get, total = self.at.get, np.zeros(len(self.model.langs))
        for start in range(0, len(words), 100_000):  # very long texts go in blocks
            block = words[start : start + 100_000]
            codes = [get(w) for w in block]
            if None in codes:
                codes = [self._row(w) if c is None else c for w, c in zip(block, codes, strict=True)]
            total += self.rows[codes].sum(axis=0, dtype=np.float64)
        mean = total / len(words) * min(len(words), 30)
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def predict_column(model: Model, text: Column, spark) -> Column:
    """``struct<lang_pred string, score double>`` of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def identify_languages(docs: DataFrame, sample: int = 8_000, vocabulary: int = 60_000) -> DataFrame:
    """Predict the language of every whole text: ``doc_id, held_out boolean, lang_pred string, score double``.

    A word known from training counts with its log frequency in each language; another one with the mean log
    frequency of its character n-grams, of four letters if one of those is known, else three, two or one. The words'
    values add up; the score is the winner's share of the resulting odds, taken over at most 30 words' worth.

    Null text, and text without a letter (fractions, powers and Roman numerals are none), gives ``und`` and 0; so does
    every text if there is nothing to learn from.
    Ties go to the language first in alphabetical order. Repeated rows are scored alike; no row is added or lost; a
    null id counts as not held out, and as no training row. Only ``text`` enters a prediction.
    """
    model = fit(docs, sample, vocabulary)
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), predict_column(model, F.col("text"), docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
