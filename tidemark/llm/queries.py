"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    forest_search, id_store, language_id, line_dedup, media_columns, order_minhash, periodic_runs, sentencepiece_codec, source_divergence, source_mixing, token_counts, toxicity, web_archive,
)
from tidemark.llm.shared import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = id_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return id_store.check_documents(store)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "piece_ids", "n_pieces", "round_trip")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.duplicate_classes(table(spark, sf_dir, "documents"), least=0.8)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.text_media(table(spark, sf_dir, "documents"))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages as sequences: per page its items, and how many of each kind."""
    out = media_columns.interleave(table(spark, sf_dir, "pages"))
    count = lambda kind: F.size(F.filter("items", lambda i: i["kind"] == kind)).cast("long")
    return out.select("page_id", "items", count("text").alias("n_texts"), count("media").alias("n_media"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.5, target_ratio=1.0, seed=17)
    return out.select("doc_id", "source", "copy_no", F.round("rate", 9).alias("rate"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where one document of ten repeats a part of itself: with h the id's crc32 and g its tenth, from word ``g % n`` on
    the words come again with a period of ``1 + (n - a) // (3 + g % 8)``. Other texts stay as they are, and so does that of a null id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    parts = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    parts = parts.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    rewritten = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), rewritten).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")), least_words=6, least_exponent=4)
    beats = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])  # noqa: E731  by exponent; runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, x: F.when(beats(x, top), x).otherwise(top))
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed_text")).alias("collapsed_sha256"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit_sources(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archive.archive_pages(table(spark, sf_dir, "pages"), least_bytes=0).drop("intact")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_language_id, op3_id_store, op4_sentencepiece, op5_order_minhash, op6_media_columns, op7_token_counts, op8_forest_search,
        op9_toxicity, op10_source_mixing, op11_periodic_runs, op12_source_divergence, op13_web_archive, pages_interleaved, pipeline,
    )
}

LINE_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of the id as text, a bit at a time.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(0, 8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLE = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (SELECT doc_id, pos, line, {LINE_KEY} AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_source_mixing": """
        WITH counts AS (SELECT source, count(*) AS n_docs, sqrt(count(*)) AS raw FROM documents GROUP BY source),
        rates AS (SELECT source, raw / (SELECT sum(raw) FROM counts) * (SELECT sum(n_docs) FROM counts) / n_docs AS rate FROM counts),
        pieces AS (
            SELECT d.doc_id, d.source, r.rate, greatest(CAST(ceil(r.rate / 16) AS BIGINT), 1) AS n_pieces
            FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
        ), draws AS (
            SELECT doc_id, source, rate, rate / n_pieces AS mean, ('0x' || substr(md5('17:' || doc_id || ':' || p.k), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM (SELECT *, unnest(range(1, n_pieces + 1)) AS k FROM pieces) p
        ), terms AS (
            SELECT r.mean, t.k, sum(exp(-r.mean) * power(r.mean, t.k) / gamma(t.k + 1)) OVER (PARTITION BY r.mean ORDER BY t.k) AS cdf
            FROM (SELECT DISTINCT mean FROM draws) r, (SELECT range AS k FROM range(0, 96)) t
        ), drawn AS (
            SELECT d.doc_id, d.source, d.rate, d.u, count(*) FILTER (WHERE d.u >= t.cdf) AS n
            FROM draws d JOIN terms t ON d.mean = t.mean GROUP BY d.doc_id, d.source, d.rate, d.u
        ), totals AS (SELECT doc_id, source, rate, sum(n) AS n FROM drawn GROUP BY doc_id, source, rate)
        SELECT doc_id, source, CAST(unnest(range(0, CAST(n AS BIGINT))) AS BIGINT) AS copy_no, round(rate, 9) AS rate FROM totals
    """,
    "op11_periodic_runs": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {CRC32} AS h FROM documents),
        g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
        a AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM g),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS (SELECT doc_id, unnest(range(0, n)) AS i, n, a, p, w FROM p),
        words AS MATERIALIZED (SELECT doc_id, i, n, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM t),
        equal AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), steps AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal),
        periodic AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM steps GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM periodic GROUP BY doc_id, start, length),
        told AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                   list({{'start': start, 'length': length, 'period': period}} ORDER BY CAST(length AS DECIMAL(38, 18)) / period DESC, start, period)[1] AS best
            FROM runs GROUP BY doc_id
        ), gone AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
        kept AS (
            SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS body FROM words w ANTI JOIN gone x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY w.doc_id
        )
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM d LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op12_source_divergence": """
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc, coalesce(text, '') AS text FROM documents),
        t AS (
            SELECT lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM d
        ), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        held AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
        groups AS (
            SELECT g.lang, g.source, coalesce(h.total, 0) AS total, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) g
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM held GROUP BY lang, source) h ON g.lang = h.lang AND g.source = h.source LEFT JOIN langs l ON g.lang = l.lang
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(h.n, 0) + 5) // (g.total + 5 * g.v) AS BIGINT) AS p,
                   CAST(1 + 1000000000 * (k.n + 5) // (g.lang_total + 5 * g.v) AS BIGINT) AS q
            FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
        ), sums AS (
            SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
        ), rows AS (
            SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
            LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
        ), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op13_web_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        last AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS latest FROM p),
        parts AS (SELECT page_id, body, latest, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS INTEGER)) AS bits FROM last)
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((bits[1 + i // 4] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
        FROM parts
    """,
}
