"""Periodic runs, source divergence and web archives against brute force, and their odd inputs."""

import gzip
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs, queries, source_divergence, web_archive
from tidemark.llm.shared import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_runs(words, least_words=6, least_exponent=4):
    """Every maximal stretch for every period; a stretch counts under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - begin + q
            if i > begin and size >= max(least_words, least_exponent * q):
                found.setdefault((begin, size), q)
            i += 1
    return sorted((s, size, q) for (s, size), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("exponent", [2, 3, 4])
def test_automaton_finds_the_runs_of_random_words(exponent):
    rng = random.Random(exponent)
    for _ in range(400):
        n, letters = rng.randint(0, 60), rng.randint(1, 4)
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < n else w for i, w in enumerate(words)]
        assert sorted(periodic_runs.runs_of(words, 6, exponent)) == plain_runs(words, 6, exponent)


def test_stretches_lose_no_run():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [b"%d" % rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 80))]
            if words and rng.random() < 0.5:
                words[len(words) // 2 :] = words[len(words) // 2 : len(words) // 2 + rng.randint(1, 5)] * rng.randint(3, 9)
            texts.append(words)
        assert periodic_runs._of_block(texts, 6, 4) == [plain_runs(t) for t in texts]


def test_stretches_end_where_nothing_repeats():
    codes = np.array([*range(50), *[60, 61, 62] * 5, *range(100, 150)])
    assert periodic_runs.stretches(codes, 6, 4) == [(50, 65)]


def test_runs_of_given_documents(spark, sf):
    docs = queries.with_planted_runs(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in periodic_runs.find_runs(docs).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = plain_runs(words) if len(words) < 3000 else [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs and r.collapsed_text == plain_collapse(words, runs)


def test_runs_of_odd_inputs(spark):
    texts = [None, "", " \t\n", "a a a a a a", "a a a a a", "x x \x85 " * 8, "a b " * 5 + "c", "A a " * 4, "z " * 20_000, ("p q r s " * 5 + "t ") * 40]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, texts[3], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = periodic_runs.find_runs(docs.withColumn("RUNS", F.lit(1)).withColumn("found", F.lit(2)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "found", "n_words", "runs", "collapsed_text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert [tuple(x) for x in r.runs] == (plain_runs(words) if len(words) < 5000 else [(0, len(words), 1)])
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[2].collapsed_text == "" and by[3].collapsed_text == "a" and by[4].runs == [] and by[8].collapsed_text == "z"
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    query = queries.with_planted_runs(docs)
    assert [r.text for r in query.where("doc_id is null").collect()] == [texts[3]]


def plain_audit(rows, least_docs, most_terms):
    """The report, term by term."""
    docs = defaultdict(Counter)
    counts, groups = defaultdict(Counter), set()
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        whole = Counter()
        for a, s in groups:
            if a == lang:
                whole.update(counts[a, s])
        p, q = share(counts[lang, source]), share(whole)
        pairs = []
        for a, s in groups:
            if a == lang and s != source:
                r = share(counts[a, s])
                pairs.append((sum(abs(p[t] - r[t]) for t in kept), s))
        terms = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, t, v, k + 1) for k, (v, t) in enumerate(items) if part == "pair" or k < most_terms]
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r) for r in source_divergence.audit_sources(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_a_plain_report(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "Z", "é", None])
        rows.append((i, " ".join(rng.choice(["Ab", "ab", "ÄB", "x-y", "日本", "c1d", f"w{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randint(0, 12))), lang, source, 0))
    rows += [(900, None, "en", "empty", 0), (901, "...", "fr", "only", 0), (901, "...", "fr", "only", 0), (902, "", "fr", "two", 0), (903, "ab " * 5000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(7)).withColumn("base", F.lit(7))
    want = plain_audit([r[1:4] for r in rows], 5, 4)
    assert audited(docs.repartition(5), least_docs=5, most_terms=4) == want
    assert ("fr", "only", "pair", "two", 0, 1) in want
    assert audited(docs.limit(0)) == []


def test_blocks_do_not_change_sums(spark):
    rng = np.random.default_rng(2)
    held = [(f"s{i}", f"t{t}", int(rng.integers(1, 10**9))) for i in range(9) for t in range(200) if rng.random() < 0.3]
    base = {f"s{i}": int(rng.integers(1, 10**6)) for i in range(10)}
    entries = spark.createDataFrame([("x", *e) for e in held], "lang string, source string, term string, share long")
    groups = spark.createDataFrame([("x", s, b) for s, b in base.items()] + [("y", "one", 3), ("y", "two", 4)], "lang string, source string, base long")
    share = {(s, t): p for s, t, p in held}
    terms = {t for _, t, _ in held}
    want = {("x", a, b): sum(abs(share.get((a, t), base[a]) - share.get((b, t), base[b])) for t in terms) for a in base for b in base if a != b}
    want |= {("y", "one", "two"): 0, ("y", "two", "one"): 0}
    for block in (1000, 37):
        assert {tuple(r)[:3]: r.value for r in source_divergence.pair_sums(entries, groups, block).collect()} == want


def test_counts_beyond_64_bits(spark):
    e = source_divergence.smoothed("n", "total", "v")
    r = spark.sql("select cast(9000000000000000 as bigint) n, cast(9100000000000000 as bigint) total, cast(3 as bigint) v").selectExpr(f"{e} as p").first()
    assert r.p == 1 + 10**9 * (9 * 10**15 + 5) // (91 * 10**14 + 15)


def test_long_tables_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 3)
    docs = spark.createDataFrame([(i, f"a b{chr(97 + i % 20)} a", "en", f"s{i % 3}", 0) for i in range(60)], SCHEMA).coalesce(1)
    got = {(r.source, r.term): (r.n, r.n_docs) for r in source_divergence.count_terms(docs).collect()}
    assert got["s0", "a"] == (40, 20) and got["s1", None] == (0, 0) and sum(n for n, _ in got.values()) == 180


PAGES = "page_id long, url string, html string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], PAGES).withColumn("sha1", F.lit("clash")).withColumn("latest", F.lit(1))


def archived(pages, **options):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in web_archive.archive_pages(pages, **options).collect()), key=str)


def plain_pages(rows, least):
    last = {}
    for i, _, h in rows:
        h = h or ""
        last[h] = i if last.get(h) is None else max(last[h], -1 if i is None else i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        own = len(body) < least or i == last[h or ""]
        out.append((i, len(body), web_archive.digest_of(body), "response" if own else "revisit", None if own else last[h or ""]))
    return sorted(out, key=str)


ROWS = [(1, "http://a/ b\r\nX: y", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "WARC/1.1\r\n\r\n"), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "<p>ä</p>"), (None, "v", "alone")]


@pytest.mark.parametrize("least", [0, 9])
@pytest.mark.parametrize("split", [97, 1 << 20])
def test_archives_of_odd_pages(spark, least, split):
    assert archived(pages_of(spark, ROWS), least_bytes=least, split_bytes=split) == plain_pages(ROWS, least)
    assert archived(pages_of(spark, []), split_bytes=split) == []


def test_archives_roll_and_are_plain_gzip(spark):
    rows = [(i, f"http://h/{i}", "".join(chr(97 + (i * k) % 26) for k in range(500 + i))) for i in range(60)]
    archives = web_archive.write_archives(pages_of(spark, rows), shared_path(spark, "warc"), archive_bytes=2000)
    listed = archives.collect()
    assert len(listed) > 5 and sum(r.records for r in listed) == 60
    for r in listed:
        whole = gzip.open(r.path).read()
        assert whole.count(b"WARC/1.1\r\n") == r.records + 1 and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    records = web_archive.read_archives(spark, archives, split_bytes=333).where("record_type = 'response'").collect()
    assert {r.record_id: bytes(r.payload).decode() for r in records} == {f"urn:page:{i}": h for i, _, h in rows}
    assert all(r.intact and r.target_uri.startswith("http://h/") for r in records)


def record(k, payload):
    return web_archive.member_of(web_archive.page_record(str(k), "u", payload, len(payload), web_archive.digest_of(payload), None, "2000-01-01T00:00:00Z"))


def starts(data, step):
    return [(at, r["payload"]) for b in range(0, len(data), step) for at, r in web_archive.records_in(io.BytesIO(data), len(data), b, b + step)]


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 1 << 21])
def test_each_record_has_one_owner(step):
    rng = random.Random(3)
    payloads = [rng.randbytes(rng.choice([0, 1, 50, 700])) for _ in range(12)]
    members = [record(k, p) for k, p in enumerate(payloads)]
    begins = np.cumsum([0, *map(len, members)]).tolist()
    assert starts(b"".join(members), step) == list(zip(begins, payloads, strict=False))


def test_archives_inside_archives_and_damage():
    inner = record(1, b"one") + record(2, b"two")
    outer = [record(3, inner), record(4, b"x"), record(5, random.Random(1).randbytes(4000) + inner)]
    data = b"".join(outer)
    for step in (1, 50, len(data)):
        assert [p for _, p in starts(data, step)][1] == b"x" and len(starts(data, step)) == 3
    broken = bytearray(data)
    broken[len(outer[0]) + len(outer[1]) - 3] ^= 0xFF  # the second record's checksum
    for step in (50, len(data)):
        assert len(starts(bytes(broken), step)) in (1, 2) and starts(bytes(broken), step)[-1][1] == starts(data, step)[-1][1]
    assert starts(data[:-1], len(data))[-1][1] == b"x" or len(starts(data[:-1], len(data))) == 1
    assert starts(b"junk" * 100, 64) == [] and starts(b"", 64) == []
    assert web_archive.parse_record(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n") is None


def test_a_changed_payload_is_told(spark, tmp_path):
    good, payload = record(1, b"<p>"), b"<q>"
    bad = web_archive.member_of(web_archive.page_record("2", "u", payload, 3, web_archive.digest_of(b"<p>"), None, "2000-01-01T00:00:00Z"))
    (tmp_path / "a.warc.gz").write_bytes(good + bad)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(good + bad), 2)], "path string, bytes long, records long")
    assert {r.record_id: r.intact for r in web_archive.read_archives(spark, archives, 40).collect()} == {"urn:page:1": True, "urn:page:2": False}
