"""Brute-force comparisons, exact round trips, held-out accuracy, and odd inputs of the ten operators."""

import hashlib
import os
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from tidemark.llm import forest_search, id_store, language_id, line_dedup, media_columns, order_minhash, pretokens, queries, sentencepiece_codec, source_mixing, token_counts, toxicity
from tidemark.llm.shared import ship

ODD = [None, "", " ", "a", "one line\nONE LINE \n\nlast", "é É x́ 日本語", "<|endoftext|> it's <s>", "x " * 3000, "12½ ²3 \x1c a\x85b", "trail \n", "a  b\t c\r\n", "🎉" * 50, "=" * 700]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s", 0), (3, "a", "en", "s", 0), (None, "a", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    got, cols = spark_rows(queries.QUERIES[name](spark, sf))
    want, names = sql_rows(queries.ORACLE[name], sf)
    assert cols == names and got == want


def test_line_dedup_on_odd_inputs(spark, odd):
    out = line_dedup.drop_common_lines(odd.withColumn("N_Lines", F.lit("clash")).withColumn("h1", F.lit("x")), min_docs=3).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out if r.doc_id != 3}
    assert by[0].n_lines == 1 and by[0].kept_text == "" and by[1].n_dropped == 0
    assert [r.kept_text for r in out if r.text == "a"] == [""] * 4 + [] and all(r.n_dropped == 1 for r in out if r.text == "a")
    assert by[4].kept_text == ODD[4]
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_line_key_lowers_ascii_letters_alone(spark):
    rows = spark.createDataFrame([("\t AbC\x0b",), ("ÉA",), ("éa",), ("KK",)], "x string").select(line_dedup.line_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in rows] == ["abc", "Éa", "éa", "kK"]


def test_language_held_out_accuracy(spark, docs, local):
    out = language_id.identify_languages(docs).toPandas().merge(local[["doc_id", "lang"]], on="doc_id")
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.97
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]


def test_language_equals_a_plain_scorer(spark, docs, local):
    """Every word scored by itself, from the model's tables, one text at a time."""
    model = language_id.fit(docs)

    def plain(text):
        words, word = [], ""
        for c in text.lower() + " ":
            if c.isalpha():
                word += c
            elif word:
                words.append(word)
                word = ""
        total = np.zeros(len(model.langs))
        for w in words:
            if w in model.words:
                total += model.words[w]
                continue
            for k in (4, 3, 2, 1):
                grams = [f"^{w}$"[i : i + k] for i in range(len(w) + 3 - k)]
                if known := [model.grams[g] for g in grams if g in model.grams]:
                    total += np.mean(known, axis=0)
                    break
        if not words:
            return "und", 0.0
        p = np.exp(total / len(words) * min(len(words), 30))
        return model.langs[int(p.argmax())], p.max() / p.sum()

    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    for d, t in zip(local.doc_id, local.text, strict=True):
        lang, score = plain(t)
        assert got[d].lang_pred == lang and abs(got[d].score - score) < 1e-4
    assert "^" not in model.grams and "$" not in model.grams


def test_language_letters_and_small_languages(spark):
    rows = [(i, "the quick brown fox " * 3, "en", "s", 0) for i in range(200)] + [(900 + i, "der schnelle fuchs", "de", "s", 0) for i in range(4)]
    rows += [(2000 + i, t, None, "s", 0) for i, t in enumerate(["½", "②", "Ⅳ ² 12", "日本", None])] + [(1, "the quick brown fox", "en", "s", 0)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in language_id.identify_languages(docs, vocabulary=8).collect()}
    assert [out[2000 + i].lang_pred for i in (0, 1, 2, 4)] == ["und"] * 4
    assert out[900].lang_pred == "de" and out[5].lang_pred == "en" and out[2003].score == 0.5
    assert language_id.labelled_sample(docs, 5).count() == 5


def test_language_odd_inputs(spark, odd):
    out = {r.doc_id: r for r in language_id.identify_languages(odd).collect()}
    assert (out[0].lang_pred, out[0].score) == ("und", 0.0) and out[1].lang_pred == out[2].lang_pred == "und" and out[3].lang_pred == "en"
    assert language_id.identify_languages(empty(spark)).count() == 0


def test_id_store_round_trip(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    store = id_store.write_store(odd, path)
    library = pretokens.tokenizer(path)
    rows = id_store.check_documents(store).orderBy("start").collect()
    assert len(rows) == odd.count() and all(r.verified for r in rows)
    want = sorted((r.text or "") for r in odd.collect())
    whole = {r.start: r.ids for r in id_store.read_documents(store).collect()}
    at = 0
    for r in rows:
        ids = np.array(whole[r.start], "<u4")
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    got = sorted(tuple(x[:-1]) for x in whole.values())
    assert got == sorted(tuple(library.encode(t, add_special_tokens=False).ids) for t in want)
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert id_store.verify_manifest(store).count() == 0
    lost = id_store.Store(spark, store.path)
    lost.chunks = lambda: store.chunks().where(F.col("n_ids") > 2)
    assert {r.verified for r in id_store.check_documents(lost).collect()} == {True, False}
    assert store.chunks().count() == store.chunks().select("digest").distinct().count()
    assert id_store.check_documents(id_store.write_store(empty(spark), path)).count() == 0


def test_id_store_equals_the_library_on_documents(spark, docs, local):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, at = pretokens.tokenizer(path), 0
    rows = id_store.check_documents(id_store.write_store(docs.repartition(5), path)).orderBy("doc_id").collect()
    texts = dict(zip(local.doc_id, local.text, strict=True))
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (at, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)


def test_a_word_before_a_sign_goes_to_the_library_once():
    library, sent = pretokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json")), []
    encoder = pretokens.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.library = SimpleNamespace(encode_batch_fast=lambda texts, **k: sent.extend(texts) or library.encode_batch_fast(texts, **k))
    texts = ["the zanbeta, a zanbeta. zanbeta; zanbeta: zanbeta!", "one zanbeta\nzanbeta?"]
    flat, sizes = encoder.encode_block(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert "".join(sent).count("zanbeta") == 2  # after a space and after a line feed


def test_ids_of_odd_texts_equal_the_library():
    """Signs, white space and characters at which a text may or may not be cut, in an Arrow slice with nulls."""
    library = pretokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = ["the", "Don't", "'s", "'re,", "été", "été,", "1", "a1.", ".", "...", "!?", "<", "|", "<|endoftext|>", " ", " ", " ", " ", "\n", "\n\n", "\t", "\xa0", "\u2028", "…", "”,", "€", "日本", "\0", "\x7f", "İ", "ı", "ſ", "½;"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(pieces[: 8 if i % 2 else None] + [" "] * 4, 1 + i % 17)) for i in range(3_000)]
    texts[5], texts[6], texts[-1] = None, "", None
    taken = pretokens.can_cut(pretokens.as_texts(texts))
    assert 300 < taken.sum() < 2_700
    encoder = pretokens.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for some, own in ((pa.array(["x ", None, *texts, "y"]).slice(2, len(texts)), texts), ([], []), ([None], [None])):
        flat, sizes = encoder.encode_block(some)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in own]
        assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_id_store_takes_text_ids(spark):
    rows = spark.createDataFrame([("b", "two"), ("a", "one"), ("b", "again")], "doc_id string, text string")
    out = id_store.check_documents(id_store.write_store(rows, public_tokenizers.path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in out] == ["a", "b", "b"] and all(r.verified for r in out)


def test_chunk_marks_depend_on_order():
    ids = np.random.default_rng(2).integers(0, 50_000, 8_000).astype(np.uint32)
    swapped = ids.reshape(-1, 2)[:, ::-1].ravel()
    assert len(id_store.marks(ids)) and id_store.marks(ids).tolist() != id_store.marks(swapped).tolist()


def test_chunks_of_a_shared_passage_are_equal():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    parts = []
    for k in (700, 1300):
        ids = np.r_[rng.integers(0, 50_000, k).astype(np.uint32), shared]
        ends = id_store.cuts(ids)
        assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= id_store.MOST
        parts.append({id_store.digest(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)})
    assert len(parts[0] & parts[1]) > 0.8 * len(parts[0])


def test_crc_join():
    a, b = os.urandom(1000), os.urandom(313)
    assert id_store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_crc_push_takes_many_lengths_at_once():
    n = np.array([0, 1, 4, 511, 16_384, 70_001])
    first, rest = [os.urandom(100) for _ in n], [os.urandom(k) for k in n.tolist()]
    got = id_store.crc_push(np.array([zlib.crc32(a) for a in first], np.uint32), n) ^ np.array([zlib.crc32(b) for b in rest], np.uint32)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(first, rest, strict=True)]


def test_sentencepiece_equals_the_library(spark, odd, docs, local):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_codec.encode_documents(odd, path, decoded=True).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.piece_ids == library.encode(r.text or "") and r.round_trip and r.decoded == (r.text or "")
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs, path).collect()}
    for d, t in zip(local.doc_id, local.text, strict=True):
        assert got[d].piece_ids == library.encode(t) and got[d].round_trip and got[d].n_pieces == len(got[d].piece_ids)
    assert sentencepiece_codec.encode_documents(empty(spark), path).count() == 0


def test_long_words_merge_as_short_ones_do(local):
    own = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({w for t in local.text.head(40) for w in own.split(t)} | {"▁" + "=" * 39, "▁" + "ab" * 19, "▁日本語🎉"})
    for size in {len(w) for w in words if len(w) <= sentencepiece_codec.BATCHED}:
        same = [w for w in words if len(w) == size]
        assert own.segment(same) == [own.segment_long(w) for w in same]


def test_viterbi_finds_the_best_sum():
    own = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))

    def best(word):
        top = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            options = [(top[i][0] + own.scores[k], [*top[i][1], k]) for i in range(j) if i in top and (k := own.piece_id.get(word[i:j])) is not None]
            if options:
                top[j] = max(options, key=lambda o: o[0])
        return top[len(word)][0]

    words = ["▁hello", "▁there", "▁never"]
    found = own.segment(["▁hello", "▁never"], own.viterbi) + own.segment(["▁there"], own.viterbi)
    assert sorted(sum(own.scores[i] for i in ids) for ids in found) == sorted(best(w) for w in words)


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_classes(rows):
    """Smallest linked id over links of Jaccard 0.8 or more; texts without words link to equal texts alone."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverted[x].append(i)
    pairs = {(a, b) for v in inverted.values() for a in v for b in v if a < b}
    first = {}
    for i, (_, t) in enumerate(rows):
        if (t or "") in first:
            pairs.add((first[t or ""], i))
        first.setdefault(t or "", i)
    for a, b in pairs:
        if (rows[a][1] or "") == (rows[b][1] or "") or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_near_duplicates_equal_brute_force(spark, docs, local):
    want = brute_classes(sorted(zip(local.doc_id, local.text, strict=True)))
    got = {r.doc_id: r.class_id for r in order_minhash.duplicate_classes(docs).collect()}
    assert got == want


def test_large_family_of_near_copies(spark):
    """Copies of one text with 0 to 3 changed words: pairs of copies are often below the threshold, the classes are not."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 150)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in rng.integers(0, 150, i % 4):
            w[j] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want = brute_classes([(r[0], r[1]) for r in rows])
    got = {r.doc_id: r.class_id for r in order_minhash.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.995 * len(want)


def test_form_letters_equal_brute_force(spark):
    """Pairs within one template: every text is near the threshold to every other, but linked to its partner alone."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(760)]
    rows = []
    for pair in range(150):
        shared = [f"s{pair}x{i}" for i in range(45)]
        for side in range(2):
            own = [f"o{pair}x{side}x{i}" for i in range(80)]
            rows.append((2 * pair + side, " ".join(template + shared + own), "en", "s", 0))
    rng.shuffle(rows)
    rows = [(int(r[0]), *r[1:4], 0) for r in rows]
    want = brute_classes([(r[0], r[1]) for r in rows])
    assert len(set(want.values())) == 150
    got = {r.doc_id: r.class_id for r in order_minhash.duplicate_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_near_duplicates_odd_inputs(spark, odd):
    out = order_minhash.duplicate_classes(odd).collect()
    assert len(out) == odd.count()
    assert {r.class_id for r in out if r.doc_id == 3} == {3} and {r.doc_id: r.class_id for r in out}[0] == 0
    kept = order_minhash.keep_one_per_class(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id is null").count() == 1
    assert order_minhash.duplicate_classes(empty(spark)).count() == 0


def test_near_duplicates_under_repeated_ids(spark):
    """Two texts under one id are two texts: each is linked to its own near copy, and classes of one name are told apart."""
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    rows = [(3, a, "en", "s", 0), (3, b, "en", "s", 0), (7, a + " end", "en", "s", 0), (8, b + " end", "en", "s", 0), (3, a, "fr", "s", 0), (None, a, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit("clash")).withColumn("Node", F.lit(1))
    rows = order_minhash.duplicate_classes(docs).collect()
    by_id = {k: {(r.class_id, r.class_no) for r in rows if r.doc_id == k} for k in (3, 7, 8)}
    assert len(rows) == 6 and by_id[7] | by_id[8] == by_id[3] and len(by_id[3]) == 2 and by_id[7] != by_id[8] and {c for c, _ in by_id[3]} == {3}
    kept = order_minhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "a"), (3, "a"), (3, "b")]


def test_alignment_needs_order():
    a = order_minhash.labelled(order_minhash.shingles(" ".join(f"a{i}" for i in range(200))))
    b = order_minhash.labelled(order_minhash.shingles(" ".join([f"a{i}" for i in range(100, 200)] + [f"a{i}" for i in range(100)])))
    assert order_minhash.aligned_similarity(a, a, 64, 0.8) == 1.0 and order_minhash.aligned_similarity(a, b, 64, 0.8) == 0.0


def test_media_read_back(spark, odd):
    out = media_columns.text_media(odd).collect()
    assert len(out) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload)) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(media_columns.as_image(payload)).hexdigest()
    assert media_columns.text_media(empty(spark)).count() == 0


def test_interleaved_page(spark):
    html = "<h1>Top</h1><p>one <b>two</b><img src='a.png' alt='pic'>three</p><script>x</script><figure><img src='digest:sha256/AB'><figcaption>cap &amp; more</figcaption></figure><p>end"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    facts = spark.createDataFrame([("ab", 7)], "digest string, size int")
    out = {r.page_id: r["items"] for r in media_columns.resolve(media_columns.interleave(pages), facts).collect()}
    assert [(i.kind, i.text or i.url, i.caption) for i in out[1]] == [("text", "Top", None), ("text", "one two", None), ("media", "a.png", "pic"), ("text", "three", None), ("media", "digest:sha256/AB", "cap & more"), ("text", "end", None)]
    assert [i.position for i in out[1]] == list(range(6)) and out[1][4].media.size == 7 and out[1][2].media is None
    assert not out[2] and not out[3]


def test_captions_and_open_tags():
    def items(html):
        return [(i[1], i[2] or i[3], i[5]) for i in media_columns.parse_page(html)]

    assert items("<figure><figcaption>before</figcaption><img src=a></figure><p>x") == [("media", "a", "before"), ("text", "x", None)]
    assert items("<figure><figcaption>alone</figcaption></figure><p>y") == [("text", "alone", None), ("text", "y", None)]
    assert items("<p>a<figure><img src=b><figcaption>open<p>more</p></figure>after") == [("text", "a", None), ("media", "b", "open more"), ("text", "after", None)]
    assert items("<section><figure><img src=c><figcaption>open</section><p>rest") == [("media", "c", "open"), ("text", "rest", None)]
    assert items("<figcaption>no figure</figcaption>") == [("text", "no figure", None)]
    assert items("<figure><img src=d><figcaption>c1</figcaption><figure><img src=e><figcaption>in</figcaption></figure></figure>z") == [("media", "d", "c1"), ("media", "e", "in"), ("text", "z", None)]


def test_given_pages_keep_their_words(spark, sf):
    """Words of the items, in order, against a page stripped by patterns."""
    import html as H

    got = {r.page_id: r for r in queries.pages_interleaved(spark, sf).collect()}
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    assert len(got) == len(pages)
    for page_id, page in zip(pages.page_id, pages.html, strict=True):
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1>|<!DOCTYPE[^>]*>", "", page)
        words = H.unescape(re.sub(r"(?i)</?(b|i|a|em|strong|span|u)\b[^>]*>", "", bare))
        words = re.sub(r"<[^>]*>", " ", words).split()
        assert " ".join(i.text for i in got[page_id]["items"] if i.text).split() == words
        assert got[page_id].n_texts == len(got[page_id]["items"]) and [i.position for i in got[page_id]["items"]] == list(range(len(got[page_id]["items"])))


def test_token_counts_equal_the_library(spark, odd, docs, local):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = pretokens.tokenizer(path)
    for r in token_counts.count_tokens(odd, path).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    got = token_counts.count_tokens(docs, path).toPandas().set_index("doc_id")
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in zip(local.doc_id, local.text, strict=True)}
    assert got.n_tokens.to_dict() == want and (got.over_limit == (got.n_tokens > 2048)).all()
    assert token_counts.count_tokens(empty(spark), path).count() == 0
    counts = pretokens.counts_of(path)
    for text in [*ODD[1:], "Привет, МИР!", "a<|startoftext|><|endoftext|> b", "İSTANBUL ǅ ﬁ Å Å", "\u2028x\u00a0y\u3000z", "कि क्या 日本語12", *local.text.head(60)]:
        assert counts.of_text(text) == len(library.encode(text, add_special_tokens=False).ids), text[:40]


def test_forest_recall_and_exact_scores(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    v, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    out = forest_search.nearest(spark.read.parquet(f"{sf}/embeddings.parquet")).toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
        assert g.sort_values("rank").score.is_monotonic_decreasing and np.allclose(g.score, [s[ids == x][0] for x in g.vec_id], atol=1e-12)
    assert hits >= 0.9 * len(out) and len(out) == 20 * (ids % 20 == 0).sum()


def test_forest_odd_inputs(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0])]
    out = forest_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [(0, 8, 2.0), (0, 1, 1.0), (0, 20, 1.0), (20, 8, 2.0), (20, 0, 1.0), (20, 1, 1.0)]
    assert forest_search.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert out[out.predicted == 1].toxic.mean() > 0.9 and out[out.toxic == 1].predicted.mean() > 0.6 and out.score.between(0, 1).all()


def test_toxicity_grammar():
    g = toxicity.Grammar({}, {"idiot": 5.0})
    kind = lambda text: [toxicity.KINDS[i] for i, x in enumerate(g.features(text)[: len(toxicity.KINDS)]) if x > 0]
    assert kind("an idiot") == ["plain"] and kind("you are such an idiot") == ["targeted"] and kind("you are not an idiot") == ["negated"]
    assert kind("she said that man is an idiot") == ["reported"] and kind('the word "idiot" here') == ["reported"] and kind("not here. an idiot") == ["plain"] and kind("calm") == []
    assert kind("such an idiot are you") == ["targeted"]
    assert kind("kill the process") == ["threat"] and kind("I will kill you") == ["aimed"] and kind("you I will kill") == ["aimed"] and kind("I will not kill you") == ["negated"]
    assert kind("an idiot here. I will kill you. kill it") == ["threat", "plain", "aimed"]
    assert g.features("I will kill you")[:6].sum() > g.features("kill the process")[:6].sum()


def test_toxicity_equals_a_plain_reading(spark):
    """Each clause read by distances between its words, without machines, for all documents; then the fitted weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scorer = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    g = scorer.grammar

    def plain(text):
        sums, clauses, quoted = dict.fromkeys(toxicity.KINDS, 0.0), [[]], False
        tokens = toxicity.TOKEN.findall(text.lower())
        for t in tokens:
            if t in ".!?;\n":
                clauses.append([])
                quoted = quoted and t != "\n"
            elif t in '"«»“”':
                quoted = not quoted
            else:
                clauses[-1].append((*g.symbol(t), quoted))
        weights = []
        for c in clauses:
            kinds, total = [], 0.0
            near = lambda i, what, reach: any(c[j][0] == what for j in range(max(0, i - reach), i))  # noqa: B023, E731
            for i, (symbol, weight, quote) in enumerate(c):
                if symbol not in (toxicity.INSULT, toxicity.THREAT):
                    continue
                aim = near(i, toxicity.TARGET, toxicity.TARGET_REACH) or any(x[0] == toxicity.TARGET for x in c[i + 1 : i + 1 + toxicity.TARGET_REACH])
                if near(i, toxicity.NEGATION, toxicity.NEGATION_REACH):
                    kind = "negated"
                elif quote or near(i, toxicity.REPORT, len(c)):
                    kind = "reported"
                elif symbol == toxicity.INSULT:
                    kind = "targeted" if aim else "plain"
                else:
                    kind = "aimed" if aim else "threat"
                kinds.append(kind)
                total += weight * toxicity.SHARE[kind]
            if kinds:
                sums[max(kinds, key=toxicity.KINDS.index)] += total
                weights.append(total)
        x = np.log1p([*sums.values(), max(weights, default=0), len(weights), 100 * sum(weights) / max(len(tokens), 1)])
        return 1 / (1 + np.exp(-np.clip(x @ scorer.weights + scorer.bias, -50, 50)))

    rows = docs.select("doc_id", "text", toxicity.score_column(scorer, F.col("text"), spark).alias("score")).collect()
    assert max(abs(r.score - plain(r.text)) for r in rows) < 1e-9 and max(r.score for r in rows) > 0.7


def test_toxicity_under_repeated_ids_and_clashing_columns(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    more = docs.withColumns({"toxic_label": F.lit("clash"), "h1": F.lit(1), "Toxic": F.lit(1), "score": F.lit(0)})
    assert toxicity.labelled_sample(more.union(more).union(more.withColumn("text", F.concat("text", F.lit(" x")))), labels, 20).count() == 20
    kept = toxicity.drop_toxic(more, labels)
    assert kept.columns == more.columns and kept.count() == toxicity.drop_toxic(docs, labels).count()
    assert {(r.doc_id, r.score) for r in toxicity.score_toxicity(more, labels).collect()} == {(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, labels).collect()}


def test_toxicity_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(13)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0 and toxicity.score_toxicity(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_poisson_inverse_and_targets(spark):
    import math

    rows = spark.range(20_000).select(source_mixing.hash_uniform(F.lit(1), F.col("id")).alias("u"))
    got = rows.select("u", source_mixing.poisson_inverse(F.col("u"), source_mixing.poisson_table(F.lit(3.5))).alias("n")).collect()
    for r in got[:500]:
        cdf, k, p = math.exp(-3.5), 0, math.exp(-3.5)
        while r.u >= cdf:
            k += 1
            p *= 3.5 / k
            cdf += p
        assert r.n == k
    assert abs(np.mean([r.n for r in got]) - 3.5) < 0.06
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"), F.lit("clash").alias("rate"))
    out = source_mixing.mix_sources(docs, weights={"small": 3.0, "large": 1.0})
    share = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(share["small"] / (share["small"] + share["large"]) - 0.75) < 0.02 and out.schema["rate"].dataType.simpleString() == "double"


def test_mixing_odd_inputs(spark, odd):
    assert source_mixing.mix_sources(empty(spark)).count() == 0
    out = source_mixing.mix_sources(odd, target_ratio=40.0)
    assert out.where("source is null").count() > 0 and out.columns == [*odd.columns, "copy_no", "rate"]


CLASHES = {"h1": "x", "h2": "y", "row": "r", "rep": "q", "body": "b", "node": "n", "key": "k", "Score": "s", "digest": "d", "n_tokens": "t", "items": "i", "media": "m", "stored": "w", "coded": "c", "Lang_Pred": "l"}


def test_clashing_columns_change_nothing(spark, docs, sf):
    """Extra columns named like those that operators use inside, in any case of letters, leave every result as it is."""
    few = docs.orderBy("doc_id").limit(40)
    more = few.withColumns({n: F.lit(v) for n, v in CLASHES.items()})
    runs = {
        "2": language_id.identify_languages, "3": lambda d: id_store.check_documents(id_store.write_store(d, public_tokenizers.path("byte_bpe_50k.json"))),
        "4": lambda d: sentencepiece_codec.encode_documents(d, public_tokenizers.path("piece_bpe_32k.model")), "6": media_columns.text_media,
        "5": lambda d: order_minhash.duplicate_classes(d).drop("class_no"), "7": lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    }
    for n, run in runs.items():
        assert sorted(map(str, run(more).collect())) == sorted(map(str, run(few).collect())), n
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    assert sorted(forest_search.nearest(vectors.withColumns({"id": F.lit(1), "v": F.lit(2), "key": F.lit(3)})).collect()) == sorted(forest_search.nearest(vectors).collect())


def test_texts_of_several_megabytes(spark):
    """Two texts of 2 MB of words, and one of 1 MB without any white space, whole through every operator on texts."""
    rng = np.random.default_rng(8)
    long = " ".join(f"w{i}" for i in rng.integers(0, 60_000, 330_000))
    solid = "".join(map(chr, rng.integers(97, 123, 1_000_000)))
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, solid, "de", "t", 0), (4, "short text", "en", "s", 0)], SCHEMA)
    texts = {1: long, 2: long + " end", 3: solid, 4: "short text"}
    lines = {r.doc_id: r for r in line_dedup.drop_common_lines(docs, min_docs=2).collect()}
    assert all(lines[d].kept_text == t for d, t in texts.items())
    assert {r.doc_id for r in language_id.identify_languages(docs).collect()} == set(texts)
    store = id_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    library = pretokens.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for r in id_store.check_documents(store).collect():
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.verified and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    assert all(r.round_trip for r in sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert {r.doc_id: r.class_id for r in order_minhash.duplicate_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_bytes for r in media_columns.text_media(docs).collect()} == {d: len(t) for d, t in texts.items()}
    path = public_tokenizers.path("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == {d: len(pretokens.tokenizer(path).encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 4
