"""Media columns: interleaved sequences of text and media references, and media stored under their digests.

``interleave`` parses HTML into an ordered array of structs, text or media reference, each with its position; a reference
has its digest, where the page gives one, and its caption. ``store_payloads`` writes binary columns as 8-bit image samples.
``resolve`` joins references to stored media by digest and puts every sequence together again in its order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise, shared_path, ship

ITEM = "position int, kind string, text string, url string, digest string, caption string"
MEDIA_TAGS = frozenset({"img", "video", "audio", "source", "embed"})
HIDDEN = frozenset({"script", "style", "template", "noscript"})
BLOCKS = frozenset("p div section article aside header footer main nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 br hr blockquote pre figure figcaption dl dt dd form".split())
#: Elements whose end closes a figure that was left open inside them.
CONTAINERS = frozenset("section article aside header footer main nav form".split())
DIGEST_SCHEME = "digest:sha256/"
#: Samples of one image row, and the multiple to which payloads are filled with spaces.
ROW = 192


class _Page(HTMLParser):
    """Collects the items of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.buffer: list[str] = []
        self.hidden = 0
        self.figures: list[list] = []  # of each open figure its media and its captions
        self.caption = False  # whether the buffer is a caption's

    def _flush(self) -> None:
        """Put out the text collected so far: as the open figure's caption, or as an item."""
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not text:
            return
        if self.caption:
            self.figures[-1][1].append((len(self.items), text))
        else:
            self.items.append(["text", text, None, None, None])

    def _close_figure(self) -> None:
        self._flush()
        self.caption = False
        media, captions = self.figures.pop()
        if media:
            text = " ".join(t for _, t in captions)
            for item in media:
                item[4] = text or item[4]
            return
        for place, text in reversed(captions):  # nothing to caption: it is text, where it stood
            self.items.insert(place, ["text", text, None, None, None])

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA_TAGS and (url := at.get("src")):
            self._flush()
            item = ["media", None, url, url[len(DIGEST_SCHEME) :].lower() if url.startswith(DIGEST_SCHEME) else None, at.get("alt") or at.get("title") or None]
            if self.figures:
                self.figures[-1][0].append(item)
            self.items.append(item)
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure":
                self.caption = False
                self.figures.append([[], []])
            elif tag == "figcaption":
                self.caption = bool(self.figures)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self._flush()
            if tag == "figcaption":
                self.caption = False
            elif tag == "figure" and self.figures:
                self._close_figure()
            elif tag in CONTAINERS:  # what a figure's own end tag was left out of ends it
                while self.figures:
                    self._close_figure()

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)

    def finish(self) -> None:
        while self.figures:
            self._close_figure()
        self._flush()


def parse_page(html: str | None) -> list[tuple]:
    """``(position, kind, text, url, digest, caption)`` of a page's items, in order."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.finish()
    return [(i, *item) for i, item in enumerate(page.items)]


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, items array<struct<position, kind, text, url, digest, caption>>`` of every whole page.

    ``kind`` is ``text`` or ``media``. Text is broken at block elements and at media; white space is folded; scripts and
    styles are left out. A figure's captions, before or after its media, go to all of these and not into the text; where a
    figure has no media they are text. A caption that is not closed ends with its figure, and a figure that is not closed ends
    with the section around it, or with the page: then the text inside it counts as caption. A caption outside a figure is text. Media whose
    address is ``digest:sha256/<hex>`` have that digest. Null and empty pages have no items; broken markup loses no text but
    what follows a hidden element that is never closed; repeated rows give equal rows; other columns are not used.
    """
    ship(pages.sparkSession)

    @F.pandas_udf(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in ITEM.split(', '))}>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = [c.split()[0] for c in ITEM.split(", ")]
        for texts in batches:
            yield pd.Series([[dict(zip(names, item, strict=True)) for item in parse_page(t)] for t in texts], dtype=object)

    return pages.select(F.col(key), parse(F.col(html)).alias("items"))


def as_image(payload: bytes) -> bytes:
    """A binary PGM of 8-bit samples, 192 to a row: the payload's bytes are the samples."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_image(stored: bytes) -> bytes:
    """The samples of what ``as_image`` made."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a binary 8-bit PGM")
    return samples


def store_payloads(texts: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store every text as an image; returns the stored media and the pages that refer to them.

    The payload is the text's UTF-8 (null: empty), filled with spaces to a positive multiple of 192 bytes. Media, written
    as Parquet: ``key, digest, n_bytes, media binary``, one row per input row in the order of the input, so that nothing
    but a digest is ever shuffled. Pages: ``key, html``, a figure whose address is the digest of the stored form and
    whose caption names the unpadded length.
    """
    spark = texts.sparkSession
    ship(spark)

    @F.pandas_udf("digest string, n_bytes long, media binary")
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in bodies]
            media = [as_image(d.ljust(max(1, -(-len(d) // ROW)) * ROW)) for d in data]
            yield pd.DataFrame({"digest": [hashlib.sha256(m).hexdigest() for m in media], "n_bytes": [len(d) for d in data], "media": media})

    path = shared_path(spark, "media")
    texts.select(F.col(key), store(F.col(text)).alias("stored")).select(key, "stored.*").write.option("compression", "zstd").parquet(path)
    media = spark.read.parquet(path)
    html = F.concat(F.lit(f'<figure><img src="{DIGEST_SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    return media, media.select(key, html.alias("html"))


def describe_media(media: DataFrame) -> DataFrame:
    """Features of stored media, one row per digest, from the bytes read back.

    ``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``; the feature is the samples'
    mean, standard deviation and share of spaces, and the mean step along a row, each with six digits.
    """
    ship(media.sparkSession)

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            rows = []
            for m in stored:
                payload = from_image(bytes(m))
                x = np.frombuffer(payload, np.uint8)
                n, total, squares, spaces, steps = len(x), 0, 0, 0, 0
                for i in range(0, n, ROW * 4096):  # long texts in blocks
                    part = x[i : i + ROW * 4096].astype(np.int64)
                    total, squares, spaces = total + int(part.sum()), squares + int((part * part).sum()), spaces + int((part == 32).sum())
                    steps += int(np.abs(np.diff(part.reshape(-1, ROW), axis=1)).sum())
                mean = total / n
                feature = f"mean={mean:.6f};sd={max(squares / n - mean * mean, 0.0) ** 0.5:.6f};spaces={spaces / n:.6f};step={steps / n:.6f}"
                rows.append((n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    facts = media.select("digest", describe("media").alias("m")).select("digest", "m.*")
    return facts.groupBy("digest").agg(*[F.first(c).alias(c) for c in facts.columns[1:]])


def resolve(sequences: DataFrame, facts: DataFrame, key: str = "page_id") -> DataFrame:
    """Sequences whose media references are resolved: ``key, items`` with a struct ``media`` in each item (null if unknown).

    References and facts meet by digest. ``facts`` has one row per digest and is written before the join, whose shuffles then
    read plain tables: adaptive execution splits a digest that a third of the rows refer to. Items return to their sequence by its row number, and to their order by their position. A sequence
    without items stays, with none.
    """
    numbered = sequences.withColumn("seq_row", F.monotonically_increasing_id())
    numbered = materialise(numbered.select("seq_row", key, "items"), "media-sequences")  # the numbers must not be drawn twice
    facts = materialise(facts, "media-facts")
    found = facts.select(F.col("digest").alias("ref"), F.struct(*[c for c in facts.columns if c != "digest"]).alias("media"))
    items = numbered.select("seq_row", F.explode("items").alias("item"))
    joined = items.join(found, F.col("item.digest") == F.col("ref"), "left")
    fields = [F.col(f"item.{c.split()[0]}").alias(c.split()[0]) for c in ITEM.split(", ")]
    again = joined.groupBy("seq_row").agg(F.array_sort(F.collect_list(F.struct(*fields, "media"))).alias("items"))
    return numbered.select("seq_row", key).join(again, "seq_row", "left").select(key, "items")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as stored media and read back: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    Each text is stored losslessly, a page refers to it by the digest of its stored form, and the reference is resolved to
    what the bytes read back give. Null texts are empty ones (192 spaces); equal texts have equal values; repeated rows
    and null ids are kept.
    """
    media, pages = store_payloads(docs)
    found = resolve(interleave(pages, "doc_id"), describe_media(media), "doc_id")
    item = F.element_at("items", 1)
    return found.select(
        "doc_id", F.split(item["caption"], " ")[0].cast("long").alias("n_bytes"),
        *[item["media"][c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")],
    )
