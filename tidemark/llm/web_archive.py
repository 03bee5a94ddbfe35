"""WARC archives: written by tasks, one gzip member a record, and read by byte ranges.

The reader is splittable although nothing indexes the archives: a task scans its range for the bytes that begin a gzip member,
decodes what follows, and takes a place for a record's start only if a WARC header comes out. It owns the records that start
inside its range and reads the last of them to its end, wherever that is.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialise, shared_path, ship

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
#: The profile of a record whose payload another record holds.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean"
#: Bytes read at once, and payload bytes that a batch of records holds.
READ, BATCH = 1 << 20, 8 << 20
PREFIX = "urn:page:"


def digest_of(payload: bytes) -> str:
    """The bare base32 form of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(kind: str, record_id: str, date: str, uri: str | None, block: bytes, content: str, **more: str | None) -> bytes:
    """A record as it stands in an archive before compression. Control characters and spaces of an address are escaped."""
    uri = None if uri is None else re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: quote(m[0]), uri)
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Type": content, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member_of(record: bytes) -> bytes:
    """One gzip member in which no other place looks like a record's start.

    Only a payload that holds an archive itself can make such a place, where deflate stores it as it is; then the record is compressed in
    another way, at last by codes of single bytes alone, which store nothing.
    """
    for level, strategy in ((5, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_HUFFMAN_ONLY), (9, zlib.Z_FIXED)):
        deflate = zlib.compressobj(level, zlib.DEFLATED, 31, 8, strategy)
        member = deflate.compress(record) + deflate.flush()
        at = member.find(MAGIC, 1)
        while at >= 0 and not starts_record(member[at : at + 256]):
            at = member.find(MAGIC, at + 1)
        if at < 0:
            return member
    raise ValueError("every form of this record holds what looks like a record's start")


def starts_record(data: bytes) -> bool:
    """Whether a gzip member begins here that decodes to a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, len(VERSION)).startswith(b"WARC/1.")
    except zlib.error:
        return False


def page_record(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: object, date: str) -> bytes:
    """A page as a response, or as a revisit (no ``payload``) of the page ``refers_to``; both tell the whole payload's size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda x: PREFIX + ("" if x is None else quote(str(x), safe=""))
    same = {} if payload is not None else {"WARC_Profile": SAME_PAYLOAD, "WARC_Refers_To": f"<{name(refers_to)}>"}
    return record_of("response" if payload is not None else "revisit", name(page_id), date, url, http + (payload or b""), "application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{digest}", **same)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", least_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for every row of ``key, url, html`` and return the archives: ``path, bytes, records``.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``least_bytes`` the row with the largest key
    is a response and the others revisit it; smaller payloads are all responses. A null key is less than any other. Rows that repeat
    the largest key with the same payload are all responses; records of repeated rows have the same record id. Other columns are not used; an empty table gives no archive.

    Digests are taken where the pages are read; an aggregation with partial results finds each payload's largest key, so a
    payload that a third of the pages share costs a row a task. That table is written, and pages meet it by digest: Spark
    broadcasts it where it is small and else splits a hot digest. Each task writes archives of about ``archive_bytes`` under names of
    its attempt's own; the list of archives is written last and names those of attempts that succeeded, so a lost executor or
    a second attempt leaves files that nothing reads.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"), body.cast("binary").alias("body"), F.sha1(body.cast("binary")).alias("sha1"))
    latest = materialise(pages.select(F.col(key).alias("key"), F.sha1(body.cast("binary")).alias("sha1")).groupBy("sha1").agg(F.max("key").alias("latest")), "payloads")
    size = F.octet_length("body").cast("long")
    own = (F.col("key").eqNullSafe(F.col("latest"))) | (size < least_bytes)
    dealt = rows.join(latest, "sha1").select(F.col("key").cast("string").alias("key"), "url", F.when(own, F.col("body")).alias("payload"), size.alias("size"), "sha1", F.col("latest").cast("string").alias("latest"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (files, root), out = _files(path), None
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done: list[list] = []
        for batch in batches:
            for key, url, payload, size, sha1, latest in batch[["key", "url", "payload", "size", "sha1", "latest"]].itertuples(index=False, name=None):
                if out is None:
                    file = f"{name}-{len(done):04d}.warc.gz"
                    out = files.open_output_stream(f"{root}/{file}", compression=None)
                    info = member_of(record_of("warcinfo", f"urn:archive:{file}", date, None, b"software: tidemark\r\nformat: WARC File Format 1.1\r\n", "application/warc-fields", WARC_Filename=file))
                    out.write(info)
                    done.append([f"{path}/{file}", len(info), 0])
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = member_of(page_record(key, url, None if payload is None else bytes(payload), size, digest, latest, date))
                out.write(member)
                done[-1][1] += len(member)
                done[-1][2] += 1
                if done[-1][1] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    archives = materialise(dealt.mapInPandas(write, "path string, bytes long, records long"), "archives")
    discard(latest)
    return archives


def _files(path: str) -> tuple:
    """The file system of a path, any that pyarrow knows (a shared mount, hdfs, s3), and the path in it."""
    from pyarrow import fs

    found, root = fs.FileSystem.from_uri(path)
    if isinstance(found, fs.LocalFileSystem):
        found.create_dir(root, recursive=True)
    return found, root


class _Window:
    """A stretch of a file that grows at its end and is dropped at its beginning, addressed by offsets in the file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, begin: int, n: int = READ) -> bytes:
        """At least one byte from ``begin`` on, and up to ``n``, or none at the file's end."""
        if not (self.at <= begin < self.at + len(self.data)):
            self.file.seek(begin)
            self.at, self.data = begin, self.file.read(max(0, min(READ, self.size - begin)))
        return self.data[begin - self.at : begin - self.at + n]

    def exactly(self, begin: int, n: int) -> bytes:
        """``n`` bytes from ``begin`` on, fewer only at the file's end."""
        out = self.get(begin, n)
        while len(out) < n and (part := self.get(begin + len(out), n - len(out))):
            out += part
        return out


def _member(window: _Window, begin: int) -> tuple[bytes, int] | None:
    """The decoded member that begins there and where it ends; none if it is broken or cut off."""
    inflate, at, out = zlib.decompressobj(31), begin, []
    try:
        while not inflate.eof:
            data = window.get(at)
            if not data:
                return None
            out.append(inflate.decompress(data))
            at += len(data)
    except zlib.error:
        return None
    return b"".join(out), at - len(inflate.unused_data)


def parse_record(record: bytes) -> dict | None:
    """Fields of a decoded record, its block and its payload; none if it is no whole record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) < int(size) or "warc-type" not in fields or "warc-record-id" not in fields:
        return None
    block = rest[: int(size)]
    out = {"fields": fields, "payload": block, "http": {}}
    if fields.get("content-type", "").startswith("application/http"):
        http, _, out["payload"] = block.partition(b"\r\n\r\n")
        out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return out


def records_in(file, size: int, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records that start in ``[begin, end)`` of an open archive of ``size`` bytes, with their offsets.

    From a record's end the next is expected right there. Where there is none (the range's begin, a damaged stretch) the bytes are scanned
    for a member's first three; the place counts if a header decodes, its whole member does, with its checksum, and another
    member or the file's end follows.
    """
    window, at, known = _Window(file, size), begin, False
    end = min(end, size)
    while at < end:
        if not known or window.exactly(at, 3) != MAGIC:
            known = False
            data = window.exactly(at, min(READ, end - at + 2))
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - 2)
                continue
            at += found
            if at >= end:
                return
        whole = _member(window, at) if starts_record(window.exactly(at, 256)) else None
        record = parse_record(whole[0]) if whole else None
        if record is None or not (known or whole[1] >= size or window.exactly(whole[1], 3) == MAGIC):
            at, known = at + 1, False
            continue
        yield at, record
        at, known = whole[1], True


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """The records of archives, ``path, bytes``: path, offset, record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload, intact.

    Archives are cut into ranges of ``split_bytes``, however large they are, and the ranges are dealt to tasks. ``payload``
    is null for revisits; their ``payload_bytes`` is what their HTTP header says of the whole payload, of others the bytes' number. ``intact``: the payload has the
    record's digest (null without a payload or digest). Damaged stretches give no record. An archive without records, or no archive, gives no rows.
    """
    ship(spark)
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / F.lit(split_bytes)))).first()[0] or 1
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = archives.select("path", "bytes", F.explode(begins).alias("begin")).repartition(int(min(n, 50_000)), "path", "begin")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for path, size, begin in batch[["path", "bytes", "begin"]].itertuples(index=False, name=None):
                folder, _, name = path.rpartition("/")
                files, root = _files(folder)
                with files.open_input_file(f"{root}/{name}") as file:
                    for offset, record in records_in(file, size, begin, begin + split_bytes):
                        rows.append((path, offset, *_row(record)))
                        held += len(record["payload"])
                        if held >= BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return ranges.mapInPandas(read, RECORD)


def _row(record: dict) -> tuple:
    fields, payload = record["fields"], record["payload"]
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    digest = fields["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in fields else None
    if fields["warc-type"] == "revisit":
        told = record["http"].get("content-length", "")
        return bare("warc-record-id"), "revisit", bare("warc-target-uri"), bare("warc-refers-to"), digest, int(told) if told.isdigit() else None, None, None
    return bare("warc-record-id"), fields["warc-type"], bare("warc-target-uri"), bare("warc-refers-to"), digest, len(payload), payload, None if digest is None else digest == digest_of(payload)


def page_of(record_id):
    """The page's key as text, from a record id."""
    return F.url_decode(F.nullif(F.substr(record_id, F.lit(len(PREFIX) + 1)), F.lit("")))


def archive_pages(pages: DataFrame, key: str = "page_id", least_bytes: int = 0, split_bytes: int = 64 << 20) -> DataFrame:
    """Every page through archives and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and ``intact``.

    Digest and size of a response are taken from the payload read back (``payload_digest`` is null where it differs from
    the record's), those of a revisit from its record. ``refers_to`` is the response's page for revisits, else null. Null html
    is an empty payload; a null page is kept, and is a response only if no other page has its payload; repeated rows are kept.
    An empty table gives an empty one.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, shared_path(spark, "warc"), key, least_bytes)
    kind = pages.schema[key].dataType
    out = read_archives(spark, archives, split_bytes).where("record_type in ('response', 'revisit')")
    return out.select(
        page_of(F.col("record_id")).cast(kind).alias(key), "payload_bytes", F.when(F.coalesce("intact", F.lit(True)), F.col("payload_digest")).alias("payload_digest"), "record_type",
        page_of(F.col("refers_to")).cast(kind).alias("refers_to"), "intact",
    )
