"""WARC archives with dictionary-compressed records (.warc.zst).

Every archive starts with a skippable Zstandard frame that holds a dictionary built from the archive's own
records; each record follows as a frame of its own. Of records with equal payloads the one with the smallest
page id is written as `response`, the others as `revisit` records that refer to it and carry no payload.

A task writes its records as they stream by, holding only the dictionary's sample. Archives are named by a
fresh id and listed in a manifest table; a retried task writes new files, and only files that the manifest
lists are read, so lost executors leave no half or double records.

Defined cases: null html is an empty payload; a null url is written as `about:blank` and null ids as `null`;
rows that share the smallest page id of their payload are all responses; payloads under `min_revisit` bytes
are never revisits; an empty table makes no archives; extra columns are ignored; a page of any length is one
record, which is held whole while it is written and read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive's first records that its dictionary is built from, and the dictionary's size.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10

MANIFEST = "path string, records long, raw_bytes long, archive_bytes long"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def classified(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with payload_digest, payload_bytes, record_type and refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = own.where(F.col("payload_bytes") >= min_revisit).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = own.join(first, own["payload_digest"] == F.col("digest"), "left")
    again = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(again, F.lit("")).otherwise(F.col("html")).alias("html"), "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def record(page_id, url, html: bytes, digest: str, size: int, kind: str, refers_to, date: str) -> bytes:
    """One WARC record: the HTTP head, and the payload unless it is a revisit."""
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + html
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained from the samples; where they are too few to train from, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """An open archive: holds records until the dictionary's sample is full, then streams."""

    def __init__(self, folder: str, level: int):
        self.uri, self.level = f"{folder}/{uuid.uuid4().hex}.warc.zst", level
        self.held: list[bytes] = []
        self.out, self.compressor = None, None
        self.records = self.raw = self.size = 0

    def _start(self) -> None:
        where, path = fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(path, compression=None)
        d = dictionary(self.held)
        d.precompute_compress(level=self.level)
        data = d.as_bytes()
        self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=True, write_checksum=True)
        for x in self.held:
            self._put(self.compressor.compress(x))
        self.held = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self.records += 1
        self.raw += len(data)
        if self.compressor:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        if self.raw >= SAMPLE_BYTES:
            self._start()

    def close(self) -> tuple:
        if not self.compressor:
            self._start()
        self.out.close()
        return self.uri, self.records, self.raw, self.size


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes the classified pages under folder; returns the manifest, one row per archive."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, done = None, []
        for b in batches:
            for row in zip(b.page_id, b.url, b.html, b.payload_digest, b.payload_bytes, b.record_type, b.refers_to, strict=True):
                archive = archive or Archive(folder, level)
                archive.add(record(row[0], row[1], row[2].encode("utf-8"), *row[3:], date))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["path", "records", "raw_bytes", "archive_bytes"])

    text = pages.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("page_id", "refers_to")})
    return written(text.mapInPandas(write, MANIFEST), "warc-manifest")


def frames(stream, size: int = 64 << 10) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    data = stream.read(8)
    d = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE_MAGIC:
        content = stream.read(struct.unpack("<I", data[4:])[0])
        if content[:4] == b"\x28\xb5\x2f\xfd":
            content = zstandard.ZstdDecompressor().decompress(content)
        trained = content[:4] == struct.pack("<I", DICTIONARY_MAGIC)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        data = b""
    reader = zstandard.ZstdDecompressor(dict_data=d)
    data += stream.read(size)
    while data:
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data or stream.read(size)
                break
            if not (data := stream.read(size)):
                raise EOFError("the archive ends within a record")
        yield b"".join(parts)


def parsed(data: bytes) -> tuple:
    """The fields of RECORDS; raises if a payload doesn't match its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    own = lambda x: re.fullmatch(r"<urn:x-page:(.*)>", x)[1]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    else:
        payload = None
    refers = fields.get("WARC-Refers-To")
    return own(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"], refers and own(refers), digest, size, payload


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record (RECORDS) of the archives that the manifest lists; payloads of revisits are null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            for uri in b.path:
                where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
                rows, held = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        row = parsed(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(data) if payloads else 200
                        if held >= 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    # a number, so that the archives aren't merged into one task for their names' few bytes
    return manifest.select("path").repartition(max(1, manifest.count())).mapInPandas(read, RECORDS)


def op3_warc(spark, sf_dir):
    pages = classified(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = read_archives(write_archives(pages, new_path(spark, "warc")), payloads=False)
    number = lambda c: F.when(F.col(c) != "null", F.col(c).cast("long"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
