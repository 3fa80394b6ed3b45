"""WARC archives compressed with Zstandard: writer and reader.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself a Zstandard frame if compressed; then one frame a record.  The reader loads the
dictionary from the leading skippable frame, decodes one frame at a time, and validates
each record: version line, mandatory headers, block length, record end, and for responses
the payload's length and SHA-1 digest.  It holds one record in memory, never an archive.

The writer makes archives of at most about ``archive_bytes`` each in the folder that the
cluster shares, names them by a fresh random name, and lists what it finished in a manifest
table; archives of failed or repeated attempts are in no manifest, so they are never read.
The folder must be one that pyarrow's file systems can open.

Records with equal payloads: those with the smallest id are responses; the others become
revisits that name it.  Digests are computed by Spark; groups of equal payloads are
aggregated before they are joined, and only their digest and first id are broadcast, when
counted to be under ``max_groups``, else joined by shuffle.

Edge cases: a null payload is empty; payloads of fewer than ``least`` bytes are always
responses; rows that repeat both id and payload are alike (responses if theirs is the
smallest id, else revisits); a null id counts as larger than any, and is told from the text
"null"; a null url is left out, control characters in a url are percent-encoded, and so are
all but letters, digits and a few marks in an id; very long payloads are one record each; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import text as tx

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class Invalid(ValueError):
    """A record or archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    """Without spaces and control characters, which would break the header."""
    return "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def _name(page) -> str:
    """An id as a part of a URN; null is the empty one, and text never is."""
    return "" if page is None else f"{type(page).__name__[0]}:{quote(str(page), safe='')}"


def record(page: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record.  A revisit carries the HTTP head (with the full length), not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Invalid("no WARC version line and header end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Invalid(f"header without a name: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [h for h in MANDATORY if h.lower() not in headers]:
        raise Invalid(f"missing {missing}")
    if not headers["content-length"].isdigit() or (length := int(headers["content-length"])) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise Invalid("the block is not as long as Content-Length says")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    size = fields.get(b"content-length", b"")
    if not found or not size.isdigit():
        raise Invalid("the HTTP head has no length")
    out = {"type": headers["warc-type"], "id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "bytes": int(size), "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload}
    if out["type"] == "response":
        if len(payload) != out["bytes"] or digest(payload) != out["digest"]:
            raise Invalid("the payload does not match its length or digest")
    elif out["type"] != "revisit" or payload or not out["refers_to"] or len(out["digest"]) != 32:
        raise Invalid("neither a response nor a revisit that names its original")
    return out


class Writer:
    """One archive into a binary file object."""

    def __init__(self, to, dictionary: bytes, level: int = 3):
        self.to, self.size = to, 0
        body = zstandard.ZstdCompressor(level=3).compress(dictionary)
        self._put(struct.pack("<II", DICT_MAGIC, len(body)) + body)
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)

    def _put(self, data: bytes) -> None:
        self.to.write(data)
        self.size += len(data)

    def add(self, raw: bytes) -> None:
        self._put(self.codec.compress(raw))


class _Tail:
    """A stream that gives back what a decoder did not use."""

    def __init__(self, source):
        self.source, self.kept = source, b""

    def read(self, n: int) -> bytes:
        while len(self.kept) < n and (more := self.source.read(max(n, 1 << 16))):
            self.kept += more
        out, self.kept = self.kept[:n], self.kept[n:]
        return out

    def some(self) -> bytes:
        if self.kept:
            out, self.kept = self.kept, b""
            return out
        return self.source.read(1 << 16)


def read(source, max_record: int = 1 << 30) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time."""
    stream, codec = _Tail(source), zstandard.ZstdDecompressor()
    start = stream.read(8)
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", start[4:])[0]
        body = stream.read(size)
        if len(body) != size:
            raise Invalid("the dictionary frame is cut off")
        if body[:4] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=max_record)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    else:
        stream.kept = start + stream.kept
    while data := stream.some():
        frame, parts, total = codec.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(data))
            total += len(parts[-1])
            if total > max_record:
                raise Invalid("a record is larger than max_record")
            if frame.eof:
                stream.kept = frame.unused_data + stream.kept
                break
            if not (data := stream.some()):
                raise Invalid("the last frame is cut off")
        yield b"".join(parts)


def train_dictionary(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary of record beginnings; none where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = 64 << 20, max_groups: int = 500_000, sample_rows: int = 400) -> DataFrame:
    """Writes one record a row; returns the manifest (path, records), written to the shared
    folder so that the archives are written once."""
    spark = pages.sparkSession
    store.doomed(spark, folder)
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("_body"))
    rows = rows.withColumn("_digest", F.sha1("_body"))
    groups = rows.where(F.length("_body") >= least).groupBy(F.col("_digest").alias("_d")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_d", "_first")
    groups = store.keep(groups, "groups")
    few = groups.count() <= max_groups
    rows = rows.join(F.broadcast(groups) if few else groups, (F.col("_digest") == F.col("_d")) & (F.length("_body") >= least), "left")
    rows = rows.select("_id", "_url", "_body", F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_to"))
    sample = [bytes(r[0]) for r in pages.select(F.substring(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), 1, 4000).cast("binary")).limit(sample_rows).collect()]
    dictionary = spark.sparkContext.broadcast(train_dictionary([record("0", "http://", x) for x in sample]))

    def run(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, to, writer, count = "", None, None, 0
        for batch in batches:
            rows = (row for lo, hi in tx.slices(batch.column(2), 4 << 20) for row in zip(*(c.to_pylist() for c in batch.slice(lo, hi - lo).columns), strict=True))
            for page, url, body, first in rows:
                if writer is None:
                    name, count = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                    to = fs.open_output_stream(name, compression=None)
                    writer = Writer(to, dictionary.value)
                writer.add(record(_name(page), url, body, None if first is None else _name(first)))
                count += 1
                if writer.size >= archive_bytes:
                    to.close()
                    writer = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [count]})
        if writer is not None:
            to.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count]})

    return store.keep(rows.mapInArrow(run, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(record_id, url, type, refers_to, payload_bytes, payload_digest, payload) of each
    record of the archives listed; a broken archive or record fails the query."""

    def run(batches):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, held, size = 0, [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read(source):
                        held.append(parse(raw))
                        seen += 1
                        size += len(raw)
                        if size >= 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                if seen != records:
                    raise Invalid(f"{path} has {seen} records, not {records}")
                yield _batch(held)

    n = max(1, manifest.count())
    return manifest.repartition(min(n, 10_000)).mapInArrow(run, "record_id string, url string, type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def _batch(held: list[dict]) -> pa.RecordBatch:
    col = lambda k, t: pa.array([r[k] for r in held], t)
    return pa.RecordBatch.from_arrays([col("id", pa.string()), col("url", pa.string()), col("type", pa.string()), col("refers_to", pa.string()), col("bytes", pa.int64()), col("digest", pa.string()), col("payload", pa.binary())], names=["record_id", "url", "type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def page_of(record_id: str):
    """The page's id in a record's, as text; null if there is none."""
    return F.when(F.col(record_id).rlike("^<urn:page:[a-z]:"), F.url_decode(F.regexp_extract(record_id, "^<urn:page:[a-z]:(.*)>$", 1)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.table(spark, sf_dir, "pages")
    folder = f"{store.shared_folder(spark)}/driftplane-{uuid.uuid4().hex}/archives"
    found = read_archives(write_archives(pages, folder), folder)
    page = lambda c: page_of(c).try_cast(pages.schema["page_id"].dataType)
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


#: op10 in SQL: base 32 takes twenty bits of the digest at a time.
ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || hex[5 * i + 1 : 5 * i + 5] AS BIGINT)) AS parts FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((parts[j // 4 + 1] >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def brute(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """What op10 gives, by a dictionary; for tests."""
    first: dict[bytes, int] = {}
    for page, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, page), page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        same = first[body] == page
        out.append((page, len(body), digest(body), "response" if same else "revisit", None if same else first[body]))
    return out


def loads(data: bytes) -> list[dict]:
    return [parse(x) for x in read(io.BytesIO(data))]
