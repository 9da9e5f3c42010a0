"""WARC archives: writing pages as records, and reading records back one after the other.

Each record is a gzip member of its own. The reader inflates a stream in small steps, frames a record by its
Content-Length and checks both digests, so it holds one record at a time however large the archive is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, removed, shared_dir, spread_join

#: A task begins another archive beyond this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "urn:x-page:"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit, with the header of the response alone, if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, base32_sha1(payload))}"
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{PAGE}{refers_to}>"}
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def inflate(read: Callable[[int], bytes]) -> Iterator[Callable[[int], bytes]]:
    """For each gzip member of a stream a function that gives its next n bytes (fewer only at its end)."""
    rest = read(STEP)
    while rest:
        engine, ready = zlib.decompressobj(31), bytearray()

        def take(n: int) -> bytes:
            nonlocal rest
            while len(ready) < n and not engine.eof:
                rest = rest or read(STEP)
                if not rest:
                    raise ValueError("the archive ends inside a gzip member")
                try:
                    ready.extend(engine.decompress(rest, STEP))
                except zlib.error as error:
                    raise ValueError(f"the archive holds what is no gzip member: {error}") from error
                rest = engine.unused_data if engine.eof else engine.unconsumed_tail
            out = bytes(ready[:n])
            del ready[:n]
            return out

        yield take
        while take(STEP):  # what a caller has left
            pass
        rest = rest or read(STEP)


def records(read: Callable[[int], bytes]) -> Iterator[Record]:
    """The records of a stream of gzip members, one record each; ValueError where framing or a digest is wrong."""
    for take in inflate(read):
        read_, end = bytearray(), -1
        while end < 0:
            more = take(1024)
            if not more:
                raise ValueError("a record's header has no end")
            read_ += more
            end = read_.find(b"\r\n\r\n", max(0, len(read_) - len(more) - 3))
        head, begun = bytes(read_[:end]), bytes(read_[end + 4 :])
        version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        body = begun + take(max(0, length + 4 - len(begun)))
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n" or take(1):
            raise ValueError(f"record {headers.get('warc-record-id')} does not end where its Content-Length says")
        block = body[:length]
        if (said := headers.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"record {headers.get('warc-record-id')} has another block digest")
        if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")):
            if said != f"sha1:{base32_sha1(block.partition(b'\r\n\r\n')[2])}":
                raise ValueError(f"record {headers.get('warc-record-id')} has another payload digest")
        yield Record(headers, block)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload if that is another page.

    Payloads under min_bytes never refer. A null html counts as empty. Rows that equal the first page in page_id are
    responses as well; a null page_id refers to the smallest one there is, and to none if there is none.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1(F.encode("html", "UTF-8")))
    firsts = rows.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = spread_join(rows, firsts.where("n > 1").drop("n"), "key", "left", salt=["page_id"])
    return joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives under folder; returns their path, records and bytes.

    folder is a URI that pyarrow.fs opens on every executor. A name holds the attempt, and only archives of attempts that
    ended are listed, so a task that runs twice does no harm.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        made, file, size, n = [], None, 0, 0
        for batch in chunks(batches, "html"):
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file is None:
                    path = f"{name}-{len(made)}.warc.gz"
                    file, size, n = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                member = page_record(page_id, url, html.encode(), refers_to, date)
                file.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    file.close()
                    made, file = [*made, (f"{folder}/{path}", n, size)], None
        if file is not None:
            file.close()
            made.append((f"{folder}/{path}", n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["path", "records", "bytes"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return cut(with_revisits(pages, min_bytes).mapInArrow(kernel, "path string, records long, bytes long"))


RECORD = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def parsed(record: Record, payload: bool) -> tuple:
    headers = record.headers
    http, _, body = record.block.partition(b"\r\n\r\n")
    said = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(body))
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = headers.get("warc-type")
    size = said if kind == "revisit" else len(body)
    return headers.get("warc-record-id", "").strip("<>"), kind, headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, headers.get("warc-refers-to", "").strip("<>") or None, body if payload and kind == "response" else None


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in column path, each archive streamed by one task: a row per record, as in RECORD.

    payload_bytes and payload_digest are those of the full payload, for revisits too. payload=False leaves payloads out.
    """
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(base, compression=None) as file:
                    for record in records(file.read):
                        rows.append(parsed(record, payload))
                        held += len(record.block) if payload else 500
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path").mapInArrow(kernel, RECORD)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all *.warc.gz under a path that Spark lists."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", True).load(path)
    return read_archives(files.select("path").repartition(spark.sparkContext.defaultParallelism), payload)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Pages written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    Repeated rows are records of their own; an empty table gives an empty result; columns other than page_id, url and
    html are not looked at. Archives in a folder that is given stay; those in a folder of our own are deleted once read.
    """
    own = folder is None
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = read_archives(write(pages, folder, min_bytes), payload=False)

    def number(c: str) -> Column:
        return F.when(F.startswith(F.col(c), F.lit(PAGE)), F.substring(c, len(PAGE) + 1, 99).cast("long"))

    out = rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    if own:
        out = cut(out)
        removed(pages.sparkSession, folder)
    return out


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (hex)
"""
