"""WARC archives with a two-level capture index.

``write_archives`` writes gzip-per-record WARC 1.1 files: one record for each
page, a ``response`` for the page with the largest id among equal payloads, and
``revisit`` records for the others.  ``build_index`` sorts the captures by
reversed-host URL key into compressed blocks and keeps a sparse directory of
the blocks.  ``lookup`` searches the directory and the block by bisection and
reads only the byte range of the block and of the record.

Defined results.  A null html is an empty payload.  A null url is archived
under the empty URL key.  A null page id sorts before all others and a payload
whose pages all have null ids gets no revisits.  Repeated rows are archived one
record each; every lookup key returns all its captures.  An empty table gives
an empty index and an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch

#: Index lines of one compressed block.
BLOCK_LINES = 3000
#: A new archive file is begun once one holds so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Date of all records: pages carry none, and archives stay reproducible.
WARC_DATE = "1970-01-01T00:00:00Z"

_CAPTURES = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
_PARTS = T.StructType(
    [
        T.StructField("first_key", T.StringType()),
        T.StructField("directory", T.StringType()),
        T.StructField("lines", T.LongType()),
        T.StructField("blocks", T.LongType()),
    ]
)
_RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("key", T.StringType()),
    ]
)


@dataclass(frozen=True)
class CaptureIndex:
    """Boundaries of the index parts: one entry for each sorted part."""

    first_keys: list[str]
    directories: list[str]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _read_range(uri: str, start: int, length: int) -> bytes:
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def record_urn(page_id: int | None) -> str:
    """A version-8 UUID that carries the page id."""
    value = (page_id or 0) & 0xFFFFFFFFFFFFFFFF
    bits = (0x70616765 if page_id is not None else 0x6E756C6C) << 96
    bits |= (value >> 48) << 80 | 0x8 << 76 | ((value >> 36) & 0xFFF) << 64
    bits |= 0x2 << 62 | (value & 0xFFFFFFFFF)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def urn_page_id(urn: str) -> int | None:
    bits = uuid.UUID(urn.strip("<>")[9:]).int
    if bits >> 96 == 0x6E756C6C:
        return None
    value = ((bits >> 80) & 0xFFFF) << 48 | ((bits >> 64) & 0xFFF) << 36 | (bits & 0xFFFFFFFFF)
    return value - (1 << 64) if value >> 63 else value


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example)/a?b``."""
    clean = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|")
    try:
        parts = urlsplit(clean)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f"){clean}"
    if not host:
        return f"){clean}"
    labels = ",".join(reversed(host.split(".")))
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{labels}{f':{port}' if port else ''}){rest}"


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key, a space, and the page id as sortable digits."""
    digits = "-" * 20 if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{url_key(url)} {digits}"


def _record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head if revisit else head + body
    target = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warcinfo(name: str) -> bytes:
    block = "format: WARC File Format 1.1\r\n"
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {WARC_DATE}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n").encode()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The attempt's number keeps the files of repeated tasks apart; only
        # rows of the attempt that Spark commits name its file.
        task = TaskContext.get()
        stem = f"{root}/pages-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, place, files = None, 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "target")), strict=True):
                if out is None or place >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{stem}-{files}.warc.gz"
                    store, path = _open(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, place, files = store.open_output_stream(path, compression=None), 0, files + 1
                    blob = gzip.compress(_warcinfo(name), 6, mtime=0)
                    out.write(blob)
                    place += len(blob)
                body = (html or "").encode("utf-8", "surrogatepass")
                revisit = target is not None and target != page_id
                blob = gzip.compress(_record(page_id, url, body, target, revisit), 6, mtime=0)
                out.write(blob)
                rows.append((capture_key(url, page_id), name, place, len(blob)))
                place += len(blob)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=_CAPTURES.names)
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, work: Scratch, min_bytes: int = 0) -> DataFrame:
    """Write all pages; return the captures (key, archive, start, length).

    Pages whose payload, of at least ``min_bytes``, equals that of another are
    revisits of the one with the largest id.  Digests are grouped with partial
    aggregation, and the table of repeated ones is read from disk so that a
    payload that many pages share is split over tasks as a skewed join.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"),
    )
    repeated = (
        pages.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("target").isNotNull())
        .select("digest", "target")
    )
    repeated = work.save(repeated, "repeated")
    rows = pages.join(repeated, "digest", "left").select("page_id", "url", "html", "target")
    return work.save(rows.mapInArrow(_writer(work.path("archives")), _CAPTURES), "captures")


def _index_writer(root: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, place, lines, first, entries, block = None, 0, 0, "", [], []

        def flush() -> None:
            nonlocal place, out
            if out is None:
                store, path = _open(f"{stem}.cdx.gz")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            blob = gzip.compress("\n".join(block).encode(), 6, mtime=0)
            out.write(blob)
            entries.append(f"{block[0].split('\t', 1)[0]}\t{place}\t{len(blob)}")
            place += len(blob)
            block.clear()

        for batch in batches:
            for key, archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, lines = first or key, lines + 1
                block.append(f"{key}\t{archive}\t{start}\t{length}")
                if len(block) == block_lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
            store, path = _open(f"{stem}.dir")
            with store.open_output_stream(path, compression=None) as f:
                f.write("\n".join(entries).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, f"{stem}.dir", lines, len(entries))], names=_PARTS.names)

    return write


def build_index(captures: DataFrame, work: Scratch, parts: int | None = None, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures into ``parts`` ranges of compressed blocks.

    The driver gets one entry for each part, at most ``parts``; block entries
    stay in a directory file beside each part.
    """
    parts = parts or int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    made = work.save(ranged.mapInArrow(_index_writer(work.path("index"), block_lines), _PARTS), "parts")
    rows = sorted((r.first_key, r.directory) for r in made.select("first_key", "directory").collect())
    return CaptureIndex([r[0] for r in rows], [r[1] for r in rows])


class _Part:
    """One part of the index: its directory, and the last block read."""

    def __init__(self, directory: str):
        store, path = _open(directory)
        with store.open_input_file(path) as f:
            entries = [x.split("\t") for x in f.read().decode().split("\n")]
        self.firsts = [e[0] for e in entries]
        self.places = [(int(e[1]), int(e[2])) for e in entries]
        self.blocks = directory.removesuffix(".dir") + ".cdx.gz"
        self.at, self.lines = -1, []

    def block(self, n: int) -> list[list[str]]:
        if n != self.at:
            data = gzip.decompress(_read_range(self.blocks, *self.places[n]))
            self.at, self.lines = n, [x.split("\t") for x in data.decode().split("\n")]
        return self.lines

    def find(self, key: str) -> Iterator[list[str]]:
        n = max(0, bisect.bisect_left(self.firsts, key) - 1)
        for n in range(n, len(self.firsts)):
            if self.firsts[n] > key:
                return
            lines = self.block(n)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1


def _reader(index: CaptureIndex, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, handles = None, None, {}
        for batch in batches:
            rows = []
            for key, want in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if want != number:
                    part, number = _Part(index.directories[want]), want
                for _, archive, start, length in part.find(key):
                    if archive not in handles:
                        while len(handles) >= 64:
                            handles.pop(next(iter(handles))).close()
                        store, path = _open(archive)
                        handles[archive] = store.open_input_file(path)
                    handles[archive].seek(int(start))
                    data = zlib.decompress(handles[archive].read(int(length)), 31)
                    fields, http, body = parse_record(data)
                    refers, digest, size = fields.get("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if not refers and (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) != (size, digest):
                        raise ValueError(f"the payload of {key} in {archive} at {start} is not that of its header")
                    rows.append(
                        (
                            urn_page_id(fields["WARC-Record-ID"]),
                            fields["WARC-Target-URI"],
                            fields["WARC-Type"],
                            size,
                            digest,
                            urn_page_id(refers) if refers else None,
                            body if with_payload else None,
                            key,
                        )
                    )
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=_RECORDS.names)
        for handle in handles.values():
            handle.close()

    return read


@F.pandas_udf(T.StringType())
def _capture_key(url: pd.Series, page_id: pd.Series) -> pd.Series:
    return pd.Series([capture_key(u, None if p is None else int(p)) for u, p in zip(url, page_id, strict=True)])


def lookup(wanted: DataFrame, index: CaptureIndex, with_payload: bool = False) -> DataFrame:
    """Records archived for each distinct (url, page_id) of ``wanted``.

    Keys are dealt to the index part that can hold them and sorted, so each
    task bisects one directory at a time and reads every block once.  There are
    as many partitions as parts of the index: the keys are few bytes, but the
    reads that they stand for are not.
    """
    spark = wanted.sparkSession
    if not index.first_keys:
        return spark.createDataFrame([], _RECORDS)
    firsts = spark.sparkContext.broadcast(index.first_keys)

    @F.pandas_udf(T.IntegerType())
    def part_of(keys):
        return keys.map(lambda k: max(0, bisect.bisect_right(firsts.value, k) - 1)).astype("int32")

    keys = wanted.select(_capture_key("url", F.col("page_id").cast("string")).alias("key")).distinct()
    dealt = keys.withColumn("part", part_of("key")).repartition(len(index.directories), "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_reader(index, with_payload), _RECORDS)


def archive_and_read(pages: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Archive all pages, index the archives, and read every record back."""
    work = Scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, work, min_bytes)
    index = build_index(captures, work)
    work.drop("repeated")
    return lookup(pages, index, with_payload)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive_and_read(pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h,
         max(page_id) OVER (PARTITION BY sha1(body)) AS target FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(unhex(h)::BIT::VARCHAR, (5 * i + 1)::INT, 5)::BIT::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to
FROM d
"""
