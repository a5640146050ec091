"""WARC archives of pages: written with an index first, read back by coalesced byte ranges.

Every record is a gzip member of its own, so any byte range that starts and ends at records can be read
alone. The index has file, offset, length, URL and digest per record. To read a selection, its index rows
are dealt out in order of file and offset, neighbours within a gap become one read, and each read is cut
into its records. Files are opened through Arrow's file systems, so the folder can be local, S3, GCS or HDFS.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, text_bytes

#: Payloads below this many bytes are stored each time.
SHORTEST_SHARED = 1000
#: A file is closed once it is this large; ranges up to this gap apart are read at once, up to this many bytes.
FILE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of records that one task reads back.
TASK_BYTES = 128 << 20
_EOL = b"\r\n"
INDEX = "file string, offset bigint, length bigint, url string, digest string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One record: its header, an HTTP header and, unless it revisits another record, the payload."""
    http = _EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
        b"WARC-Record-ID: <urn:uuid:%s>" % _record_uuid(page_id, digest).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if refers_to is not None:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To: <urn:uuid:%s>" % _record_uuid(refers_to, digest).encode())
        head.append(b"X-Refers-To-Page-Id: %d" % refers_to)
    return _EOL.join(head) + _EOL + _EOL + block + _EOL + _EOL


def _record_uuid(page_id: int | None, digest: bytes) -> str:
    return str(uuid.UUID(bytes=hashlib.sha1(b"%s %s" % (str(page_id).encode(), digest)).digest()[:16], version=5))


def _fields(lines: list[bytes]) -> dict[bytes, bytes]:
    return {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines)}


def parse_record(raw: bytes) -> dict:
    """The fields of ``RECORD`` of one unpacked record; a response's digest and size are those of its own bytes."""
    head, _, rest = raw.partition(_EOL * 2)
    lines = head.split(_EOL)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    got = _fields(lines[1:])
    block = rest[: int(got[b"content-length"])]
    http, _, payload = block.partition(_EOL * 2)
    revisit = got[b"warc-type"] == b"revisit"
    number = lambda key: int(got[key]) if key in got else None
    return {
        "page_id": number(b"x-page-id"),
        "url": got[b"warc-target-uri"].decode(),
        "record_type": got[b"warc-type"].decode(),
        "refers_to": number(b"x-refers-to-page-id"),
        "payload_bytes": int(_fields(http.split(_EOL)[1:])[b"content-length"]) if revisit else len(payload),
        "payload_digest": base64.b32decode(got[b"warc-payload-digest"].removeprefix(b"sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages whose payload another page's record holds.

    Only ids, digests and sizes are gathered: the largest id per digest by partial sums, joined back to them.
    """
    raw = text_bytes(html_col)
    known = pages.select(F.col(id_col).alias("page_id"), F.unhex(F.sha1(raw)).alias("digest"), F.octet_length(raw).alias("size"))
    known = materialize(known.where(f"size >= {SHORTEST_SHARED} and page_id is not null").select("page_id", "digest"), "digests")
    first = materialize(known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-pages")
    return known.join(first, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of ``pages`` to ``*.warc.gz`` files in ``folder``; returns the index.

    A null html counts as empty, a null URL as an empty one; a row with a null id is a response. Rows that
    repeat the chosen id and payload are all responses. Every attempt of a task writes files of its own and
    only those of the attempt that Spark accepts are in the index, so lost executors do no harm.
    """
    known = materialize(revisits(pages, id_col, html_col), "revisits")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).join(known, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                digest = digest.as_py()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), digest, refers_to.as_py())) + packer.flush()
                out.write(member)
                index.append((name, at, len(member), url.as_py(), digest.hex()))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                file, offset, length, url, digest = zip(*index)
                yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(url, pa.string()), pa.array(digest)], names=["file", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return materialize(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "index")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted ``(file, offset, length)`` as reads ``(file, from, to, [(offset, length)])``.

    A range joins the read before it if it starts within ``gap`` bytes of its end and the read stays within
    ``most`` bytes; a range repeated is read once and listed as often as it came.
    """
    file, low, high, parts = None, 0, 0, []
    for name, offset, length in ranges:
        if parts and name == file and offset <= high + gap and offset + length - low <= most:
            high = max(high, offset + length)
            parts.append((offset, length))
            continue
        if parts:
            yield file, low, high, parts
        file, low, high, parts = name, offset, offset + length, [(offset, length)]
    if parts:
        yield file, low, high, parts


def read_tasks(index: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for the records of an index: by their summed lengths, at least one a core, at most one a record."""
    count, total = index.agg(F.count(F.lit(1)), F.sum("length")).first()
    return max(1, min(count, max(index.sparkSession.sparkContext.defaultParallelism, math.ceil((total or 0) / task_bytes))))


def read_records(index: DataFrame, folder: str, with_payload: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records (``RECORD``) of the given index rows, in any order; rows of an empty index give none.

    The rows are range-partitioned by file and offset, so each task reads stretches of few files in order. The
    number of tasks follows the bytes of the records, as the index itself is too small to tell.
    """
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.strip().split(" ")[1]] for x in schema.split(",")]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source = None, None
        for file, low, high, parts in coalesced(ranges(batches)):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, store.open_input_file(f"{root}/{file}")
            source.seek(low)
            data = source.read(high - low)
            found = [parse_record(zlib.decompress(data[offset - low : offset - low + length], 31)) for offset, length in parts]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types)], names=names)
        if source is not None:
            source.close()

    spans = index.select("file", "offset", "length").repartitionByRange(read_tasks(index, task_bytes), "file", "offset").sortWithinPartitions("file", "offset")
    return spans.mapInArrow(run, schema)


def select(index: DataFrame, urls: DataFrame | None = None, digests: DataFrame | None = None) -> DataFrame:
    """Index rows of the URLs (column ``url``) or payload digests (column ``digest``) in a given table."""
    if urls is not None:
        index = index.join(urls.select("url").distinct(), "url", "left_semi")
    if digests is not None:
        index = index.join(digests.select("digest").distinct(), "digest", "left_semi")
    return index


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every page in a new shared folder and return all records as read back, without payloads."""
    folder = new_path(pages.sparkSession, "archives")
    return read_records(write_archives(pages, folder, id_col, url_col, html_col), folder, with_payload=False)
