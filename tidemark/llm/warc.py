"""WARC: write archives as one gzip stream per file, then normalise them to a member per record with a sidecar index.

``write_archives`` writes each partition of pages as one monolithic gzip stream. ``normalise`` inflates every such file
once, from start to end, and rewrites each record as a gzip member of its own; beside the new file goes an index of offsets.
``read_archives`` reads single records by that index. All files are streamed: a task holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FileWriter, file_system, materialize, work_dir

#: Payloads below so many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Record date; a parameter of the run, not of the page.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")

FILES = "path string, records long, bytes long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record: a response with an HTTP block, or a revisit with only the HTTP header."""
    block = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if is_revisit else payload)
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(("WARC-Target-URI", shown))
        if shown != url:
            head.append(("X-Target-URI", quote(url, safe="")))  # as it was given
    if is_revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to, is_revisit. Only digests and ids are grouped, with map-side combining."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first_id is not null").select(F.col("digest").alias("first_digest"), "first_id")
    )
    joined = rows.join(first, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``with_revisits`` as monolithic files; path, records, bytes of each."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, gz, n = f"{folder}/raw-{TaskContext.get().partitionId():06d}.warc.gz", None, None, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "is_revisit"))):
                if out is None:
                    out, gz = FileWriter(path), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(record(*row)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.__exit__(None)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([out.size])], schema=schema)

    return materialize(pages.mapInArrow(write, FILES), "warc-files")


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file, inflated once as one stream; members, if there are several, are read on."""
    inflate, buffer, need = zlib.decompressobj(31), bytearray(), None
    while True:
        data = stream.read(chunk)
        if not data:
            break
        while data:
            buffer += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof and data:
                inflate = zlib.decompressobj(31)
        at = 0
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = bytes(buffer[at:end]).split(b"\r\n")
                need = end + 4 - at + 4 + next(int(f[16:]) for f in fields if f.lower().startswith(b"content-length: "))
            if len(buffer) - at < need:
                break
            yield bytes(buffer[at : at + need])
            at, need = at + need, None
        del buffer[:at]
    if buffer or not inflate.eof:
        raise ValueError("the archive ends within a record")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each file with a gzip member per record and a sidecar index (offset, length, page_id, type); path, records, bytes."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                new = f"{folder}/{path.rsplit('/', 1)[1].replace('raw-', 'part-')}"
                index: dict[str, list] = {"offset": [], "length": [], "page_id": [], "type": []}
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as stream, FileWriter(new) as out:
                    for data in records_of(stream):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        fields, start = parse_record(data)[0], out.size
                        out.write(gz.compress(data) + gz.flush())
                        page = fields.get("X-Page-Id")
                        for k, v in (("offset", start), ("length", out.size - start), ("page_id", None if page is None else int(page)), ("type", fields["WARC-Type"])):
                            index[k].append(v)
                table = pa.table(index, schema=pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("type", pa.string())]))
                side = pa.BufferOutputStream()
                pq.write_table(table, side)
                with FileWriter(f"{new}.index") as beside:
                    beside.write(side.getvalue().to_pybytes())
                yield pd.DataFrame({"path": [new], "records": [table.num_rows], "bytes": [out.size]})

    return materialize(_spread(files).mapInPandas(rewrite, FILES), "warc-normalised")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record, read as a member of its own by the sidecar index.

    page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to. A payload whose digest
    differs from its header is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_file(f"{at}.index") as side:
                    index = pq.read_table(side)
                rows: list[list] = [[] for _ in schema]
                held = 0
                with fs.open_input_file(at) as f:
                    for offset, length in zip(index["offset"].to_pylist(), index["length"].to_pylist()):
                        f.seek(offset)
                        fields, block = parse_record(zlib.decompress(f.read(length), 31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {path} at {offset}")
                        whole = lambda k: int(fields[k]) if k in fields else None
                        size = whole("X-Payload-Length") if payload is None else len(payload)
                        for to, v in zip(rows, (whole("X-Page-Id"), unquote(fields["X-Target-URI"]) if "X-Target-URI" in fields else fields.get("WARC-Target-URI"), fields["WARC-Type"], payload, size, digest, whole("X-Refers-To-Page-Id"))):
                            to.append(v)
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, schema.types)], schema=schema)
                            rows, held = [[] for _ in schema], 0
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, schema.types)], schema=schema)

    return _spread(files).mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def _spread(files: DataFrame) -> DataFrame:
    """The rows of a list of files over as many tasks as Spark uses after a shuffle."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def archive_pages(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html), normalise the archives and read them back (see ``read_archives``).

    A null html is an empty payload. Of equal payloads of at least ``least`` bytes, rows with the smallest page_id are
    responses, also if several rows share that id; the others revisit it. A row with a null page_id revisits like any other;
    if no row of a payload has an id, all are responses. An empty table gives an empty table; other columns are left."""
    folder = work_dir(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(with_revisits(pages, least), f"{folder}/raw"), f"{folder}/records"))
