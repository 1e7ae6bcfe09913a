"""WARC archives: writing captures, reading records, and assembling transactions.

``write`` stores three records for each page: a request and a metadata record, both concurrent to a
response, or to a revisit where an earlier page has the same payload. Each record is a gzip member of its
own; archives roll at ROLL bytes. Which pages revisit is decided on digests alone, and that table is
joined to the pages (the planner broadcasts it only if it is below its size threshold).

``read`` parses archives once, and ``assemble`` joins request, response and metadata records through their
concurrent-to identifiers into one nested row per capture: all records of a capture meet by the identifier
of its response or revisit, of which a task holds one record of each kind. A revisit is resolved by its
payload digest, as its profile says.

Archives go to the shared folder. A task that is run again writes files under new names, and only the
files in the manifest of the tasks that counted are read.

Cases: null and empty payloads are empty and equal; long ones are written whole, and one record may
exceed ROLL; rows that repeat the first page's id and payload are responses like it; a page with a null id
is a response only if its payload has no other page; a null url has no target; an empty table makes no
archive; further columns aren't read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ROLL = 16_000_000
#: Payloads of fewer bytes are always stored.
LEAST = 0
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {"request": "application/http;msgtype=request", "response": "application/http;msgtype=response", "revisit": "application/http;msgtype=response", "metadata": "application/warc-fields"}
#: Bytes of payload in a batch of parsed records.
BATCH = 4_000_000


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_key(html: Column) -> Column:
    return F.sha1(F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """revisit_id and revisit_key of the pages whose payload an earlier page has."""
    keyed = pages.select("page_id", payload_key(F.col("html")).alias("key"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where(F.col("size") >= least)
    first = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    later = keyed.join(first, "key").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return later.select(F.col("page_id").alias("revisit_id"), F.col("key").alias("revisit_key")).distinct()


def record(kind: str, record_id: str, body: bytes, fields: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **fields, "Content-Type": TYPES[kind], "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def capture(serial: str, page_id: int | None, url: str | None, payload: bytes, revisit: bool) -> bytes:
    """The three records of a page."""
    ids = {k: uuid.uuid5(uuid.NAMESPACE_URL, f"{serial}/{k}").urn for k in ("request", "head", "metadata")}
    target = None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 or c == "\x7f" else c for c in url)
    digest = base32_sha1(payload)
    shared = {"WARC-Target-URI": target}
    link = {"WARC-Concurrent-To": f"<{ids['head']}>"} | shared
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    told = {"WARC-Payload-Digest": f"sha1:{digest}"} | shared
    head = record("revisit", ids["head"], answer, told | {"WARC-Profile": PROFILE}) if revisit else record("response", ids["head"], answer + payload, told)
    asked = record("request", ids["request"], f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode(), link)
    notes = json.dumps({"page-id": page_id, "url": url, "payload-length": len(payload)})
    return member(asked) + member(head) + member(record("metadata", ids["metadata"], f"capture: {notes}\r\n".encode(), link))


def location(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write(pages: DataFrame, path: str, least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes archives below path and returns their manifest: archive, captures, bytes."""
    later = common.materialize(revisits(pages, least), "revisits")
    keyed = pages.select(F.col("page_id").cast("bigint"), "url", "html", payload_key(F.col("html")).alias("key"))
    same = keyed["page_id"].eqNullSafe(later["revisit_id"]) & (keyed["key"] == later["revisit_key"])
    marked = keyed.join(later, same, "left").select("page_id", "url", "html", F.col("revisit_key").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = location(path)
        store.create_dir(top, recursive=True)
        rows, out, name = [], None, ""

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                rows.append((name, count, size))
                out = None

        count = size = 0
        for batch in batches:
            for page_id, url, html, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = capture(f"{name}/{size}", page_id, url, (html or "").encode(), revisit)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    close()
        close()
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "captures", "bytes"])

    return common.materialize(marked.mapInArrow(run, "archive string, captures bigint, bytes bigint"), "manifest")


def archives(manifest: DataFrame, path: str) -> DataFrame:
    """archive and content of the files below path that the manifest has."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return named.join(manifest.select("archive").distinct(), "archive", "left_semi")


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The gzip members of an archive, each with where it starts."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts, start, step = zlib.decompressobj(31), [], at, 2048
        while not unpack.eof and at < len(data):  # what is left of the last piece is copied, so pieces start small
            piece = view[at : at + step]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
            step *= 2
        if not unpack.eof:
            raise ValueError(f"the record at {start} is cut off")
        yield start, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (in lower case) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


KINDS = {"string": (T.StringType(), pa.string()), "bigint": (T.LongType(), pa.int64()), "binary": (T.BinaryType(), pa.binary()), "boolean": (T.BooleanType(), pa.bool_())}


def fields_of(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, KINDS[k][0]) for n, k in (x.split() for x in names.split(", "))])


RECORDS = fields_of(
    "archive string, offset bigint, record_id string, record_type string, concurrent_to string, target_uri string, warc_date string, payload_digest string, http_head string, payload binary, intact boolean, block binary"
)
HEADS = ["archive", "offset", "record_id", "record_type", "target_uri", "warc_date", "payload_digest", "http_head", "payload", "intact"]
OTHERS = ["archive", "offset", "record_id", "record_type", "concurrent_to", "block"]


def read(files: DataFrame) -> DataFrame:
    """The records of archives (archive, content): responses and revisits with head and payload, others with their block."""
    kinds = [KINDS[f.dataType.simpleString()][1] for f in RECORDS]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=RECORDS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column(0)[k].as_py()
                for offset, data in members(batch.column(1)[k].as_py()):
                    fields, block = parse(data)
                    kind, record_id = fields["warc-type"], fields["warc-record-id"].strip("<>")
                    start = (archive, offset, record_id, kind, fields.get("warc-concurrent-to", "").strip("<>"), fields.get("warc-target-uri"), fields.get("warc-date"))
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        payload = payload if kind == "response" else None
                        rows.append((*start, digest, http.decode(), payload, payload is None or base32_sha1(payload) == digest, None))
                    else:
                        rows.append((*start, None, None, None, None, block))
                    size += len(block)
                    if size >= BATCH:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("archive", "content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit, with its request and metadata, as structs; of several, the first by archive and offset."""
    is_head = F.col("record_type").isin("response", "revisit")
    of = lambda kind, names: F.min(F.when(kind, F.struct(*names)))
    found = records.groupBy(F.when(is_head, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("id")).agg(
        of(is_head, HEADS).alias("response"), of(F.col("record_type") == "request", OTHERS).alias("request"), of(F.col("record_type") == "metadata", OTHERS).alias("metadata")
    )
    return found.where("response is not null").drop("id")


#: The schema of captures.
NESTED = T.StructType([
    T.StructField("response", T.StructType([RECORDS[n] for n in HEADS])), *[T.StructField(n, T.StructType([RECORDS[c] for c in OTHERS])) for n in ("request", "metadata")],
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
])
NOTES = "`page-id` bigint, url string, `payload-length` bigint"


def captures(manifest: DataFrame, path: str) -> DataFrame:
    """The assembled captures with what their metadata say, page_id, url, payload_bytes, and refers_to of revisits."""
    files = archives(manifest, path)
    notes = F.from_json(F.regexp_extract(F.col("metadata.block").cast("string"), r"(?s)^capture: (.*)\r\n$", 1), NOTES)
    rows = assemble(read(files)).withColumn("notes", notes)
    return rows.select("response", "request", "metadata", F.col("notes.page-id").alias("page_id"), "notes.url", F.col("notes.payload-length").alias("payload_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, intact, and the nested capture: request, response (without its payload) and metadata."""
    path = common.new_path(spark, "warc")
    manifest = write(common.table(spark, sf_dir, "pages"), path)
    whole = captures(manifest, path) if not manifest.isEmpty() else spark.createDataFrame([], NESTED)
    told = F.when(F.col("response.record_type") == "response", F.octet_length("response.payload")).otherwise(F.col("payload_bytes"))
    found = whole.select(
        "page_id", told.cast("bigint").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.col("response.intact").alias("intact"), "request", F.col("response").dropFields("payload").alias("response"), "metadata",
    )
    found = common.materialize(found, "captures")
    wanted = found.where("record_type = 'revisit'").select("payload_digest").distinct()
    first = found.where("record_type = 'response'").join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    refers = F.when(F.col("record_type") == "revisit", F.col("first")).alias("refers_to")
    return found.join(first, "payload_digest", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", refers, "intact", "request", "response", "metadata")
