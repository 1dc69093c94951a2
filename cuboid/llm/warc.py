"""WARC archives: a gzip member per record, written and read by tasks.

The writer stores a payload once: of records with one payload digest the one with the largest id is the response, the
others revisit it. The reader walks an archive sequentially: it decompresses members incrementally, frames records by
Content-Length and verifies their digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuboid.llm.tables import saved, shared_folder, small
from cuboid.llm.textops import slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, level: int = 3) -> bytes:
    """One record as a gzip member. A revisit keeps the payload's digest but not the payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE, "WARC-Target-URI": re.sub(r"\s", "%20", uri)}
    head |= {"WARC-Payload-Digest": _sha1(payload), "WARC-Block-Digest": _sha1(block)}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass")) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive given in chunks; headers' names are lower-case. Raises
    ValueError for a truncated archive, a wrong length or a digest that does not match. Holds one record at a time."""
    member, data, began = zlib.decompressobj(31), bytearray(), False
    for chunk in chunks:
        while chunk:
            began = True
            data += member.decompress(chunk)
            chunk = member.unused_data
            if member.eof:
                yield _parse(bytes(data))
                member, data, began = zlib.decompressobj(31), bytearray(), False
    if began:
        raise ValueError("the archive ends within a record")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers.get("content-length", "-1"))
    if size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size} does not fit the record of {len(rest)} bytes")
    block = rest[:size]
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise ValueError("block digest does not match")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers.get("warc-type") == "response" and headers.get("warc-payload-digest", _sha1(payload)) != _sha1(payload):
        raise ValueError("payload digest does not match")
    return headers, block


def record_types(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """pages (page_id, url and html columns) with _refers_to: the id of the response that a revisit repeats."""
    size, digest = F.octet_length(F.coalesce(F.col(html), F.lit(""))), F.sha1(F.coalesce(F.col(html), F.lit("")))
    long = pages.select(F.col(page_id).alias("_last"), digest.alias("_digest"), size.alias("_size")).filter(F.col("_size") >= least_bytes)
    twice = saved(long.groupBy("_digest").agg(F.max("_last").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    both = pages.withColumn("_digest", digest).join(twice, "_digest", "left")
    refers = F.when((size >= least_bytes) & F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col(page_id)), F.col("_last"))
    return both.withColumn("_refers_to", refers).drop("_digest", "_last")


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, archive_bytes: int = 256 << 20) -> list[str]:
    """Writes archives of about archive_bytes to folder (a uri that executors can write to) and returns their uris.

    A null html is an empty payload, a null url an empty one; other columns are not written. Of repeated rows whose id
    is the largest of their payload all are responses. Every attempt of a task writes archives of its own names; those
    of attempts that did not end are deleted, so that a retried or speculative task neither loses nor repeats records."""
    job = uuid.uuid4().hex

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        attempt = f"{job}-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        names, out, size = [], None, 0
        for batch in slices(batches, html, 4 << 20):
            for i, u, h, r in zip(*(batch.column(c).to_pylist() for c in (page_id, url, html, "_refers_to")), strict=True):
                if out is None:
                    names.append(f"{attempt}-{len(names):05d}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                payload = (h or "").encode("utf-8", "surrogatepass")
                key = lambda x: f"urn:cuboid:page:{'' if x is None else x}"
                data = record("response" if r is None else "revisit", key(i), u or "", payload, None if r is None else key(r))
                out.write(data)
                size += len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    typed = record_types(pages.select(F.col(page_id).alias(page_id), F.col(url).alias(url), F.col(html).alias(html)), page_id, html, least_bytes)
    names = {r["name"] for r in typed.mapInArrow(run, "name string").collect()}  # a name per archive_bytes
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith(job) and info.base_name not in names:
            system.delete_file(info.path)
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(names)]


def read_warc(spark: SparkSession, path: str | list[str], payloads: bool = True, whole_bytes: int = 1 << 30) -> DataFrame:
    """The records of all archives (*.warc.gz) under path (or of a list of archives): record_id, record_type, uri,
    refers_to, payload (null for a revisit, and if not payloads), payload_bytes (null for a revisit), payload_digest
    (bare lower-case hexadecimal). An archive is read by one task, from start to end. Spark's reader hands over
    archives of up to whole_bytes; larger ones are opened as streams by their task, through Arrow's file systems."""

    def rows_of(chunks):
        rows, held = [], 0
        for headers, block in records(chunks):
            digest = headers.get("warc-payload-digest", "")
            full = headers.get("warc-type") != "revisit"
            payload = block.partition(b"\r\n\r\n")[2] if full else None
            rows.append((
                headers.get("warc-record-id", "").strip("<>"), headers.get("warc-type"), headers.get("warc-target-uri"),
                headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, payload if payloads else None,
                len(payload) if full else None, base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None))
            held += len(payload or b"")
            if held > 8 << 20 or len(rows) == 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                yield from rows_of(bytes(view[k : k + 65536]) for k in range(0, len(view), 65536))

    def streamed(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(place, compression=None) as f:
                    yield from rows_of(iter(lambda: f.read(1 << 20), b""))

    schema = "record_id string, record_type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
    if isinstance(path, list) and not path:
        return spark.createDataFrame([], schema)
    files = files.load(path)
    short = files.filter(F.col("length") <= whole_bytes).select("content").mapInArrow(whole, schema)
    return short.unionByName(files.filter(F.col("length") > whole_bytes).select("path").mapInArrow(streamed, schema))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    names = ["record_id", "record_type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes pages as archives, reads them back and resolves revisits: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    folder is a uri; by default a new one in the shared folder. Null and empty pages are empty payloads, very long ones
    single records. A null id gives a null page_id. Of repeated rows every one is a record. Other columns are ignored,
    whatever their names. An empty table gives an empty result."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:  # a path without a scheme lies on Spark's default file system
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        folder = re.sub("^file:/+", "file:///", folder)
    names = write_warc(pages, folder, page_id, url, html, least_bytes, archive_bytes)
    back = saved(read_warc(spark, names, payloads=False).drop("payload", "uri"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '([-0-9]+)$', 1) AS long)")
    whole = back.filter("record_type = 'response'")
    again = back.filter("record_type = 'revisit'")
    twice = saved(again.select("payload_digest").distinct())
    sizes = saved(whole.join(small(twice), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")), twice)
    again = again.drop("payload_bytes").join(small(sizes), "payload_digest", "left")
    return whole.unionByName(again).select(number("record_id").alias(page_id), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
