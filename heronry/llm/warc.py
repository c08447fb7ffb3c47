"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader's tasks take byte ranges: a task looks for the gzip magic,
takes a place for a member only if decoding it begins a WARC header, and owns the records that start inside its
range, whose last may end beyond it. Members follow one another, so only a range's first needs looking for; after
damaged bytes the search goes on.

Records with equal payloads of at least ``least`` bytes: the one with the smallest page_id is a response, the
others are revisits that refer to it. Payload digests are bare upper-case base32 SHA-1.

Archives are written and read through the file system of the folder, as Arrow knows it: ``file``, ``s3`` (and
``s3a``), ``gs``, ``abfss``, and ``hdfs`` where its native library is installed. A writing task names its files
anew in every attempt and reports them; only the files of successful attempts are in the table that the reader
gets. Payloads stay where they are read: what meets the pages is the table of revisits, by page and digest, so a
payload with very many copies burdens no task.

Defined cases: null html is an empty payload; a null url has no target header; rows with equal page_id and payload
are alike (all response or all revisit); a null page_id comes after all others; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, tidy

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
#: An archive is closed at this size.
ROLL = 1 << 30
#: Tasks that ranges are dealt to; with more ranges a task takes several.
MOST_TASKS = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(kind: str, name: str, url: str | None, payload: bytes, sha: str, refers: str | None, date: str) -> bytes:
    """A WARC record with an HTTP response as its block; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers is not None:
        head += [("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, block and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers.get("content-length", len(rest)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {"headers": headers, "payload": payload, "length": length}


def page_urn(page_id) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def urn_page(value: str | None):
    number = (value or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path in it."""
    return pafs.FileSystem.from_uri("s3" + folder[3:] if folder.startswith("s3a:") else folder)


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, size, records) of the archives that now hold a record for every page (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")).withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    sums = materialize(rows.where("sha is not null").select("page_id", "sha"), "digests")
    first = materialize(sums.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").select("sha", "first"), "firsts")
    again = materialize(sums.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first").distinct(), "revisits")
    marked = rows.alias("p").join(again.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.sha") == F.col("r.sha")), "left").select("p.page_id", "p.url", "p.payload", "r.first")

    def run(batches):
        fs, base = file_system(folder)
        out, name, size, count = None, None, 0, 0
        for b in batches:
            for i, url, payload, f in zip(*(b.column(c) for c in ("page_id", "url", "payload", "first"))):
                i, payload, f = i.as_py(), payload.as_py(), f.as_py()
                if out is None:
                    name, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = member(record("response" if f is None else "revisit", page_urn(i), url.as_py(), payload, digest(payload), None if f is None else page_urn(f), date))
                out.write(data)
                size += len(data)
                count += 1
                if size >= ROLL:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "records": [count]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "records": [count]})

    return materialize(marked.mapInArrow(tidy(run), "path string, size long, records long"), "archives")


def members(read, size: int, lo: int, hi: int):
    """(start, record) of the members that start in [lo, hi); ``read(at, n)`` gives bytes of the file."""
    step, at, hold, base = 1 << 20, lo, b"", lo
    while at < hi:
        if len(hold) - (at - base) < 64 and base + len(hold) < size:
            hold, base = hold[at - base :] + read(base + len(hold), step), at
        k = hold.find(MAGIC, at - base)
        if k < 0:
            at = max(at, base + len(hold) - 2)
            if base + len(hold) >= size:
                return
            hold, base = hold[at - base :] + read(base + len(hold), step), at
            continue
        at = base + k
        if at >= hi:
            return
        d, out, pos, bad = zlib.decompressobj(31), [], k, False
        while not d.eof:
            if pos >= len(hold):
                more = read(base + len(hold), step)
                if not more:
                    bad = True
                    break
                hold += more
            piece = hold[pos : pos + 65536]
            try:
                out.append(d.decompress(piece))
            except zlib.error:
                bad = True
                break
            pos += len(piece)
            if len(out) == 1 and len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                bad = True
                break
        data = b"".join(out)
        if bad or not data.startswith(b"WARC/1."):
            at += 1
            continue
        yield at, data
        at = base + pos - len(d.unused_data)


def read_archives(files: DataFrame, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all records of the files (path, size)."""
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo"))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        fs, _ = file_system(folder)
        for b in batches:
            for path, size, lo in zip(*(b.column(c).to_pylist() for c in ("path", "size", "lo"))):
                rows = []
                with fs.open_input_file(path) as f:
                    for _, data in members(lambda at, n: f.read_at(min(n, size - at), at) if at < size else b"", size, lo, min(size, lo + range_bytes)):
                        r = parse(data)
                        h, kind = r["headers"], r["headers"]["warc-type"]
                        whole = kind == "response"
                        rows.append((urn_page(h["warc-record-id"]), h.get("warc-target-uri"), len(r["payload"]) if whole else r["length"], digest(r["payload"]) if whole else h["warc-payload-digest"].removeprefix("sha1:"), kind, urn_page(h.get("warc-refers-to"))))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # a task a range: without a number the plan would merge ranges by the few bytes that name them
    tasks = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    return ranges.repartition(int(min(tasks, MOST_TASKS))).mapInArrow(tidy(run), schema)


def _batch(rows):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def new_folder(spark: SparkSession) -> str:
    # with its file system, which a path without a scheme leaves to the cluster's default
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return folder


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
