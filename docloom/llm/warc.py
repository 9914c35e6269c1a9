"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Writing: one record for each page, gzip member by member, in archive files of bounded size in a
folder that every executor shares.  Of pages with equal payloads of at least `least_bytes`, that
with the largest id is the response and the others revisit it.

Reading: each file is read record by record and every record is checked (gzip checksum, version
line, Content-Length, end of record, payload digest).  After a failed check the reader searches for
the next gzip member (or version line in a plain file) that yields a valid record, goes on from
there, and logs the bytes between as a quarantined gap.  A damaged byte costs its own record only.

Null pages count as empty payloads, null addresses as none.  Rows that repeat an id are separate
records; of equal payloads each row with the largest id is a response.  A page without an id is a
response, as no record could name it.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Workspace, column_of, quoted, shared_dir, written

VERSION = b"WARC/1.1\r\n"
_MEMBER = b"\x1f\x8b\x08"
_READ = 1 << 14
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           date: str = "2024-01-01T00:00:00Z", level: int = 1) -> bytes:
    """One gzip member with a response or revisit record of the page."""
    head = _HTTP % len(payload)
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _sha1(payload)),
               ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    text = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text) + pack.flush()


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record at `at` of a plain archive and where it ends; None if any check fails."""
    if not _LINE.match(data, at):
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not fields.get("content-length", "").isdigit():
        return None
    begin = end + 4
    stop = begin + int(fields["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        return None
    block = data[begin:stop]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1(block):
        return None
    head = block.find(b"\r\n\r\n")
    payload = block[head + 4:] if head >= 0 else block
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != _sha1(payload):
        return None
    told = re.search(rb"(?i)content-length: (\d+)", block[:head + 2]) if head >= 0 else None
    fields["payload"] = payload
    fields["payload_bytes"] = int(told[1]) if told else len(payload)
    return fields, stop + 4


def _member(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record in the gzip member at `at` and where the member ends; None if any check fails."""
    if data[at:at + 3] != _MEMBER:
        return None
    unpack, pieces, end, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        # In pieces: what lies behind the member is copied for each, and it may be a whole archive.
        while not unpack.eof and end < len(data):
            pieces.append(unpack.decompress(view[end:end + _READ]))
            end = min(end + _READ, len(data))
        pieces.append(unpack.flush())
    except zlib.error:
        return None
    if not unpack.eof:
        return None
    text = b"".join(pieces)
    found = _parse(text, 0)
    if found is None or found[1] != len(text):
        return None
    return found[0], end - len(unpack.unused_data)


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """(kind, begin, end, fields) of each record or gap of an archive, in order, covering all of it."""
    at, bad, n = 0, None, len(data)
    while at < n:
        plain = data[at:at + 5] == b"WARC/"
        found = _parse(data, at) if plain else _member(data, at)
        if found is not None:
            if bad is not None:
                yield "gap", bad, at, None
                bad = None
            yield "record", at, found[1], found[0]
            at = found[1]
            continue
        bad = at if bad is None else bad
        line = _LINE.search(data, at + 1)
        places = [p for p in (data.find(_MEMBER, at + 1), line.start() if line else -1) if p >= 0]
        at = min(places) if places else n
    if bad is not None:
        yield "gap", bad, n, None


def replace(fs: pafs.FileSystem, draft: str, name: str) -> None:
    """Gives a finished file its name; one that an earlier attempt left goes first, as not every store renames onto a file."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(draft, name)


def write_archives(pages: DataFrame, folder: str, work: Workspace, least_bytes: int = 1000, roll_bytes: int = 32 << 20) -> DataFrame:
    """Writes the pages and returns (file, bytes, records) of each archive, written when it is evaluated.

    A file's name tells its partition, and a file appears whole or not at all, so a task that runs
    again replaces what it left.
    """
    page_id, url, html = (F.col(quoted(column_of(pages, c))) for c in ("page_id", "url", "html"))
    page = pages.select(page_id.cast("long").alias("page_id"), url.cast("string").alias("url"), F.encode(F.coalesce(html, F.lit("")), "utf-8").alias("payload"))
    page = page.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # Which record a page revisits is found from ids and digests alone.  Payloads are then dealt by id and digest, so the
    # copies of one page don't meet in a task.
    long = page.select("digest", "page_id", "n").where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).select("digest", "page_id")
    heads = work.written(long.groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1").select(
        "digest", "head"), "heads")
    revisits = work.written(long.join(heads, "digest").where("page_id <> head").distinct(), "revisits")
    rows = page.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "head").sortWithinPartitions("page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        pieces, size, number, made = [], 0, 0, []

        def close():
            nonlocal pieces, size, number
            name = f"part-{place.partitionId():05d}-{number:04d}.warc.gz"
            draft = f"{root}/.{name}.{place.taskAttemptId()}"
            with fs.open_output_stream(draft, compression=None) as f:
                for p in pieces:
                    f.write(p)
            replace(fs, draft, f"{root}/{name}")
            made.append((name, size, len(pieces)))
            pieces, size, number = [], 0, number + 1

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, head = (batch.column(c)[i].as_py() for c in range(4))
                revisit = head is not None
                pieces.append(record(page_id, url, payload, head, revisit))
                size += len(pieces[-1])
                if size >= roll_bytes:
                    close()
        if pieces:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["file", "bytes", "records"])
    return rows.mapInArrow(run, "file string, bytes long, records long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record and for each quarantined gap of the folder's archives.

    kind (record or gap), file, begin and end (bytes in the file), page_id, record_type, refers_to, url,
    payload_bytes and payload_digest of the full payload, and if asked for the payload.
    """
    schema = ("kind string, file string, begin long, end long, page_id long, record_type string, refers_to long, url string, "
              "payload_bytes long, payload_digest string, payload binary")

    def number(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                           for n, t in (x.strip().split() for x in schema.split(","))])
        for batch in batches:
            for i in range(batch.num_rows):
                file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = []
                for kind, begin, end, f in salvage(data):
                    f = f or {}
                    told = f.get("warc-payload-digest", "")
                    digest = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") else None
                    rows.append((kind, file, begin, end, number(f.get("warc-record-id")), f.get("warc-type"), number(f.get("warc-refers-to")),
                                 f.get("warc-target-uri"), f.get("payload_bytes"), digest, f.get("payload") if payloads else None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads the archives back: one row for each record.

    Reading is strict here: a quarantined gap, or other records than were written, is an error.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark) + "/warc"
    with Workspace(spark) as work:
        made = write_archives(pages, folder, work).agg(F.sum("records")).first()[0]
    if not made:
        return spark.createDataFrame([], "kind string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = written(read_archives(spark, folder, payloads=False), "records")
    kinds = {r[0]: r[1] for r in back.groupBy("kind").count().collect()}
    if kinds != {"record": made}:
        raise RuntimeError(f"{made} records written, read back: {kinds}")
    return back
