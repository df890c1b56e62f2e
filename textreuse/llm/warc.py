"""WARC archives: written by tasks, indexed first, read back by byte ranges.

Each task writes its records (one gzip member each, WARC/1.1) into archives of its own in the shared folder and returns
an index row per record: archive, offset, length, URL, digest. The index is a written table, so a lost executor repeats
only its own archives, under new names; archives that no index row names are leftovers of such attempts. Reading takes
the index rows that are asked for, sorted by archive and offset, joins ranges that lie close together into one read, and
splits long archives into stretches so that they are shared between tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST_REVISIT = 1000
#: A payload that more than this share of all pages have is joined by broadcast.
HOT_SHARE = 1 / 5000
#: A new archive begins beyond this; reads cover at most a stretch of it.
ARCHIVE_BYTES = 64 << 20
STRETCH_BYTES = 8 << 20
#: Bytes between two records that one read passes over.
GAP = 64 << 10
STAMP = "1970-01-01T00:00:00Z"

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    """Of the page and its payload, so that a revisit can name its response; records without a page have one of their own."""
    if page_id is None:
        return uuid.uuid4().urn.join("<>")
    return f"<urn:uuid:{uuid.UUID(int=int(digest[:16], 16) << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int:
    n = uuid.UUID(record.strip("<>").rpartition(":")[2]).int & (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def header_value(text: str) -> str:
    """Control signs would end a header; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member: a response with its payload, or a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {STAMP}"]
    if page_id is None:
        lines.append("X-Page-Id: null")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def with_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds digest, size and refers_to. Of rows with equal payloads of at least `least` bytes those with the largest
    page_id are responses (all of them, if that row is repeated), the others revisit it."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    groups = (
        pages.where((F.col("size") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("same"), F.col("size").alias("as_long"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
    )
    on = (F.col("digest") == F.col("same")) & (F.col("size") == F.col("as_long"))
    # payloads of many rows would bring their pages to one task: there are at most 1 / HOT_SHARE of them
    most = max(2.0, pages.count() * HOT_SHARE)
    hot = groups.where(F.col("n") > most).drop("n").withColumn("hot", F.lit(True))
    groups = groups.where(F.col("n") <= most).drop("n")
    pages = pages.join(F.broadcast(hot), on, "left").drop("same", "as_long")
    crowd = pages.where("hot").drop("hot")
    pages = pages.where("hot is null").drop("hot", "last").join(groups, on, "left").drop("same", "as_long").unionByName(crowd)
    return pages.select(
        "page_id", "url", "html", "digest", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to")
    )


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes an archive or more per task, returns the index. Lazy: the archives appear when the index is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, store, out, path, at = TaskContext.get(), None, None, "", 0
        kind = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
        for b in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    path = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    store, place = _open(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out, at = store.open_output_stream(place, compression=None), 0
                member = record(page_id, url, html.encode(), digest, refers_to)
                out.write(member)
                rows.append((page_id, path, at, len(member), url, digest, "response" if refers_to is None else "revisit"))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)
        if out is not None:
            out.close()

    return pages.mapInArrow(run, INDEX)


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = STRETCH_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) -> reads (from, to, first row, last row + 1), joined where they lie close together."""
    i = 0
    while i < len(rows):
        begin, end, j = rows[i][0], rows[i][0] + rows[i][1], i + 1
        while j < len(rows) and rows[j][0] - end <= gap and rows[j][0] + rows[j][1] - begin <= most:
            end, j = max(end, rows[j][0] + rows[j][1]), j + 1
        yield begin, end, i, j
        i = j


def read(index: DataFrame, stretch: int = STRETCH_BYTES, most: int = 20_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that the index rows select.

    A response's bytes and digest are those of the payload that was read; a digest that differs from the header's is an
    error. A revisit has no payload of its own: both stand in its headers. Stretches are dealt to at most `most` tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}
        for b in batches:
            archives, offsets, lengths = (b.column(c).to_pylist() for c in ("archive", "offset", "length"))
            order = sorted(range(b.num_rows), key=lambda i: (archives[i], offsets[i]))
            out, k = [], 0
            while k < len(order):
                last = k
                while last < len(order) and archives[order[last]] == archives[order[k]]:
                    last += 1
                uri, mine, k = archives[order[k]], order[k:last], last
                if uri not in files:
                    for f in files.values():
                        f.close()
                    store, place = _open(uri)
                    files = {uri: store.open_input_file(place)}
                spans = [(offsets[i], lengths[i]) for i in mine]
                for begin, end, a, z in ranges(spans):
                    raw = files[uri].read_at(end - begin, begin)
                    for offset, length in spans[a:z]:
                        warc, http, payload = parse(raw[offset - begin : offset - begin + length])
                        digest = warc["WARC-Payload-Digest"].rpartition(":")[2]
                        size, refers_to = int(http["Content-Length"]), warc.get("WARC-Refers-To")
                        if refers_to is None:
                            size, found = len(payload), hashlib.sha1(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"{uri} at {offset}: payload digest {found} is not {digest}")
                        page_id = None if "X-Page-Id" in warc else page_of(warc["WARC-Record-ID"])
                        out.append((page_id, size, digest, warc["WARC-Type"], refers_to and page_of(refers_to)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    by = F.floor(F.col("offset") / stretch).alias("stretch")
    asked = index.select("archive", "offset", "length", by)
    # as many tasks as there are stretches to read; Spark would size them by the index rows
    size = asked.agg(F.count_distinct("archive", "stretch")).first()[0]
    asked = asked.repartition(max(1, min(size, most)), "archive", "stretch").sortWithinPartitions("archive", "offset")
    return asked.mapInArrow(run, RECORD)


def archive(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record per page and reads all of them back: one row per page.

    Null html is an empty payload, a null url has no target header; a page with a null page_id is a response of its own
    (nothing refers to it) and comes back with a null page_id. Repeated rows have a record each, with one record id if
    their payloads are equal too. Payloads of any length are written and read whole. An empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.put(write(with_types(pages, least), f"{scratch.path}/archives"), "index")
    return read(index)
