"""WARC archives with an index: each record a gzip member of its own, read back by byte range.

``write_archives`` streams pages through tasks; a task writes one archive to the shared folder and returns a row per
record: archive, offset, length, URL and digest. Spark commits these rows as the index, so the archive of a task that was
lost or ran twice is in no index. ``read_records`` sorts the wanted records by archive and offset, joins ranges
that lie close together into one read, and takes the records from it.

Equal payloads: the record with the largest page_id is the response, the others are revisits without a payload that name
its digest, length and page. Null html is an empty payload; repeated page_ids are written each, by their own payloads (rows of the largest
page_id with equal payloads are all responses, as the SQL form has it); null page_ids are written, and are never the response of another,
but refer to a page with their payload; payloads smaller than ``min_bytes`` are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmatch.llm.common import join_spread, new_path, stored

#: Ranges with no more bytes than this between them are read at once; no read is longer than READ.
GAP, READ = 64 << 10, 8 << 20
INDEX = "page_id string, archive string, offset long, length long, url string, payload_digest string"


def base32_sha1(payload):
    """Bare base32 of the SHA-1 of a column: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for k in range(8)])


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``payload_digest``, ``payload_bytes`` and ``refers_to`` (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = ["payload_digest", "payload_bytes"]
    rows = pages.select("page_id", "url", html.alias("payload"), base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    slim = rows.select("page_id", *key).where(F.col("payload_bytes") >= min_bytes)
    slim = slim.withColumn("_key", F.concat_ws(":", *key))
    groups = slim.groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("refers_to").isNotNull())
    revisits = join_spread(slim, groups, "_key").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "refers_to").distinct()
    # By page and payload: a page's rows are each judged by their own payload, and payloads that many pages share don't meet in one task.
    own = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    return rows.join(revisits, own, "left").drop("_page", "_digest", "_bytes")


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return where.open_output_stream(path, compression=None) if mode == "w" else where.open_input_file(path)


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> tuple[bytes, str]:
    """A WARC record and its payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"
    target = quote(url or "", safe="".join(map(chr, range(33, 127))))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", *([] if page_id is None else [f"X-Page-ID: {quote(page_id, safe='')}"])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {quote(refers_to, safe='')}", "WARC-Truncated: length"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Fields of a record, the payload that it holds, and the length that its HTTP header states."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return fields, payload, stated


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The stored index of the archives written below ``folder`` (a new one in the shared folder by default)."""
    base = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        archive, out, at = f"{base}-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", None, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or _open(archive, "w")
                raw, digest = record(page_id, url, payload, refers_to, date)
                out.write(member := _gzip(raw))
                rows.append((page_id, archive, at, len(member), url, digest))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    planned = plan_records(pages, min_bytes)
    index = planned.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string")).mapInArrow(run, INDEX)
    return stored(index.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType)), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) ranges as few reads: (from, to, the ranges' numbers)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (at, n) in enumerate(ranges):
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            out[-1] = out[-1][0], max(out[-1][1], at + n), [*out[-1][2], k]
        else:
            out.append((at, at + n, [k]))
    return out


RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the index rows given, each checked against its digest; with ``payloads`` also what they hold (null in revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, name = None, None
        for pdf in batches:
            for archive, part in pdf.groupby("archive", sort=False):
                if archive != name:
                    opened, name = _open(archive, "r"), archive
                part = part.sort_values("offset")
                rows = []
                for a, b, members in coalesced(list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))):
                    opened.seek(a)
                    held = opened.read(b - a)
                    for k in members:
                        at, n = int(part["offset"].iloc[k]) - a, int(part["length"].iloc[k])
                        fields, payload, stated = parse(zlib.decompress(held[at : at + n], 31))
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"a record of {archive} doesn't match its digest")
                        rows.append((unquote(fields["x-page-id"]) if "x-page-id" in fields else None, part["url"].iloc[k], fields["warc-type"], unquote(fields["x-refers-to-page"]) if revisit else None, stated, digest, *([None if revisit else payload] if payloads else [])))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads)

    parts = max(1, index.rdd.getNumPartitions())
    return index.select("archive", "offset", "length", "url").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset").mapInPandas(run, RECORD + ", payload binary" * payloads).withColumns({c: F.col(c).cast(index.schema["page_id"].dataType) for c in ("page_id", "refers_to")})


def payloads(records: DataFrame) -> DataFrame:
    """Records read with ``payloads``, revisits given the payload of the record that they refer to."""
    held = records.where(F.col("record_type") == "response").select(F.col("payload_digest"), F.col("payload").alias("_held")).dropDuplicates(["payload_digest"])
    return records.join(held, "payload_digest", "left").withColumn("payload", F.coalesce("payload", "_held")).drop("_held")


def unzipped(data: bytes) -> Iterator[bytes]:
    """The records of an archive from start to end, without an index."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        data = d.unused_data
