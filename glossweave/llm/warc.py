"""Operator 4: WARC archives and the resolution of revisits.

Records are WARC/1.1 gzip members, one file a partition. Resolution reads headers alone, shuffles them by payload digest (combined to
one row a digest and task first), makes the record of the least page_id among equal payloads the original, joins the others to it, and
writes archives anew, file by file: originals keep their payload, the others become revisit records with fresh headers that name the
original. Revisit records of the input stay revisits: they name what the record that they refer to has become, or else the original of
their digest; one whose original isn't in the input keeps its reference. Payloads are never shuffled. Reading back joins revisits to their originals by record ID.

Cases: a null html is an empty payload; equal payloads of fewer bytes than `least` stay responses; a null page_id comes after all
others and is null in what refers to it; repeated rows are records of their own (which of several equal page_ids is the original is
decided by file and place); a null url has no target header, line ends in one are percent-encoded; an empty table makes no files;
other columns play no part. Payloads count as equal if their SHA-1 and length are.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .storage import file_system, materialise, write_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "file string, place long, record_id string, record_type string, page_id long, url string, digest string, payload_bytes long, refers_to_id string"
_BATCH = 512


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(fields: dict[str, str | None], block: bytes, level: int = 6) -> bytes:
    """One gzip member: version, header lines in the order given (None: left out), block."""
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields.items() if v is not None)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response(record_id: str, page_id: int | None, url: str | None, date: str, payload: bytes, digest: str) -> bytes:
    return record(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<{record_id}>",
            "WARC-Date": date,
            "WARC-Target-URI": url,
            "WARC-Payload-Digest": f"sha1:{digest}",
            "X-Page-ID": None if page_id is None else str(page_id),
            "Content-Type": "application/http; msgtype=response",
        },
        http_head(len(payload)) + payload,
    )


def revisit(record_id: str, page_id: int | None, url: str | None, date: str, digest: str, original_id: str | None, original_url: str | None, original_date: str | None = None) -> bytes:
    return record(
        {
            "WARC-Type": "revisit",
            "WARC-Record-ID": f"<{record_id}>",
            "WARC-Date": date,
            "WARC-Target-URI": url,
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": None if original_id is None else f"<{original_id}>",
            "WARC-Refers-To-Target-URI": original_url,
            "WARC-Refers-To-Date": original_date or date,
            "WARC-Payload-Digest": f"sha1:{digest}",
            "X-Page-ID": None if page_id is None else str(page_id),
            "Content-Type": "application/http; msgtype=response",
        },
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n",
    )


def records(uri: str, block: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, one in memory at a time."""
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as f:
        data = f.read(block)
        while data:
            press, parts = zlib.decompressobj(31), []
            while data:
                parts.append(press.decompress(data))
                if press.eof:
                    data = press.unused_data or f.read(block)
                    break
                data = f.read(block)
            else:
                if not press.eof:
                    raise ValueError(f"{uri} ends inside a record")
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"{uri} holds something else than WARC/1.1 records")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def _header(file: str, place: int, fields: dict[str, str], block: bytes, check: bool) -> tuple:
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if check and payload is not None and digest_of(payload) != digest:
        raise ValueError(f"record {place} of {file}: the payload doesn't have its digest")
    page = fields.get("X-Page-ID")
    return (
        file,
        place,
        fields["WARC-Record-ID"][1:-1],
        kind,
        None if page is None else int(page),
        fields.get("WARC-Target-URI"),
        digest,
        None if payload is None else len(payload),
        fields.get("WARC-Refers-To", "")[1:-1] or None if kind == "revisit" else None,
    )


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    parts = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), parts, strict=True)], [n for n, _ in parts])


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One archive a partition of pages (page_id, url, html), all of them responses. Returns file, records."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def parts() -> Iterator[bytes]:
            nonlocal n
            for batch in batches:
                for lo in range(0, batch.num_rows, _BATCH):
                    some = batch.slice(lo, _BATCH)
                    for page, url, html in zip(*(c.to_pylist() for c in some.columns), strict=True):
                        payload = (html or "").encode()
                        yield response(uuid.uuid5(uuid.NAMESPACE_URL, f"{page}/{part}/{n}").urn, page, url, date, payload, digest_of(payload))
                        n += 1

        first = next(it := parts(), None)
        if first is not None:
            write_file(f"{path}/part-{part}.warc.gz", (x for y in ([first], it) for x in y))
            yield _rows([(f"part-{part}.warc.gz", n)], "file string, records long")

    return materialise(map_arrow(given, run, "file string, records long"), "archives")


def read_headers(spark: SparkSession, path: str, files: DataFrame, check: bool = False) -> DataFrame:
    """HEADERS of all records in the files (file, ...) of a folder; check: payloads are held against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for place, (fields, block) in enumerate(records(f"{path}/{file}")):
                    rows.append(_header(file, place, fields, block, check))
                    if len(rows) == _BATCH:
                        yield _rows(rows, HEADERS)
                        rows = []
                if rows:
                    yield _rows(rows, HEADERS)

    return map_arrow(files.select("file").repartition(_tasks(files), "file"), run, HEADERS)


def _tasks(files: DataFrame) -> int:
    """Partitions for work that is dealt by file: several a file, so that few files meet; a number, as header bytes say little of the work."""
    return max(1, min(4 * files.count(), 20_000))


def resolve(spark: SparkSession, path: str, files: DataFrame, to: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of a folder again, without repeated payloads, to another. Returns file, records."""
    everything = materialise(read_headers(spark, path, files).where("record_type in ('response', 'revisit')"), "headers")
    headers = everything.where("record_type = 'response'")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "place", "record_id", "url")
    groups = headers.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = headers.join(groups, ["digest", "payload_bytes"], "left")
    other = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    judged = joined.withColumn("original_id", F.when(other, F.col("first.record_id"))).withColumn("original_url", F.when(other, F.col("first.url")))
    decided = judged.select("file", "place", "original_id", "original_url")
    revisits = everything.where("record_type = 'revisit'")
    if not revisits.isEmpty():
        now = F.struct(F.coalesce("original_id", "record_id").alias("id"), F.when(F.col("original_id").isNull(), F.col("url")).otherwise(F.col("original_url")).alias("url"))
        named = judged.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min_by(now, order).alias("named"))
        alike = judged.groupBy("digest").agg(F.min_by(now, order).alias("alike"))
        own = revisits.join(named, "refers_to_id", "left").join(alike, "digest", "left").withColumn("now", F.coalesce("named", "alike"))
        decided = decided.unionByName(own.select("file", "place", F.col("now.id").alias("original_id"), F.col("now.url").alias("original_url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        ahead = next(rows, None)
        while ahead is not None:
            file, n = ahead[0], 0

            def parts(file: str = file) -> Iterator[bytes]:
                nonlocal ahead, n
                for place, (fields, block) in enumerate(records(f"{path}/{file}")):
                    if ahead is None or ahead[:2] != (file, place):
                        continue
                    _, _, record_id, kind, page, url, digest, _, refers_to = _header(file, place, fields, block, False)
                    if ahead[2] is None and kind == "revisit":
                        yield revisit(record_id, page, url, date, digest, refers_to, fields.get("WARC-Refers-To-Target-URI"), fields.get("WARC-Refers-To-Date"))
                    elif ahead[2] is None:
                        yield response(record_id, page, url, date, block.partition(b"\r\n\r\n")[2], digest)
                    else:
                        yield revisit(record_id, page, url, date, digest, ahead[2], ahead[3])
                    n += 1
                    ahead = next(rows, None)

            write_file(f"{to}/{file}", parts())
            yield _rows([(file, n)], "file string, records long")

    dealt = decided.repartition(_tasks(files), "file").sortWithinPartitions("file", "place")
    return materialise(map_arrow(dealt, run, "file string, records long"), "archives")


def read_resolved(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (the original's page_id) of all records."""
    headers = materialise(read_headers(spark, path, files, check=True), "resolved")
    revisits = headers.where("record_type = 'revisit'").drop("payload_bytes")
    originals = headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload_bytes", F.col("page_id").alias("refers_to"))
    columns = ["page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"]
    return headers.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.join(originals, "refers_to_id", "left").select(*columns))
