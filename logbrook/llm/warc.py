"""WARC archives as chunked record tables.

A record is written as rows (row, chunk, last, data, digest): its header and the first part of its
block are chunk 0, and an oversized payload goes on in rows of at most CHUNK bytes, each carrying the
SHA-256 of the payload up to its end. Concatenated by row and chunk the data are the archive's bytes
(`export_file`). Writer and reader hold one chunk at a time. A payload seen before becomes a revisit
record without block, which names the response that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

CHUNK, REVISIT_FROM = 1 << 20, 100
CHUNKS = "row long, chunk int, last boolean, data binary, digest string"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def header(kind: str, page_id, uri, digest: str, length: int, refers_to) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if uri is not None:
        fields.append(("WARC-Target-URI", str(uri).replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        fields.append(("Content-Type", "application/http;msgtype=response"))
    fields.append(("Content-Length", str(length)))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def write_batches(chunk: int):
    """(row, page_id, uri, payload, payload_digest, refers_to) -> chunk rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
        names = ["row", "chunk", "last", "data", "digest"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            held, rows = 0, []
            payloads = batch.column(3).cast(pa.large_binary())
            for k, (row, page, uri, digest, refers) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)))):
                if refers is not None:
                    rows.append((row, 0, True, header("revisit", page, uri, digest, 0, refers) + b"\r\n\r\n", digest))
                    continue
                payload = memoryview(payloads[k].as_buffer() or b"")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                head = header("response", page, uri, digest, len(http) + len(payload), None) + http
                running, count = hashlib.sha256(), max(1, -(-len(payload) // chunk))
                for i in range(count):
                    part = payload[i * chunk : (i + 1) * chunk]
                    running.update(part)
                    last = i == count - 1
                    data = head * (i == 0) + bytes(part) + b"\r\n\r\n" * last
                    rows.append((row, i, last, data, running.hexdigest()))
                    held += len(data)
                    if held > 4 * chunk:
                        yield table(rows)
                        held, rows = 0, []
            if rows:
                yield table(rows)

    return run


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows, those of a record in order -> a row per record, its payload digest computed chunk by chunk."""
    import hashlib

    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    row, at, left, fields, running = None, 0, 0, {}, None

    def page(field: str):
        number = fields.get(field, "")[len("<urn:page:") : -1]
        return int(number) if number else None

    for batch in batches:
        rows = []
        for k, (its, chunk, last, digest) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))):
            data = memoryview(batch.column(3)[k].as_buffer())
            if chunk == 0:
                text, end = _until_blank(data, 0)
                row, at, running = its, 1, hashlib.sha256()
                fields = dict(line.split(": ", 1) for line in text.split("\r\n")[1:])
                left = int(fields["Content-Length"])
                if fields["WARC-Type"] == "response":
                    _, begin = _until_blank(data, end)
                    left -= begin - end
                    end = begin
                data, count = data[end:], left
            elif its != row or chunk != at:
                raise ValueError(f"record row {its}: chunk {chunk} is out of order")
            else:
                at += 1
            payload = data[:left]
            running.update(payload)
            left -= len(payload)
            if fields["WARC-Type"] == "response" and running.hexdigest() != digest:
                raise ValueError(f"record row {its}: chunk {chunk} doesn't match its digest")
            if last:
                stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                response = fields["WARC-Type"] == "response"
                if left or bytes(data[len(payload) :]) != b"\r\n\r\n" or response and stated != digest:
                    raise ValueError(f"record row {its} is damaged")
                rows.append((page("WARC-Record-ID"), fields["WARC-Type"], count if response else None, stated, page("WARC-Refers-To")))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types)], names)


def _until_blank(data: memoryview, begin: int) -> tuple[str, int]:
    """The header lines from begin, and where what follows the blank line begins."""
    size = 4096
    while (found := bytes(data[begin : begin + size]).find(b"\r\n\r\n")) < 0:
        if begin + size >= len(data):
            raise ValueError("a header doesn't end")
        size *= 4
    return bytes(data[begin : begin + found]).decode(), begin + found + 4


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", chunk: int = CHUNK) -> DataFrame:
    """The archive of all rows as a chunk table. Payloads are UTF-8; null is the empty payload.

    Of rows with equal payloads of at least 100 bytes that with the least id is a response and the others
    revisit it; rows that repeat that id are responses too, and rows without an id revisit it. Where none has
    an id all are responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    digests = scratch.write(rows.where(F.length("payload") >= REVISIT_FROM).select("page_id", "payload_digest"), "digests")
    first = digests.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    again = digests.join(first, "payload_digest").where("page_id IS NULL OR page_id > refers_to").select(F.col("payload_digest").alias("of"), F.col("page_id").alias("id"), "refers_to").distinct()
    again = scratch.write(again, "revisits")
    marked = rows.join(again, (rows["payload_digest"] == again["of"]) & rows["page_id"].eqNullSafe(again["id"]), "left")
    marked = marked.select(F.monotonically_increasing_id().alias("row"), "page_id", "uri", "payload", "payload_digest", "refers_to")
    return scratch.write(marked.mapInArrow(write_batches(chunk), CHUNKS), "archive")


def read(archive: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each record: page_id, record_type, payload_bytes, payload_digest, refers_to.

    Records of one chunk are read where they lie; only those of several are brought together and
    sorted. A revisit's payload length is that of the response which it names.
    """
    whole = archive.where("chunk = 0 AND last").mapInArrow(read_batches, RECORDS)
    parts = archive.where("NOT (chunk = 0 AND last)").repartition("row").sortWithinPartitions("row", "chunk")
    records = scratch.write(whole.unionByName(parts.mapInArrow(read_batches, RECORDS)), "records")
    responses = records.where("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("its")).agg(F.min("payload_bytes").alias("length"))
    revisits = records.where("record_type = 'revisit'")
    resolved = revisits.join(known, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("its")), "left")
    return responses.unionByName(resolved.select("page_id", "record_type", F.col("length").alias("payload_bytes"), "payload_digest", "refers_to"))


def export_file(archive: DataFrame, path: str) -> int:
    """Write the archive's bytes to one local file, a row at a time; returns the number of bytes."""
    total = 0
    with open(path, "wb") as file:
        for part in archive.orderBy("row", "chunk").select("data").toLocalIterator():
            total += file.write(part["data"])
    return total


def round_trip(pages: DataFrame, tag: str = "warc") -> DataFrame:
    scratch = Scratch(pages.sparkSession, tag)
    return read(write(pages, scratch), scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
