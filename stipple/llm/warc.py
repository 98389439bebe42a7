"""WARC archives, index first.

Writing gives an index row per record: file, offset, length, url, digest. Reading takes index rows (all of them or any
selection), sorts them by place, joins neighbouring byte ranges into one read each, and parses the records out of it.
Every record is a gzip member of its own. Of records with equal payloads of ``MIN_REVISIT_BYTES`` or more, that with
the smallest page_id is a response; the others are revisits, which refer to it and store no payload.

Defined cases: a null html is an empty payload; a null url is an empty one; a null page_id never is the one referred to
unless all are null, and then each is a response; rows that repeat the smallest page_id are responses too; an empty
table gives no file. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, n_partitions, scratch_dir, table

MIN_REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
#: Ranges closer than this are read in one piece, up to the second number of bytes.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
INDEX_DDL = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def from_urn(value: str) -> int | None:
    value = value.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        # a header ends with its line, so control characters are escaped
        "WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, record type, refers to) of one record; a stored payload is held against its digest."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Bytes"])
    kind = fields["WARC-Type"]
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
        return from_urn(fields["WARC-Record-ID"]), len(payload), digest, kind, None
    return from_urn(fields["WARC-Record-ID"]), n, digest, kind, from_urn(fields["WARC-Refers-To"])


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and, for payloads that occur again, the page_id of the response.

    The first page of a digest comes from a partial aggregation; the join's hot digests are left to adaptive splitting.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    return rows.join(firsts, "digest", "left")


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html) under ``uri``; returns their index, stored as Parquet beside them."""
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        context = TaskContext.get()
        part, at, rows, out, name, temp = 0, 0, [], None, "", ""

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temp, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "first")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first = (c[i].as_py() for c in columns)
                if out is None:
                    name = f"{context.partitionId():06d}-{part:04d}.warc.gz"
                    temp = f"{path}/.{name}.{context.taskAttemptId()}"
                    out, at, rows = fs.open_output_stream(temp, buffer_size=1 << 20), 0, []
                revisit = first is not None and first != page_id
                data = record(page_id, url, payload, digest, first, revisit)
                out.write(data)
                rows.append((name, at, len(data), page_id, url, digest, "revisit" if revisit else "response"))
                at += len(data)
                if at >= FILE_BYTES:
                    yield close()
                    part, out = part + 1, None
        if out is not None:
            yield close()

    return materialize(with_first(pages).mapInArrow(write, INDEX_DDL), "warc-index")


def ranges(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Groups of (offset, length), sorted by offset, that one read serves."""
    group: list[tuple[int, int]] = []
    end = 0
    for offset, length in places:
        if group and (offset - end > GAP_BYTES or offset + length - group[0][0] > RANGE_BYTES):
            yield group
            group, end = [], 0
        group.append((offset, length))
        end = max(end, offset + length)
    if group:
        yield group


def read_records(selected: DataFrame, uri: str) -> DataFrame:
    """Reads the records that index rows (file, offset, length) select."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for f, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by_file.setdefault(f, []).append((offset, length))
            for name, places in by_file.items():
                with fs.open_input_file(f"{path}/{name}") as f:
                    for group in ranges(sorted(places)):
                        base = group[0][0]
                        f.seek(base)
                        data = f.read(max(o + n for o, n in group) - base)
                        rows = [parse(data[o - base : o - base + n]) for o, n in group]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    places = selected.select("file", "offset", "length")
    # chunks of a file are places of their own, so that a file is read by several tasks and a batch holds whole ranges
    dealt = places.repartition(n_partitions(selected.sparkSession), "file", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_dir(spark, "warc")
    return read_records(write_archives(table(spark, sf_dir, "pages"), uri), uri)


ORACLE_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d,
  octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""
