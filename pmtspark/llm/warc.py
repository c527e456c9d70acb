"""WARC archives: writing with revisits and segments, and reading back by reassembly.

Archives are written by Spark's text writer: a record is a row, and the two line ends that
close a record are the line separator. So they go to any store that Spark writes to.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmtspark.sources import materialise
from pmtspark.sources.tables import scratch_root

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 4096
BATCH_BYTES = 8 << 20
LEAST_REVISIT = 100
PAGES = "urn:pages:"

INFLATE_BYTES = 1 << 20

RECORD = (
    "group_id string, segment int, total_length long, record_type string, page_id long, "
    "refers_to long, refers_uri string, header_digest string, block binary"
)
WHOLE = (
    "page_id long, record_type string, refers_to long, refers_uri string, header_digest string, "
    "complete boolean, payload binary"
)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds payload, digest, refers_to (null for responses) and repeated.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response.
    ``repeated`` marks payloads that a page_id has more than once.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    per_page = own.groupBy("digest", "page_id").agg(
        F.count("*").alias("rows"), F.max(F.octet_length("payload")).alias("bytes")
    )
    per_payload = per_page.groupBy("digest").agg(
        F.min(F.when(F.col("bytes") >= least, F.col("page_id"))).alias("first"),
        (F.max("rows") > 1).alias("repeated"),
    )
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return own.join(per_payload, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("first").isNotNull() & later, F.col("first")).alias("refers_to"),
        "repeated",
    )


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block


def records_of(row: dict, name: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response and its continuations."""
    url = re.sub(r"\s+", "%20", row["url"]) if row["url"] is not None else None
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Page-ID", row["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
    ]
    if row["refers_to"] is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
        yield _record(
            [
                ("WARC-Type", "revisit"),
                ("WARC-Record-ID", f"<{name}>"),
                ("WARC-Profile", PROFILE),
                ("WARC-Refers-To", f"<{PAGES}{row['refers_to']}>"),
                *common,
            ],
            block,
        )
        return
    block = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        b"Transfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    )
    parts = range(0, len(block), segment_bytes)
    for n, at in enumerate(parts, 1):
        part = block[at : at + segment_bytes]
        last = n == len(parts)
        segment = [("WARC-Segment-Number", n)] if len(parts) > 1 else []
        if n == 1:
            yield _record(
                [
                    ("WARC-Type", "response"),
                    ("WARC-Record-ID", f"<{name}>"),
                    ("Content-Type", "application/http; msgtype=response"),
                    *common,
                    *segment,
                ],
                part,
            )
        else:
            yield _record(
                [
                    ("WARC-Type", "continuation"),
                    ("WARC-Record-ID", f"<{name}:{n}>"),
                    ("WARC-Segment-Origin-ID", f"<{name}>"),
                    ("WARC-Date", DATE),
                    *segment,
                    ("WARC-Segment-Total-Length", len(block) if last else None),
                ],
                part,
            )


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per page to gzip archives below ``path``, one archive per task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                name = f"{PAGES}{row['page_id']}"
                if row["repeated"]:  # each of several equal rows has a name of its own
                    name, n = f"{name}:{task}.{n}", n + 1
                for record in records_of(row, name, segment_bytes):
                    rows.append(record)
                    size += len(record)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
                    rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    made = with_revisits(pages).mapInArrow(build, "record binary")
    made.select(F.col("record").cast("string")).write.mode("overwrite").options(
        lineSep=END, compression="gzip"
    ).text(path)


def inflated(data: memoryview) -> Iterator[bytes]:
    """The text of all gzip members of an archive, a piece at a time.

    Zero bytes after a member are padding; anything else that is no member, or a member that
    breaks off, is an error.
    """
    while len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if not len(data):
                raise ValueError("a gzip member breaks off")
            piece, data = data[:INFLATE_BYTES], data[INFLATE_BYTES:]
            yield member.decompress(piece)
        rest = member.unused_data
        if rest:  # the next member began in the last piece
            data = memoryview(data.obj)[len(data.obj) - len(data) - len(rest) :]
        if not bytes(data[:1]).strip(b"\0"):
            if bytes(data).strip(b"\0"):
                raise ValueError("text after a gzip member")
            return


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; memory follows the longest record."""
    held = bytearray()

    def fill(wanted) -> bool:
        while not wanted():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: len(held) > 0):
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("a WARC header breaks off")
        start = held.index(b"\r\n\r\n") + 4
        first, *lines = held[: start - 4].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = start + int(fields["content-length"])
        if not fill(lambda: len(held) >= end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, bytes(held[start:end])
        del held[: end + 4]


def _number(text: str | None) -> int | None:
    """Whole number of 64 bits, or None for any other text."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return int(text) if abs(int(text)) < 2**63 else None


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {
        "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
        "boolean": pa.bool_(),
    }
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        [n for n, _ in fields],
    )


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """Records of the archives below ``path``, as they stand: see RECORD.

    ``segmented`` keeps only those with a segment number (or a segment origin), or only those
    without. Archives may have one gzip member or many; an empty one has no records. Ids that
    are no whole numbers, or of no page, give a null page_id or refers_to, and stand in group_id and refers_uri.
    An archive is held by one task; ``write_warc`` makes them as large as Spark's partitions.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for f, block in split_records(inflated(memoryview(archive.as_py()))):
                    apart = "warc-segment-number" in f or "warc-segment-origin-id" in f
                    if segmented is not None and apart != segmented:
                        continue
                    origin = f.get("warc-segment-origin-id") or f.get("warc-record-id", "")
                    refers = f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None
                    rows.append(
                        (
                            origin.strip("<>"),
                            _number(f.get("warc-segment-number")),
                            _number(f.get("warc-segment-total-length")),
                            f.get("warc-type"),
                            _number(f.get("page-id")),
                            _number(refers.removeprefix(PAGES)) if refers else None,
                            refers,
                            f.get("warc-payload-digest", "").removeprefix("sha256:"),
                            block,
                        )
                    )
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield _batch(rows, RECORD)
                        rows, size = [], 0
                yield _batch(rows, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def dechunk(body: bytes) -> bytes:
    """Payload of a body in chunked framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        at += 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _assembled(held: list[dict]) -> tuple:
    """The row of WHOLE that the records of an origin, in order of segments, make."""
    first = held[0]
    parts = [r["block"] for r in held]
    whole = first["segment"] is None and len(held) == 1
    whole |= (
        [r["segment"] for r in held] == list(range(1, len(held) + 1))
        and held[-1]["total_length"] == sum(map(len, parts))
    )
    whole &= first["record_type"] != "continuation"
    payload = None
    if whole and first["record_type"] == "response":
        payload = payload_of(b"".join(parts))
    names = ("page_id", "record_type", "refers_to", "refers_uri", "header_digest")
    return (*(first[n] for n in names), whole, payload)


def single(records: DataFrame) -> DataFrame:
    """Rows of WHOLE from records without segments, each where it was read."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_assembled([r]) for r in batch.to_pylist()], WHOLE)

    return records.mapInArrow(build, WHOLE)


def reassemble(records: DataFrame) -> DataFrame:
    """A row of WHOLE per record that was cut into segments.

    Continuations are grouped by their origin, ordered by segment number, and joined. A
    record is complete if its segments are numbered from 1 without a gap or a repeat and
    its length is the stated total; otherwise its payload is null. A task holds one record
    at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held = [], 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                if held and row["group_id"] != held[0]["group_id"]:
                    out.append(_assembled(held))
                    size += len(out[-1][-1] or b"")
                    held = []
                    if size >= BATCH_BYTES:
                        yield _batch(out, WHOLE)
                        out, size = [], 0
                held.append(row)
        if held:
            out.append(_assembled(held))
        yield _batch(out, WHOLE)

    return (
        records.repartition("group_id")
        .sortWithinPartitions("group_id", "segment")
        .mapInArrow(join, WHOLE)
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives below ``path``, with whole payloads: see WHOLE.

    Only records that were cut into segments are shuffled; the others become rows where they
    are read.
    """
    whole = single(read_records(spark, path, segmented=False))
    return whole.unionByName(reassemble(read_records(spark, path, segmented=True)))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and describe them.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to,
    complete. A revisit has the payload of the response it refers to. Columns used: page_id,
    url, html. Null html is an empty payload; a null url is left out. A null page_id is the
    largest. Rows that repeat a page_id and payload are all responses, or all revisits. An
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    read = read_warc(spark, path).select(
        "page_id",
        "record_type",
        "refers_to",
        "header_digest",
        "complete",
        F.octet_length("payload").cast("long").alias("own_bytes"),
        F.sha2("payload", 256).alias("own_digest"),
    )
    found = materialise(read, "warc-records")
    responses = (
        found.where("record_type = 'response' AND complete")
        .select(
            F.col("page_id").alias("refers_to"),
            F.col("own_digest").alias("header_digest"),
            F.col("own_bytes").alias("first_bytes"),
            F.col("own_digest").alias("first_digest"),
        )
        .dropDuplicates(["refers_to", "header_digest"])
    )
    return found.join(responses, ["refers_to", "header_digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "first_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "first_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "complete",
    )
