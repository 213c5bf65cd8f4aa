"""WARC archives: writing pages as records with segments, revisits and chunked framing; reading them back.

Writing: of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page_id becomes a response
record and the others revisit records that refer to it. Responses hold an HTTP message in chunked transfer coding. A block over
``SEGMENT`` bytes is cut into a first record and continuation records that name its identifier, with a segment number,
and on the last one the total length. Each record is a gzip member of its own, so it can be sought. Archives are written by Spark's own
text writer, so they reach any store that Spark reaches: its lines are the members, and what parts them is an empty member.
``RECORDS_PER_FILE`` bounds a file.

Reading: files, gzipped or not, are parsed as a stream, once. Records in one piece are decoded where they are read; segments are
grouped by origin identifier and ordered by number, one record at a time in memory; numbers must be complete, lengths must
add up to the stated total, and chunks must end properly, else the record is not ``intact``. Revisits get the payload facts of the
record they refer to, which is known by page_id and digest; without such a record they are not intact.

Tables of copies and originals are written before they are joined: a join of two plain shuffles is one whose large keys
adaptive execution can split, so a payload that a third of all pages share is no single task.

Defined results: null html is an empty payload. Rows without page_id are response records that nothing refers to. Rows that share a
page_id and payload are all responses; rows that share only a page_id are records of their own. A null url is an empty target; very
long payloads are segmented. Other columns, whatever their names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

MIN_REVISIT = 1000
SEGMENT = 16_384
CHUNK = 4096
#: A file is read back as one row, so this bounds a reader's memory too.
RECORDS_PER_FILE = 5_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


#: Parts members in a file of lines: a member without content, as text of one byte a character.
_BETWEEN = gzip.compress(b"", mtime=0).decode("latin-1")


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that do not split a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        to = min(len(data), at + size)
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken or bytes are left over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            while not body.startswith(b"\r\n", at):
                end = body.find(b"\r\n", at)
                if end < 0:
                    return None
                at = end + 2
            return b"".join(out) if at + 2 == len(body) else None
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str = "0", segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, named by page_id and digest. The serial tells segmented rows apart."""
    sha1 = hashlib.sha1(payload).hexdigest()
    name = f"urn:page:{'none' if page_id is None else page_id}:{sha1}"
    target = ("WARC-Target-URI", "".join((url or "").split()))
    digest = ("WARC-Payload-Digest", f"sha1:{sha1}")
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        fields = [target, digest, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{sha1}>"), kind]
        yield _record("revisit", name, fields, _HEAD + b"\r\n")
        return
    block = _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = _cuts(block, segment)
    if len(pieces) == 1:
        yield _record("response", name, [target, digest, kind], block)
        return
    name += f":{serial}"
    yield _record("response", name, [target, digest, kind, ("WARC-Segment-Number", "1")], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        fields = [target, ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if k == len(pieces):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{name}:{k}", fields, piece)


def _zipped(record: bytes) -> bytes:
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(record) + member.flush()


def _lines(members: list[bytes]) -> pa.RecordBatch:
    """Members as strings: bytes that are written as they are."""
    return pa.RecordBatch.from_arrays([pa.array(members, pa.binary()).view(pa.string())], names=["value"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n += 1
            for record in page_records(*row, serial=f"{task}-{n}"):
                out.append(_zipped(record))
                size += len(out[-1])
            if size > 8 << 20:
                yield _lines(out)
                out, size = [], 0
        if out:
            yield _lines(out)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Writes ``pages(page_id, url, html)`` as WARC files below ``path``, a gzip member for each record."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    copies = (
        rows.filter((F.col("n") >= min_revisit) & F.col("page_id").isNotNull())
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("k"))
        .filter("k > 1")
        .drop("k")
    )
    copies = Scratch(pages.sparkSession, "copies").keep(copies, "copies")
    refers_to = F.when(F.col("page_id") < F.col("kept"), F.col("kept"))
    records = rows.join(copies.hint("merge"), ["digest", "n"], "left").select("page_id", "url", "payload", refers_to.alias("refers_to"))
    (
        records.mapInArrow(_written, "value string")
        .write.option("lineSep", _BETWEEN)
        .option("encoding", "ISO-8859-1")
        .option("compression", "none")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parsed(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive that comes in parts."""
    data, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(stream, None)
        if part is None:
            return False
        del data[:at]
        at = 0
        data.extend(part)
        return True

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if data[at:].strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        lines = bytes(data[at:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start with its version")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size, back = int(fields["content-length"]), end - at + 4
        while len(data) - at < back + size + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield fields, bytes(data[at + back : at + back + size])
        at += back + size + 4


def _unzipped(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of gzip members, one or many, a part at a time; other content as it is."""
    view, at = memoryview(content), 0
    if content[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + step]) for k in range(0, len(view), step))
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            given = member.unconsumed_tail
            if not given:
                given = view[at : at + step]
                at += len(given)
                if not given:
                    raise ValueError("an archive is cut short")
            if part := member.decompress(given, 1 << 20):
                yield part
        at -= len(member.unused_data)


def _http_payload(block: bytes) -> bytes | None:
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_FACTS = "name string, type string, refers_to string, stated string, target string, payload binary, n long, sha1 string, intact boolean"
_RECORD = f"{_FACTS}, number int, total long, block binary"
_KINDS = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def _facts(name: str, kind: str, refers_to, stated, target, block: bytes, whole: bool, payloads: bool) -> tuple:
    """Columns of ``_FACTS``. A revisit has no payload of its own."""
    if kind == "revisit":
        return name, kind, refers_to, stated, target, None, None, None, whole
    payload = _http_payload(block)
    if payload is None:
        return name, kind, refers_to, stated, target, None, None, None, False
    sha1 = hashlib.sha1(payload).hexdigest()
    return name, kind, refers_to, stated, target, payload if payloads else None, len(payload), sha1, whole and stated in (None, sha1)


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * width
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False)], names=_NAMES[:width])


def _read(payloads: bool):
    """File contents to records: facts of those in one piece; of segments, which have a number, their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parsed(_unzipped(content.as_py())):
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    name, kind = fields["warc-record-id"].strip("<>"), fields["warc-type"]
                    refers_to, stated = fields.get("warc-refers-to"), fields.get("warc-payload-digest")
                    known = refers_to and refers_to.strip("<>"), stated and stated.removeprefix("sha1:"), fields.get("warc-target-uri")
                    if number is None:
                        rows.append((*_facts(name, kind, *known, block, True, payloads), None, None, None))
                        size += len(block) * payloads + 300
                    else:
                        origin = fields.get("warc-segment-origin-id", name).strip("<>")
                        rows.append((origin, kind, *known, None, None, None, None, int(number), None if total is None else int(total), block))
                        size += len(block) + 300
                    if size > 8 << 20:
                        yield _batch(rows, len(_KINDS))
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, len(_KINDS))

    return run


def _joined(payloads: bool):
    """Segments (name, type, refers_to, stated, target, number, total, block), sorted by name and number, to facts of whole records."""

    def done(parts: list[tuple]) -> tuple:
        name, kind, refers_to, stated, target = parts[0][:5]
        block = b"".join(x[7] for x in parts)
        complete = [x[5] for x in parts] == list(range(1, len(parts) + 1)) and kind != "continuation"
        return _facts(name, kind, refers_to, stated, target, block, complete and parts[-1][6] == len(block), payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            out = []
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and record[0] != parts[0][0]:
                    out.append(done(parts))
                    parts = []
                parts.append(record)
            yield _batch(out, 9)
        if parts:
            yield _batch([done(parts)], 9)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``(name, type, refers_to, stated, target, payload, n, sha1, intact)`` per record, segments put together.

    ``n`` and ``sha1`` are the payload's length and digest. Without ``payloads`` those are null. What is parsed is written
    once, as both kinds of records are read from it.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    records = Scratch(spark, "records").keep(files.mapInArrow(_read(payloads), _RECORD), "records")
    facts = _NAMES[:9]
    pieces = records.filter("number is not null").select(*_NAMES[:5], "number", "total", "block")
    whole = pieces.repartition("name").sortWithinPartitions("name", "number").mapInArrow(_joined(payloads), _FACTS)
    return records.filter("number is null").select(*facts).unionByName(whole)


def _page(name: str):
    return F.expr(f"try_cast(split_part({name}, ':', 3) as bigint)")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = scratch.keep(
        read_archives(spark, path, payloads=False).select(
            _page("name").alias("page_id"), "type", _page("refers_to").alias("refers_to"), "stated", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "intact"
        ),
        "found",
    )
    responses = found.filter("type <> 'revisit'")
    originals = scratch.keep(
        responses.filter("page_id is not null and intact")
        .groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"))
        .agg(F.max("payload_bytes").alias("payload_bytes")),
        "originals",
    )
    revisits = (
        found.filter("type = 'revisit'")
        .select("page_id", "type", "refers_to", "stated", "intact")
        .join(originals.hint("merge"), ["refers_to", "stated"], "left")
        .withColumn("payload_digest", F.when(F.col("payload_bytes").isNotNull(), F.col("stated")))
        .withColumn("intact", F.col("intact") & F.col("payload_bytes").isNotNull())
    )
    return responses.unionByName(revisits.select(*responses.columns)).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < kept THEN kept END AS refers_to, TRUE AS intact
FROM k
"""
