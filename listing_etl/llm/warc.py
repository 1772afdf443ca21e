"""WARC archives: writing with segmentation, and segment reassembly on reading.

Writing: each page becomes a response record whose block is an HTTP message in chunked
transfer coding. A block of more than ``segment_bytes`` is cut: the record holds segment 1,
continuation records the others (WARC-Segment-Origin-ID, WARC-Segment-Number, and on the last
one WARC-Segment-Total-Length). Pages with a payload that another page has become revisit
records without a payload, which refer to the response of the page with the largest id. Rows are numbered when they
are staged, and the number is part of the record id, so that rows of one page id stay apart.
Spark's text writer stores the records (the two line ends behind a record are its line
separator) in compressed files of bounded size, on any file system that Spark writes to.

Reading: files are parsed by Content-Length; compressed ones are streamed, so that a task holds a
record, not a file. Segments are grouped by the id of their origin,
ordered by number and joined; numbers must run from 1 without gaps and the length must equal
the total. Then the HTTP message is taken apart, the chunked framing decoded, and the payload
checked against its digest. ``status`` is ``ok``, or tells what is wrong (``missing segment``,
``wrong length``, ``bad framing``, ``wrong digest``, ``missing origin``): such records are kept.

Edge cases: null pages have an empty payload; null and empty payloads are equal payloads like
any other; pages with a null id are responses (no record can refer to them) and keep no id;
repeated rows of one id are records of their own, responses or revisits alike; several equal segments of one number
count once; files compressed with gzip, one member or many, are read too; an empty table
gives no archive records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_etl.llm.common import prepare, slices, staged

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Records of a file at most: about 32 MB of full segments.
FILE_RECORDS = 1000
DATE = "2024-01-01T00:00:00Z"    # of the archive's records, unless given: results do not depend on the clock
_CRLF, _BLANK = b"\r\n", b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload in a chunked message body; null if the framing is broken."""
    at, out = 0, []
    while True:
        end = body.find(_CRLF, at)
        size = re.match(rb"[0-9a-fA-F]+", body[at:end].split(b";")[0].strip()) if end >= 0 else None
        if not size:
            return None
        n = int(size[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)                         # trailers are of no interest
        if len(body) < at + n + 2 or body[at + n:at + n + 2] != _CRLF:
            return None
        out.append(body[at:at + n])
        at += n + 2


def _header(fields: list[tuple[str, str]], length: int) -> bytes:
    clean = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{clean}Content-Length: {length}\r\n\r\n".encode()


def record_id(key: str | None, row: int) -> str:
    """Of the row with this number, of the page with this id."""
    return f"<urn:page:{key}:{row}>" if key is not None else f"<urn:row:{row}>"


def page_records(key: str | None, row: int, url: str | None, payload: bytes, refers: str | None, segment_bytes: int = SEGMENT_BYTES, date: str = DATE) -> list[bytes]:
    """The records of one page, without the line ends that follow each; ``refers``: the id of another's record."""
    me = record_id(key, row)
    common = [("WARC-Date", date), ("WARC-Target-URI", url or "")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    digest = ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")
    if refers is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", me), *common, digest, ("WARC-Refers-To", refers),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
        return [_header(fields, len(head)) + head]
    block = head + chunked(payload)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    kind = ("Content-Type", "application/http;msgtype=response")
    first = [("WARC-Type", "response"), ("WARC-Record-ID", me), *common, digest, kind]
    if len(parts) == 1:
        return [_header(first, len(block)) + block]
    out = [_header([*first, ("WARC-Segment-Number", "1")], len(parts[0])) + parts[0]]
    for n, p in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{n}>"), *common,
                  ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_header(fields, len(p)) + p)
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS, compression: str = "gzip") -> None:
    """Write WARC files of all pages under ``path``; ``compression``: of Spark's text writer (gzip or none)."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    # numbers and digests are written down once; payloads move once, by numbers, of which none is hot
    rows = staged(rows.withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id()), "pages", codec="zstd")
    own = rows.where(F.col("key").isNotNull()).select("key", "row", "digest")
    first = staged(own.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("first")), "payloads")
    refers = own.join(first, "digest").where(F.col("key") < F.col("first.key")).select(
        "row", F.format_string("<urn:page:%s:%d>", F.col("first.key").cast("string"), "first.row").alias("refers"))
    rows = rows.join(staged(refers, "refers"), "row", "left").select(F.col("key").cast("string").alias("key"), "row", "url", "payload", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            records = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in page_records(*row, segment_bytes=segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    text = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path, compression=compression)


def _head(data: bytes) -> dict[str, str] | None:
    """Header fields (names in lower case) of a record; null without a length."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return head if head.get("content-length", "").isdigit() else None


def stream_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a file, from what stands between its blank lines. What
    is no record is passed over; a block that the file ends in is cut."""
    head, size, block = None, 0, bytearray()
    for piece in pieces:
        while True:
            if head is None:
                at = piece.find(b"WARC/")
                head = _head(piece[at:]) if at >= 0 else None
                if head is None:
                    break
                size, block, started = int(head["content-length"]), bytearray(), False
                if size:
                    break
                piece = b""
            else:
                if started:
                    block += _BLANK
                block += piece
                started = True
                if len(block) < size:
                    break
                piece = bytes(block[size:])          # of no interest, unless the length was wrong
            yield head, bytes(block[:size])
            head = None
            if not piece:
                break
    if head is not None:
        if len(block) + len(_BLANK) == size:        # the line reader takes a last blank line as an end
            block += _BLANK
        yield head, bytes(block)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The same of a file in memory, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(_BLANK, at) if at >= 0 else -1
        if end < 0:
            return
        head = _head(data[at:end])
        if head is None:
            at = end + 4                                  # not a record: look on behind it
            continue
        size = int(head["content-length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size


_FIELDS = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
_RAW = "id string, type string, url string, digest string, refers string, origin string, segment int, total long, cut boolean, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path`` as they are, one row for each segment.

    Files that end in ``.gz`` are streamed through Spark's line reader, cut at blank lines; others
    are read whole, one at a time, and must fit into a task."""
    prepare(spark)
    names = [x.split()[0] for x in _RAW.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def rows_of(records: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for h, block in records:
            if h.get("warc-type") not in ("response", "revisit", "continuation", "resource"):
                continue
            n, total = h.get("warc-segment-number", ""), h.get("warc-segment-total-length", "")
            rows.append([*(h.get(f) for f in _FIELDS), h.get("warc-segment-origin-id"), int(n) if n.isdigit() else None,
                         int(total) if total.isdigit() else None, len(block) < int(h["content-length"]), block])
            size += len(block) + 500
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task reads one file after the other, each in order
        pieces = ((f, v.as_py()) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1)))
        for _, of_file in groupby(pieces, key=lambda x: x[0]):
            yield from rows_of(stream_records(v for _, v in of_file))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from rows_of(parse_records(data.as_py()))

    some = lambda r, glob: r.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    text = some(spark.read, "[!._]*.gz").option("lineSep", _BLANK.decode()).text(path)
    streamed = text.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(lines, _RAW)
    files = some(spark.read.format("binaryFile"), "[!._]*[!z]").load(path)
    return streamed.union(files.select("content").mapInArrow(whole, _RAW))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, type, url, digest, refers, total, segments, blocks) rows to whole payloads."""
    for b in slices(batches):
        out = []
        for id_, kind, url, digest, refers, total, cut, numbers, blocks in zip(*(c.to_pylist() for c in b.columns)):
            block, payload, status = b"".join(blocks), None, "ok"
            if id_ is None or kind is None:
                status = "missing origin"
            elif numbers != list(range(1, len(numbers) + 1)) or len(numbers) > 1 and total is None:
                status = "missing segment"
            elif cut or total is not None and total != len(block):
                status = "wrong length"
            elif kind != "revisit":
                head, mark, body = block.partition(b"\r\n\r\n")
                payload = body if mark and head.startswith(b"HTTP/") else block
                if mark and re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\s*$", head):
                    payload = unchunked(body)
                if payload is None:
                    status = "bad framing"
                elif digest and digest.rpartition(":")[2].upper() != payload_digest(payload):
                    status = "wrong digest"
            out.append((id_, kind, url, (digest or "").rpartition(":")[2] or None, refers, payload, status))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in list(zip(*out))[:5]), pa.array([r[5] for r in out], pa.binary()),
                                          pa.array([r[6] for r in out], pa.string())], names=["id", "type", "url", "digest", "refers", "payload", "status"])


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records of ``read_records`` rows: id, type, url, digest (bare), refers, payload, status."""
    is_part = F.col("segment").isNotNull() | (F.col("type") == "continuation")
    one = lambda c: F.array(F.col(c))
    whole = records.where(~is_part | is_part.isNull()).select("id", "type", "url", "digest", "refers", F.lit(None).cast("long").alias("total"),
                                                              "cut", F.array(F.lit(1)).alias("numbers"), one("block").alias("blocks"))
    begin = F.col("type") != "continuation"
    parts = records.where(is_part).groupBy(F.when(begin, F.col("id")).otherwise(F.col("origin")).alias("of")).agg(
        *(F.max(F.when(begin, F.col(c))).alias(c) for c in ("id", "type", "url", "digest", "refers")), F.max("total").alias("total"),
        F.max("cut").alias("cut"), F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"))
    joined = parts.select("id", "type", "url", "digest", "refers", "total", "cut", F.col("s.segment").alias("numbers"), F.col("s.block").alias("blocks"))
    return whole.union(joined).mapInArrow(_decoded, "id string, type string, url string, digest string, refers string, payload binary, status string")
