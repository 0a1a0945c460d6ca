"""WARC: records cut into segments are put together again, checked, and freed of chunked transfer framing."""

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read

#: Bytes of a chunk and of a segment's block in the records that are made of a page table.
CHUNK, SEGMENT = 1000, 4096
HEADER = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Of every DAMAGED pages, in the records that the query makes: one loses its second segment, one has two first ones that differ, one tells a wrong total length, one has no last chunk.
DAMAGED = 11
ORACLE = f"""
WITH sized AS (
  SELECT page_id, url, html, page_id % {DAMAGED} AS kind, octet_length(encode(html)) AS n FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL
), framed AS (
  SELECT *, {len(HEADER)} + n + n // {CHUNK} * {len(f"{CHUNK:x}") + 4} + CASE WHEN n % {CHUNK} = 0 THEN 0 ELSE length(to_hex(n % {CHUNK})) + 4 END + CASE WHEN kind = 3 THEN 0 ELSE 5 END AS block FROM sized
), cut AS (
  SELECT *, (block + {SEGMENT - 1}) // {SEGMENT} AS segments FROM framed
), said AS (
  SELECT *, CASE WHEN kind = 0 AND segments > 2 THEN 'missing_segment' WHEN kind = 0 AND segments = 2 THEN 'bad_chunks' WHEN kind = 1 THEN 'conflict'
    WHEN kind = 2 AND segments > 1 THEN 'wrong_length' WHEN kind = 3 THEN 'bad_chunks' ELSE 'complete' END AS status FROM cut
)
SELECT page_id, url AS target_uri, status, CASE WHEN status = 'complete' THEN n END AS body_bytes, CASE WHEN status = 'complete' THEN md5(html) END AS body_md5 FROM said
"""
RECORD = "record_id string, type string, target_uri string, segment_number long, segment_origin_id string, segment_total_length long, block binary"
_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("segment_number", pa.int64()), ("segment_origin_id", pa.string()), ("segment_total_length", pa.int64()), ("block", pa.binary())])
_WHOLE = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("status", pa.string()), ("segments", pa.int64()), ("block_bytes", pa.int64()), ("body", pa.binary())])
_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n")


_START = re.compile(rb"(?:(?<=\n)|\A)WARC/\d")


def unzipped(data: bytes) -> bytes:
    """The content of the gzip members of a file, one behind another; a member that is damaged gives what can be read of it. Other data stays as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts, at = [], 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        member, here = zlib.decompressobj(31), at
        try:
            while not member.eof and here < len(data):  # in pieces, so that what is behind the member isn't copied
                piece = data[here : here + 65_536]
                parts.append(member.decompress(piece))
                here += len(piece) - len(member.unused_data)
            at = max(here, at + 3)
        except zlib.error:
            at += 3
    return b"".join(parts)


def parse(data: bytes) -> list[dict]:
    """The records of a WARC file's content. A record with a broken header, or a block cut short by the end or by a wrong length, is left out; those behind it are found again where a line begins a record."""
    out, at = [], 0
    while m := _START.search(data, at):
        at = m.start()
        ends = [(e, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (e := data.find(mark, at)) >= 0]
        if not ends:
            break
        end, gap = min(ends)
        head: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").splitlines()[1:]:
            name, colon, value = line.partition(":")
            if colon:
                head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "")
        over = end + gap + int(size) if size.isascii() and size.isdigit() else -1
        if over < 0 or over > len(data) or data[over : over + 2] not in (b"\r\n", b"\n\n", b""):
            at += 5  # damaged: on to the next line that begins a record
            continue

        def number(name: str, head: dict = head) -> int | None:
            return int(head[name]) if head.get(name, "").isdigit() else None

        at = over
        out.append({
            "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "segment_number": number("warc-segment-number"),
            "segment_origin_id": head.get("warc-segment-origin-id"), "segment_total_length": number("warc-segment-total-length"), "block": data[end + gap : over],
        })
    return out


def render(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "segment_number": "WARC-Segment-Number", "segment_origin_id": "WARC-Segment-Origin-ID", "segment_total_length": "WARC-Segment-Total-Length"}
    head = [f"{name}: {record[key]}" for key, name in names.items() if record.get(key) is not None]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(record['block'])}", "", ""]).encode() + record["block"] + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as rows (RECORD), plain or of gzip members.

    A file is read by one task, as a value of 2 GB at most, so larger ones must be cut before. Records that are damaged are left out, those behind them are found again (see
    parse()); equal records stay as often as they stand there; empty files, and an empty folder's none, give no rows. Headers that a record lacks are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = parse(unzipped(content.as_py()))
                for a in range(0, len(found), 1000):
                    yield pa.RecordBatch.from_pylist(found[a : a + 1000], schema=_RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def chunked(body: bytes, size: int) -> bytes:
    """The body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[a : a + size] for a in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The body behind chunked transfer framing, without extensions and trailers; None if the framing is broken."""
    parts, at = [], 0
    while m := _CHUNK.match(framed, at):
        size, at = int(m.group(1), 16), m.end()
        if size == 0:
            return b"".join(parts)
        if at + size > len(framed):
            return None
        parts.append(framed[at : at + size])
        at += size
        for gap in (b"\r\n", b"\n"):
            if framed.startswith(gap, at):
                at += len(gap)
                break
        else:
            return None
    return None


def records_of(pages: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT, damaged: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) as a crawler would have stored them: chunked HTTP responses, cut into segments of `segment` bytes.

    With `damaged`, four of so many pages by their number are spoilt, each in another way (see DAMAGED). Null page_ids and htmls make no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            html = batch.column("html")
            for at, (page, url) in enumerate(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist())):
                kind = page % damaged if damaged else -1
                block = HEADER + chunked(html[at].as_buffer().to_pybytes(), chunk)
                block = block[:-5] if kind == 3 else block
                origin = f"<urn:page:{page}>"
                n = max(1, -(-len(block) // segment))
                for k in range(n):
                    if kind == 0 and k == 1:
                        continue
                    if kind == 1 and k == 0:
                        out.append((origin, "response", url, 1, None, None, b"another beginning"))
                    out.append((origin if k == 0 else f"<urn:page:{page}:{k + 1}>", "response" if k == 0 else "continuation", url, k + 1 if n > 1 else None, None if k == 0 else origin, len(block) + (kind == 2) if k == n - 1 and n > 1 else None, block[k * segment : (k + 1) * segment]))
                size += len(block)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RECORD)], schema=_RECORD)

    use = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").where("page_id is not null and html is not null")
    return use.mapInArrow(run, RECORD)


def _body(block: bytes) -> tuple[str, bytes | None]:
    """(status, body) of a whole block: that of a HTTP message behind its header, else the block itself."""
    if not block.startswith(b"HTTP/"):
        return "complete", block
    ends = [(e, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (e := block.find(mark)) >= 0]
    if not ends:
        return "bad_header", None
    end, gap = min(ends)
    body = block[end + gap :]
    coding = [v.split(b":", 1)[1].strip().lower() for v in block[:end].splitlines()[1:] if v.lower().startswith(b"transfer-encoding:")]
    if not any(v.endswith(b"chunked") for v in coding):
        return "complete", body
    plain = unchunked(body)
    return ("complete", plain) if plain is not None else ("bad_chunks", None)


def _put_together(rows: list[tuple]) -> tuple:
    """Of the segments (record_id, target_uri, number, total, block) of one origin, in order: a row of _WHOLE."""
    origin, parts, status, uri, total = rows[0][0], {}, "", None, None
    for _, url, number, length, block in rows:
        uri = uri if uri is not None else url
        if number in parts and parts[number] != block:
            status = "conflict"
        parts.setdefault(number, block)
        if length is not None:
            status = "conflict" if total not in (None, length) else status
            total = length
    whole = b"".join(parts[k] for k in sorted(parts))
    last = max(parts)
    if not status:
        if sorted(parts) != list(range(1, last + 1)):
            status = "missing_segment"
        elif total is None and last > 1:
            status = "no_last_segment"
        elif total is not None and total != len(whole):
            status = "wrong_length"
    body = None
    if not status:
        status, body = _body(whole)
    return origin, uri, status, len(parts), len(whole), body


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    origin, rows, out, size = None, [], [], 0

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _WHOLE)], schema=_WHOLE)

    for batch in batches:
        block = batch.column("block")
        for at, head in enumerate(zip(*(batch.column(c).to_pylist() for c in ("origin", "target_uri", "number", "segment_total_length")))):
            row = (*head, block[at].as_py())
            if row[0] != origin:
                if rows:
                    out.append(_put_together(rows))
                    size += out[-1][4]
                    if size > 4_000_000:
                        yield batch_of(out)
                        out, size = [], 0
                origin, rows = row[0], []
            rows.append(row)
    if rows:
        out.append(_put_together(rows))
    if out:
        yield batch_of(out)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, status, segments, block_bytes, body) of every record, its segments put together.

    records has the columns of RECORD; others are ignored. Continuations are grouped by their origin's id and ordered by number;
    a record without a number is its own first segment. status is 'complete', or says why there is no body: 'missing_segment',
    'no_last_segment' (none tells the total length), 'wrong_length', 'conflict' (segments of one number, or total lengths, differ: the least block of each number is counted then), 'bad_header' or
    'bad_chunks'. Segments that are there twice alike count once. The body of a HTTP response comes without header and chunked
    framing, any other block whole. Rows without an id for their group have no place and are left out, null blocks are
    empty ones; a null number of a continuation is taken as 0, which no record has. An empty table gives no rows. One record must fit into a task's memory; a partition needn't.
    """
    origin: Column = F.when(F.lower("type") == "continuation", F.col("segment_origin_id")).otherwise(F.col("record_id"))
    number = F.coalesce("segment_number", F.when(F.lower("type") == "continuation", 0).otherwise(1)).cast("long")
    rows = records.select(origin.alias("origin"), "target_uri", number.alias("number"), F.col("segment_total_length").cast("long").alias("segment_total_length"), F.coalesce("block", F.lit(b"")).alias("block")).where("origin is not null")
    return rows.repartition("origin").sortWithinPartitions("origin", "number", "block", "target_uri", "segment_total_length").mapInArrow(_stream, "record_id string, target_uri string, status string, segments long, block_bytes long, body binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = reassembled(records_of(read(spark, sf_dir, "pages"), damaged=DAMAGED))
    return done.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("long").alias("page_id"), "target_uri", "status", F.octet_length("body").cast("long").alias("body_bytes"), F.md5("body").alias("body_md5"))
