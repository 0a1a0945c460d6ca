import gzip

from tessera.llm import warc
from tests.llm.tools import rows


def segment(rid, kind, number, origin, total, block, uri="u"):
    return (rid, kind, uri, number, origin, total, block)


def test_reassembly(spark):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello wide world", 5)
    a, b, c = http[:20], http[20:45], http[45:]
    broken = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc"
    given = [
        segment("r1", "response", 1, None, None, a), segment("r1c", "continuation", 3, "r1", len(http), c, None), segment("r1b", "continuation", 2, "r1", None, b, None),
        segment("r1b", "continuation", 2, "r1", None, b, None),  # there twice
        segment("r2", "response", 1, None, None, a), segment("r2c", "continuation", 3, "r2", len(http), c),
        segment("r3", "response", 1, None, None, a), segment("r3b", "continuation", 2, "r3", 7, b),
        segment("r4", "response", 1, None, None, a), segment("r4b", "continuation", 2, "r4", None, b),
        segment("r5", "response", None, None, None, broken), segment("r6", "metadata", None, None, None, b"plain"),
        segment("r7", "response", 1, None, None, b"x"), segment("r7b", "continuation", 1, "r7", None, b"y"),
        segment("r8", "response", None, None, None, None), segment("r9", "response", None, None, None, b"HTTP/1.1 200 OK"),
        segment(None, "response", None, None, None, b"lost"), segment("x", "continuation", 2, None, None, b"lost"), segment("y", "continuation", None, "ghost", None, b"z"),
    ]
    records = spark.createDataFrame(given, warc.RECORD).selectExpr("*", "1 as origin", "2 as number", "'x' as status")
    done = {r["record_id"]: (r["status"], bytes(r["body"]) if r["body"] is not None else None) for r in warc.reassembled(records).collect()}
    assert done == {
        "r1": ("complete", b"hello wide world"), "r2": ("missing_segment", None), "r3": ("wrong_length", None), "r4": ("no_last_segment", None), "r5": ("bad_chunks", None),
        "r6": ("complete", b"plain"), "r7": ("conflict", None), "r8": ("complete", b""), "r9": ("bad_header", None), "ghost": ("missing_segment", None),
    }
    assert rows(warc.reassembled(records.where("false"))) == []


def test_chunks():
    assert warc.unchunked(b"5;x=1\r\nabcde\r\n0\r\nTrailer: t\r\n\r\n") == b"abcde"
    assert warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"3\r\nabc") is None
    for body in (b"", b"x", b"a\r\n" * 5000):
        assert warc.unchunked(warc.chunked(body, 7)) == body


def test_files(spark, tmp_path):
    made = [{"record_id": "a", "type": "response", "target_uri": "u", "segment_number": 1, "segment_origin_id": None, "segment_total_length": None, "block": b"one\r\n\r\n"}, {"record_id": "b", "type": "continuation", "target_uri": None, "segment_number": 2, "segment_origin_id": "a", "segment_total_length": 10, "block": b"two"}]
    (tmp_path / "x.warc").write_bytes(b"".join(map(warc.render, made)) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    done = warc.reassembled(warc.read_warc(spark, str(tmp_path / "x.warc"))).collect()
    assert [(r["status"], bytes(r["body"]), r["segments"]) for r in done] == [("complete", b"one\r\n\r\ntwo", 2)]


def test_damaged_and_zipped_files(spark, tmp_path):
    made = [{"record_id": f"r{k}", "type": "resource", "target_uri": f"u{k}", "segment_number": None, "segment_origin_id": None, "segment_total_length": None, "block": b"body %d WARC/1.1 within" % k} for k in range(6)]
    raw = list(map(warc.render, made))
    raw[1] = raw[1].replace(b"Content-Length: ", b"Content-Length: x")
    raw[3] = raw[3].replace(b"Content-Length: ", b"Content-Length: 9")
    assert [r["record_id"] for r in warc.parse(b"".join(raw))] == ["r0", "r2", "r4", "r5"]
    zipped = [gzip.compress(warc.render(r)) for r in made]
    assert [r["block"] for r in warc.parse(warc.unzipped(b"".join(zipped)))] == [r["block"] for r in made]
    zipped[2] = zipped[2][:12] + b"\xff" * 30 + zipped[2][42:]
    left = [r["record_id"] for r in warc.parse(warc.unzipped(b"".join(zipped)))]
    assert left[:2] == ["r0", "r1"] and left[-3:] == ["r3", "r4", "r5"]
    (tmp_path / "z.warc.gz").write_bytes(b"".join(gzip.compress(warc.render(r)) for r in made))
    (tmp_path / "empty.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path)).count() == 6


def test_conflicts_have_one_result(spark):
    given = [segment("a", "response", 1, None, None, b"y", "v"), segment("a", "response", 1, None, None, b"xx", "u"), segment("a2", "continuation", 2, "a", 9, b"z")]
    seen = {tuple(warc.reassembled(spark.createDataFrame(order, warc.RECORD)).first()) for order in (given, given[::-1])}
    assert seen == {("a", "u", "conflict", 2, 3, None)}


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 9000), (2, "u", ""), (3, None, "x"), (None, "u", "x"), (4, "u", None)], "page_id long, url string, html string")
    done = {r["record_id"]: r["body"] for r in warc.reassembled(warc.records_of(pages)).collect()}
    assert {k: bytes(v).decode() for k, v in done.items()} == {"<urn:page:1>": "é" * 9000, "<urn:page:2>": "", "<urn:page:3>": "x"}
