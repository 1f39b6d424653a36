"""Malformed files: every table gives rows or an error, and the scan goes on to the next file."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.operators import views
from pagequarry.sources.document import Document, Kept
from pagequarry.sources.scan import MAKERS, ScanOptions, _weight, rows_of, scan
from pagequarry.testing import pdfwriter as P

BASE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>"}


def xref_stream(rows: bytes, index: bytes) -> bytes:
    head = b"%PDF-1.7\n1 0 obj <</Type /Catalog>> endobj\n"
    body = P.stream(rows, b"/Type /XRef /W [1 8 8] /Size 9 /Root 1 0 R /Index [" + index + b"]")
    return head + b"7 0 obj " + body + b" endobj\nstartxref\n%d\n%%%%EOF" % len(head)


def row(kind: int, a: int, b: int) -> bytes:
    return bytes([kind]) + a.to_bytes(8, "big") + b.to_bytes(8, "big")


HOSTILE = {
    "generation": bytes(P.Writer().classic({**BASE, 3: b"[5 99999999999999999999 R]"}).out),
    "digits": b"%PDF-1.7\n" + b"7" * 5_000 + b" 0 obj <<>> endobj\n1 0 obj <</Type /Catalog>> endobj",
    "columns": bytes(P.Writer().classic({**BASE, 3: P.stream(b"", b"/Filter /FlateDecode /DecodeParms <</Columns 99999999999>>")}).out),
    "row": bytes(P.Writer().classic({**BASE, 3: P.stream(b"", b"/Filter /LZWDecode /DecodeParms <</Predictor 15 /Columns 99999999999999>>")}).out),
    "section": b"%PDF-1.7\nxref\n9999999999999999990 3\n" + b"0000000000 00000 n \n" * 3 + b"trailer <</Root 1 0 R>>\nstartxref\n9\n%%EOF",
    "names": bytes(P.Writer().classic({**BASE, 3: b"<</A#FF (one) /A#FE (two) /Title (t)>>"}, b"/Root 1 0 R /Info 3 0 R").out),
    "stream generation": xref_stream(row(1, 9, 2**64 - 1) + row(1, 2**64 - 1, 0) + row(2, 2**64 - 1, 2**64 - 1), b"1 3"),
    "stream numbers": xref_stream(row(1, 9, 0), b"9223372036854775807 1"),
    "empty": b"",
    "nothing": None,
    "nesting": b"%PDF-1.7\n1 0 obj " + b"[" * 50_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_no_file_raises(name):
    for table in MAKERS:
        list(rows_of(table, HOSTILE[name], ScanOptions()))


def test_no_file_ends_a_job(spark):
    good = bytes(P.Writer().classic({**BASE, 3: b"<</Title (good)>>"}, b"/Root 1 0 R /Info 3 0 R").out)
    files = spark.createDataFrame([*HOSTILE.items(), ("good", good)], "doc_id string, content binary").coalesce(1)
    for table in MAKERS:
        rows = scan(files, table).collect()
        if table == "documents":
            assert {r["doc_id"] for r in rows} == {*HOSTILE, "good"}
        if table == "objects":
            assert {r["doc_id"] for r in rows} >= {"good", "generation", "columns"}
    info = {r["doc_id"]: r for r in views.document_info(files).collect()}
    assert info["good"]["title"] == "good" and info["names"]["custom"] == {"A�": "two"} and info["columns"]["title"] is None and "empty" not in info


def test_recovery_is_linear():
    began = time.perf_counter()
    for junk in (b"7" * 5_000_000, b"7 " * 1_000_000, b"1" + b" " * 3_000_000):
        doc = Document(b"%PDF-1.7\n" + junk + b"\n1 0 obj <</Type /Catalog>> endobj")
        assert doc.recovered and doc.catalog()["Type"] == "Catalog"
    assert time.perf_counter() - began < 6


def test_weights_and_cache():
    assert _weight((1, "ab", [b"abc", {"k": b"de", "n": None}], None)) == 7
    cache = Kept()
    for k in range(10):
        cache.keep(k, bytes(10 << 20), 10 << 20)
    assert list(cache) == [7, 8, 9] and cache.total == 30 << 20


def test_many_small_streams_take_linear_time():
    content = bytes(P.Writer().classic({**BASE, **{k: P.stream(b"x") for k in range(3, 8_000)}}).out)
    began = time.perf_counter()
    assert sum(1 for _ in rows_of("streams", content, ScanOptions())) == 7_997
    assert time.perf_counter() - began < 8


def test_a_page_that_names_one_stream_many_times_is_an_error():
    big = P.stream(zlib.compress(bytes(16 << 20)), b"/Filter /FlateDecode")
    page = b"<</Type /Page /Contents [" + b"4 0 R " * 2_000 + b"]>>"
    content = bytes(P.Writer().classic({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /Count 1>>", 3: page, 4: big}).out)
    (row,) = rows_of("page_spine", content, ScanOptions())
    assert row[-2] is None and "exceeds" in row[-1]
    (row,) = rows_of("content_ops", content, ScanOptions())
    assert "exceeds" in row[-1]


def test_packed_objects_that_overlap_are_bounded():
    body = b"[" + b"1 " * 20_000 + b"]"
    header = b" ".join(b"%d 0" % k for k in range(10, 10_010)) + b" "
    packed = P.stream(header + body, b"/Type /ObjStm /N 10000 /First %d" % len(header))
    head = b"%PDF-1.7\n1 0 obj <</Type /Catalog>> endobj\n"
    at = len(head)
    head += b"5 0 obj " + packed + b" endobj\n"
    rows = b"".join(bytes([2]) + (5).to_bytes(4, "big") + k.to_bytes(4, "big") for k in range(10_000)) + bytes([1]) + at.to_bytes(4, "big") + bytes(4)
    xref = P.stream(rows, b"/Type /XRef /W [1 4 4] /Size 20000 /Root 1 0 R /Index [10 10000 5 1]")
    content = head + b"7 0 obj " + xref + b" endobj\nstartxref\n%d\n%%%%EOF" % len(head)
    errors = [row[-1] for row in rows_of("objects", content, ScanOptions(max_stream=1 << 16, columns=("kind", "error")))]
    assert any(e and "overlap" in e for e in errors) and errors[1] is None


def test_utf16_with_and_without_surrogates(spark):
    texts = ["plain", "Ø and ü", "🙂", "中文", "", "ßØÜ" * 30_000, "ab🙂" * 500]
    rows = [(k, mark + t.encode(code)) for k, t in enumerate(texts) for mark, code in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))]
    got = spark.createDataFrame(rows, "k int, raw binary").select("k", T.decode_text(F.col("raw")).alias("t")).collect()
    assert all(r["t"] == texts[r["k"]] for r in got)
    lone = spark.createDataFrame([(b"\xfe\xff\x00a\xd8\x00\x00b",), (b"\xfe\xff\x00a\x00",)], "raw binary").select(T.decode_text(F.col("raw")).alias("t")).collect()
    assert [r["t"] for r in lone] == ["a�b", "a"]
