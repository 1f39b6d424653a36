"""Whole snapshots of five small files, letter by letter, with known lengths and hashes."""

import json
import zlib

import pytest

from pagequarry.operators.dump import dump
from pagequarry.sources.document import Document
from pagequarry.testing import pdfwriter as P

CATALOG = b"<</Type /Catalog /Pages 2 0 R>>"
EMPTY = b"<</Type /Pages /Count 0 /Kids []>>"


def name(s: str) -> dict:
    return {"name": s}


def ref(num: int) -> dict:
    return {"ref": f"{num} 0"}


def ints(*values: int) -> dict:
    return {"array": [{"int": v} for v in values]}


def kids(*nums: int) -> dict:
    return {"array": [ref(n) for n in nums]}


def entries(**of: dict) -> dict:
    return {"dict": of}


def snapshot(objects: dict, trailer: dict, version: str = "1.7", xref_format: str = "classical") -> dict:
    given = {"1 0": entries(Type=name("Catalog"), Pages=ref(2))} | {f"{n} 0": v for n, v in objects.items()}
    return {"version": version, "xref_format": xref_format, "encrypted": False, "trailer": {"dict": trailer}, "objects": given}


def tree(n: int, *children: int, **more: dict) -> dict:
    return entries(Type=name("Pages"), Count={"int": n}, Kids=kids(*children), **more)


def raw_stream(length: int, sha256: str, preview: str) -> dict:
    decoded = {"length": length, "sha256": sha256, "preview_utf8": preview}
    return {"stream": {"dict": {"Length": {"int": length}}, "raw_length": length, "filters": [], "decoded": decoded}}


def one_page() -> tuple[bytes, dict]:
    pages = {1: CATALOG, 2: b"<</Type /Pages /Count 1 /Kids [3 0 R]>>", 3: b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792]>>"}
    data = P.Writer().classic({**pages, 4: b"<</Title (Hello) /Producer (own writer)>>"}, b"/Root 1 0 R /Info 4 0 R").out
    page = entries(Type=name("Page"), Parent=ref(2), MediaBox=ints(0, 0, 612, 792))
    info = entries(Title={"text": "Hello"}, Producer={"text": "own writer"})
    return data, snapshot({2: tree(1, 3), 3: page, 4: info}, {"Size": {"int": 5}, "Root": ref(1), "Info": ref(4)})


def section_stream() -> tuple[bytes, dict]:
    """A cross-reference stream that does not list itself."""
    out, places = b"%PDF-2.0\n" + P.BINARY_MARK, []
    for num, body in enumerate([CATALOG, EMPTY], 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
    rows = b"\0\0\0\0\xff" + b"".join(b"\1" + p.to_bytes(3, "big") + b"\0" for p in places)
    packed = zlib.compress(rows)
    body = b"<</Type /XRef /Size 3 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream" % (len(packed), packed)
    out += b"3 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (body, len(out))
    trailer = {"Type": name("XRef"), "Size": {"int": 3}, "W": ints(1, 3, 1), "Root": ref(1), "Filter": name("FlateDecode"), "Length": {"int": len(packed)}}
    return out, snapshot({2: tree(0)}, trailer, "2.0", "stream")


def flate_stream() -> tuple[bytes, dict]:
    packed = zlib.compress(b"Hello, stream!")
    body = b"<</Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream" % (len(packed), packed)
    decoded = {"length": 14, "sha256": "4ac9a1927af81c4e7cd1b812848d3fdac958b613e4754a88af93b308df4ac7df", "preview_utf8": "Hello, stream!"}
    shown = {"dict": {"Length": {"int": len(packed)}, "Filter": name("FlateDecode")}, "raw_length": len(packed), "filters": ["FlateDecode"], "decoded": decoded}
    return P.Writer().classic({1: CATALOG, 2: EMPTY, 3: body}).out, snapshot({2: tree(0), 3: {"stream": shown}}, {"Size": {"int": 4}, "Root": ref(1)})


def inherited() -> tuple[bytes, dict]:
    objects = {
        1: CATALOG,
        2: b"<</Type /Pages /Count 2 /Kids [3 0 R] /MediaBox [0 0 612 792] /Resources <</Font <</F1 6 0 R>>>> /Rotate 90>>",
        3: b"<</Type /Pages /Count 2 /Parent 2 0 R /Kids [4 0 R 5 0 R] /CropBox [10 10 602 782]>>",
        4: b"<</Type /Page /Parent 3 0 R>>",
        5: b"<</Type /Page /Parent 3 0 R /MediaBox [0 0 200 200] /Rotate 0>>",
        6: b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica>>",
    }
    expected = {
        2: tree(2, 3, MediaBox=ints(0, 0, 612, 792), Resources=entries(Font=entries(F1=ref(6))), Rotate={"int": 90}),
        3: entries(Type=name("Pages"), Count={"int": 2}, Parent=ref(2), Kids=kids(4, 5), CropBox=ints(10, 10, 602, 782)),
        4: entries(Type=name("Page"), Parent=ref(3)),
        5: entries(Type=name("Page"), Parent=ref(3), MediaBox=ints(0, 0, 200, 200), Rotate={"int": 0}),
        6: entries(Type=name("Font"), Subtype=name("Type1"), BaseFont=name("Helvetica")),
    }
    return P.Writer().classic(objects).out, snapshot(expected, {"Size": {"int": 7}, "Root": ref(1)})


def several_contents() -> tuple[bytes, dict]:
    first, second = b"q 1 0 0 1 50 50 cm", b"BT /F1 12 Tf (Hello) Tj ET"
    page = b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 200 200] /Contents [4 0 R 5 0 R]>>"
    data = P.Writer().classic({1: CATALOG, 2: b"<</Type /Pages /Count 1 /Kids [3 0 R]>>", 3: page, 4: P.stream(first), 5: P.stream(second)}).out
    expected = {
        2: tree(1, 3),
        3: entries(Type=name("Page"), Parent=ref(2), MediaBox=ints(0, 0, 200, 200), Contents=kids(4, 5)),
        4: raw_stream(18, "ac399976dc867824f50e13f5f86d9f5b9be76d49ae538a01d7567552914e9f80", first.decode()),
        5: raw_stream(26, "9dd85240377330fc34370ec0a297930e7cba5a30efbaab71f21337dbfc1d864e", second.decode()),
    }
    return data, snapshot(expected, {"Size": {"int": 6}, "Root": ref(1)})


@pytest.mark.parametrize("build", [one_page, section_stream, flate_stream, inherited, several_contents])
def test_snapshots(build):
    data, expected = build()
    doc = Document(data)
    assert not doc.recovered
    assert dump(doc) == json.dumps(expected, indent=2, ensure_ascii=False) + "\n"
