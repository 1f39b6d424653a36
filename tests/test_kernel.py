"""The per-file kernel: tokens, values, codecs, encryption, sections, trees."""

import base64
import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.operators.dump import DumpOptions, decode_text, dump, looks_like_text, number_text
from pagequarry.sources import codecs, security
from pagequarry.sources.codecs import Params
from pagequarry.sources.content import operations
from pagequarry.sources.document import Document, Stream
from pagequarry.sources.scan import MAKERS, ScanOptions, rows_of
from pagequarry.sources.syntax import Name, PdfError, Ref, Tokens, parse_value
from pagequarry.testing import pdfwriter as P

BASE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>"}


def value(text: bytes):
    return parse_value(Tokens(text))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (b"42", 42), (b"-7", -7), (b"+3", 3), (b".5", 0.5), (b"4.", 4.0), (b"true", True), (b"null", None),
        (b"/A#20B", Name("A B")), (b"/", Name("")), (b"(a(b)c)", b"a(b)c"), (rb"(\101\n\q\\)", b"A\nq\\"), (b"(a\\\r\nb\rc\r\nd)", b"ab\nc\nd"),
        (b"(\\400)", b"\0"), (b"(\\18)", b"\x018"), (b"<4 8 6>", b"H`"), (b"<>", b""), (b"[1 2 R 3 0 R]", None), (b"1 0 R", Ref(1, 0)), (b"1 0 Rx", 1),
        (b"<</A 1/B 2/A 3>>", {"A": 3, "B": 2}), (b"[[][<<>>]]", [[], [{}]]), (b"% note\n7", 7), (b"1e5", 1),
    ],
)
def test_values(text, expected):
    if text == b"[1 2 R 3 0 R]":
        assert value(text) == [Ref(1, 2), Ref(3, 0)]
        return
    got = value(text)
    assert got == expected and type(got) is type(expected)


@pytest.mark.parametrize("text", [b"", b"(", b"<4", b"<4g>", b"/A#4", b"/A#zz", b">", b")", b"{", b"[", b"[1", b"<<", b"<</A", b"<<1 2>>", b"]", b"<</A>>", b"1.2.3", b"-", b"99999999999999999999", b"foo", b"[<<]>>"])
def test_bad_values(text):
    with pytest.raises(PdfError):
        value(text)


def test_order_of_keys_and_nesting_cap():
    assert list(value(b"<</A 1/B 2/A 3>>")) == ["A", "B"]
    assert value(b"[" * 1000 + b"]" * 1000) is not None
    with pytest.raises(PdfError):
        value(b"[" * 1001 + b"]" * 1001)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_codec_round_trips(data):
    no = Params()
    assert codecs.decode("Fl", zlib.compress(data), no, 0) == data
    assert codecs.decode("A85", base64.a85encode(data, adobe=True), no, 0) == data
    assert codecs.decode("AHx", data.hex().encode() + b">", no, 0) == data
    assert codecs.decode("RL", P.run_length(data), no, 0) == data
    assert codecs.decode("LZW", P.lzw(data), no, 0) == data
    padded = data + b"\0" * (-len(data) % 7)
    assert codecs.decode("FlateDecode", zlib.compress(P.png_rows(data, 7)), Params(predictor=12, columns=7), 0) == padded


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300))
def test_nothing_but_pdf_errors(data):
    for name in ("Fl", "LZW", "A85", "AHx", "RL"):
        try:
            codecs.decode(name, data, Params(predictor=15, columns=3), 1000)
        except PdfError:
            pass
    try:
        list(operations(data))
    except PdfError:
        pass
    for table in MAKERS:
        list(rows_of(table, b"%PDF-1.7\n" + data, ScanOptions()))
        list(rows_of(table, P.Writer().classic({**BASE, 3: b"[" + data + b"]"}).out, ScanOptions()))


def test_codec_vectors():
    no = Params()
    assert codecs.decode("RunLengthDecode", bytes([2]) + b"ABC" + bytes([254]) + b"X" + bytes([128]), no, 0) == b"ABCXXX"
    assert codecs.decode("LZWDecode", bytes.fromhex("2090a020"), no, 0) == b"AB"
    assert codecs.decode("ASCII85Decode", b"z", no, 0) == bytes(4)
    assert codecs.decode("AHx", b"4 8 6>zz", no, 0) == b"H`"
    assert codecs.unpredict(bytes([1, 2, 3, 4]), Params(predictor=2, columns=4)) == bytes([1, 3, 6, 10])
    long = bytes(range(256)) * 40
    assert codecs.decode("LZW", P.lzw(long), no, 0) == long
    assert codecs.decode("LZW", P.lzw(long, early=0), Params(early_change=False), 0) == long


@pytest.mark.parametrize(
    ("name", "data", "params"),
    [
        ("Fl", b"no", Params()), ("Fl", zlib.compress(b"x" * 99)[:-6], Params()), ("A85", b"a\x7f", Params()), ("A85", b"aaz", Params()), ("AHx", b"4g", Params()),
        ("RL", b"\x05ab", Params()), ("RL", b"\xfe", Params()), ("DCTDecode", b"", Params()), ("Nope", b"", Params()),
        ("Fl", zlib.compress(b"abc"), Params(predictor=12, columns=5)), ("Fl", zlib.compress(b"\x09a"), Params(predictor=12, columns=1)), ("Fl", zlib.compress(b"a"), Params(predictor=2, columns=-1)),
    ],
)
def test_codec_errors(name, data, params):
    with pytest.raises(PdfError):
        codecs.decode(name, data, params, 0)


def test_output_cap():
    packed = zlib.compress(b"x" * 5000)
    assert len(codecs.decode("Fl", packed, Params(), 5000)) == 5000
    for name, data in (("Fl", packed), ("LZW", P.lzw(b"x" * 5000)), ("RL", P.run_length(b"x" * 5000))):
        with pytest.raises(PdfError):
            codecs.decode(name, data, Params(), 4999)


def test_aes_and_rc4_vectors():
    # published vectors of the ciphers
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert security.cbc_encrypt(bytes(range(16)), bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert security.cbc_encrypt(bytes(range(32)), bytes(16), block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert security.cbc_decrypt(bytes(range(32)), bytes(16), bytes.fromhex("8ea2b7ca516745bfeafc49904b496089")) == block
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    with pytest.raises(PdfError):
        security.aes_stream(bytes(16), b"short")


@pytest.mark.parametrize("method", ["V2", "V2F", "AESV2", "AESV3"])
def test_encrypted_streams(method):
    doc = Document(P.encrypted(b"secret text", method, b"7"))
    assert doc.content(doc.resolve(Ref(3, 0))) == b"secret text"


def test_revision_six_password_hash():
    user = b"u" * 0
    salt, extra = b"12345678", b""
    got = security.hash_v5(user, salt, extra, 6)
    assert len(got) == 32 and got == security.hash_v5(user, salt, extra, 6) != security.hash_v5(user, b"12345679", extra, 6)


@pytest.mark.parametrize("length", [b"256", b"4096", b"-8"])
def test_hostile_key_lengths(length):
    data = P.encrypted(b"x", "V2", b"1").replace(b"/Length 128", b"/Length " + length)
    assert list(rows_of("documents", data, ScanOptions()))[0][-1] is not None


def test_sections_and_precedence():
    w = P.Writer().classic({**BASE, 5: b"(old)", 6: b"(kept)"}, b"/Root 1 0 R /Info 6 0 R").classic({5: b"(new)"})
    doc = Document(w.out)
    assert (doc.resolve(Ref(5, 0)), doc.resolve(Ref(6, 0)), doc.trailer["Info"]) == (b"new", b"kept", Ref(6, 0))
    assert doc.resolve(Ref(99, 0)) is None and not doc.recovered
    packed = Document(P.Writer().packed({}, {**BASE, **{n: b"%d" % n for n in range(10, 5010)}}).out)
    assert packed.resolve(Ref(5009, 0)) == 5009 and packed.xref_format() == "stream"


def test_recovery_keeps_the_first_copy():
    body = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n5 0 obj (a) endobj\n5 0 obj (b) endobj\n"
    doc = Document(body)
    assert doc.recovered and doc.resolve(Ref(5, 0)) == b"a" and doc.trailer == {"Root": Ref(1, 0)}


def test_loops_are_errors():
    w = P.Writer().classic(BASE)
    looped = w.out.replace(b"/Root 1 0 R>>", b"/Root 1 0 R /Prev %d>>" % w.last)
    with pytest.raises(PdfError):
        Document(looped)
    doc = Document(P.Writer().classic({**BASE, 5: b"<</Length 5 0 R>>\nstream\nx\nendstream"}).out)
    with pytest.raises(PdfError):
        doc.resolve(Ref(5, 0))


def test_page_tree_rules():
    objects = {
        1: BASE[1], 2: b"<</Type /Pages /Kids [3 0 R 4 0 R 3 0 R 2 0 R 9 0 R 6 0 R] /Rotate 90>>", 3: b"<</Type /Page /Parent 2 0 R>>",
        4: b"<</Kids [5 0 R 4 0 R] /Parent 2 0 R>>", 5: b"<</Parent 4 0 R>>", 6: b"<</Type /Pages>>",
    }
    doc = Document(P.Writer().classic(objects).out)
    assert [ref.num for ref, _ in doc.pages()] == [3, 5]
    assert [len(list(doc.chain(own))) for _, own in doc.pages()] == [2, 3]


def test_attachments_kids_before_names():
    objects = {
        1: b"<</Type /Catalog /Pages 2 0 R /Names <</EmbeddedFiles 3 0 R>>>>", 2: BASE[2], 3: b"<</Kids [4 0 R 3 0 R 4 0 R] /Names [(b) 5 0 R 7 5 0 R (c) null]>>",
        4: b"<</Names [(a) 5 0 R]>>", 5: b"<<>>",
    }
    doc = Document(P.Writer().classic(objects).out)
    # object 3 is reached again through its own kids, as the root is not known by its reference
    assert [n for n, _, _ in doc.attachments()][0] == b"a" and {n for n, _, _ in doc.attachments()} == {b"a", b"b"}


def test_content_operations():
    ops = list(operations(b"q 1 0 0 1 5 5 cm /F1 12 Tf [(A) -120 <42>] TJ /P <</MCID 3>> BDC BI /W 2 ID xEI y\nEI Q 1 2"))
    assert [o.operator for o in ops] == ["q", "cm", "Tf", "TJ", "BDC", "EI", "Q"]
    assert [x.value for x in ops[3].operands[0].value] == [b"A", -120.0, b"B"]
    assert ops[4].operands[1].value["MCID"].literal == "3" and ops[5].image == b"xEI y" and ops[5].operands[0].value["W"].value == 2.0
    assert list(operations(b"1.2.3 - x"))[0].operands[0].value == 0.0
    with pytest.raises(PdfError):
        list(operations(b"1 " * 100_002 + b"x"))


def test_text_and_numbers():
    assert decode_text(b"A\x18\x80\xa0\xe9\x7f\x9f") == "A˘•€\xe9��"
    assert decode_text(b"\xfe\xff\xd8\x3d\xde\x00\x00") == "\U0001f600" and decode_text(b"\xff\xfeA\0") == "A"
    assert [looks_like_text(x) for x in (b"a\n", b"\x01", b"\x7f", b"\xe9", b"\x9f", b"\xfe\xff\x00")] == [True, False, False, True, False, True]
    assert [number_text(x) for x in (1.0, 1e-6, 1.5e-7, 1e21, 1e20, -2.5e-5)] == ["1", "0.000001", "1.5e-7", "1e+21", "100000000000000000000", "-0.000025"]


def test_dump():
    body = b"Hello, stream!"
    doc = Document(P.one_stream(P.stream(zlib.compress(body), b"/Filter /FlateDecode")))
    text = dump(doc, DumpOptions(inline=True))
    assert text.startswith('{\n  "version": "1.7",\n  "xref_format": "classical",\n  "encrypted": false,\n  "trailer": {\n    "dict": {\n')
    assert f'"sha256": "{hashlib.sha256(body).hexdigest()}"' in text and '"preview_utf8": "Hello, stream!"' in text and body.hex() in text
    assert isinstance(doc.resolve(Ref(3, 0)), Stream) and text.endswith("}\n")


@pytest.mark.parametrize("content", [None, b"", b"junk", b"%PDF-1.7", b"%PDF-1.7\nxref\n0 1\ntrailer", b"\0" * 2000, b"%PDF-1.4\n1 0 obj\n<<"])
def test_hostile_files_give_error_rows(content):
    rows = list(rows_of("documents", content, ScanOptions()))
    assert len(rows) == 1 and rows[0][-1]
    assert all(not list(rows_of(t, content, ScanOptions())) for t in MAKERS if t != "documents")
