"""Deterministic, typed JSON snapshots of whole documents."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pagequarry.sources.document import Document, Stream
from pagequarry.sources.syntax import Name, PdfError, Ref

_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_UNPRINTABLE = re.compile(rb"[^\t\r\n\x20-\x7e]")
#: Bytes of document encoding that differ from Latin-1, as runs (fixed values).
DIACRITICS = "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc"
PUNCTUATION = "\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e"
UNDEFINED = [*range(0x01, 0x08), 0x0B, *range(0x0E, 0x18), 0x7F, 0x9F, 0xAD]


def document_encoding() -> dict[int, str]:
    """Characters of the bytes for which document encoding is not Latin-1."""
    out = {0x18 + k: c for k, c in enumerate(DIACRITICS)} | {0x80 + k: c for k, c in enumerate(PUNCTUATION)}
    return out | {0xA0: "\u20ac"} | dict.fromkeys(UNDEFINED, "\ufffd")


_ENCODING = document_encoding()


@dataclass(frozen=True)
class DumpOptions:
    """Bytes of decoded streams to show (-1: none), and whether to show all as hex."""

    preview: int = 80
    inline: bool = False


def decode_text(raw: bytes) -> str:
    """A text string by its byte order mark, or in document encoding."""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        body = raw[2 : len(raw) - len(raw) % 2]
        return body.decode("utf-16-be" if raw[0] == 0xFE else "utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1").translate(_ENCODING)


def looks_like_text(raw: bytes) -> bool:
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe") or raw[:3] == b"\xef\xbb\xbf":
        return True
    return not _CONTROL.search(raw) and "\ufffd" not in decode_text(raw)


def number_text(x: float) -> str:
    """Shortest form; exponents only below 1e-6 and from 1e21 on."""
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    mantissa, _, exponent = repr(x).lower().partition("e")
    if not 1e-6 <= abs(x) < 1e21:
        if not exponent:
            mantissa, _, exponent = f"{x:.17e}".partition("e") if float(f"{x:.16e}") != x else f"{x:.16e}".partition("e")
            mantissa = mantissa.rstrip("0")
        mantissa = mantissa.removesuffix(".0").removesuffix(".")
        return f"{mantissa}e{'-' if exponent[0] == '-' else '+'}{exponent.lstrip('+-').lstrip('0')}"
    if not exponent:
        return mantissa.removesuffix(".0")
    digits = mantissa.replace(".", "").lstrip("-")
    point = mantissa.lstrip("-").find(".") if "." in mantissa else len(digits)
    point += int(exponent)
    if point <= 0:
        plain = "0." + "0" * -point + digits
    else:
        plain = digits.ljust(point, "0")[:point] + ("." + digits[point:] if len(digits) > point and digits[point:].strip("0") else "")
    return "-" * (x < 0) + plain


def string_text(s: str) -> str:
    """A JSON string; bytes that were no UTF-8 are replaced, line separators escaped."""
    s = s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return json.dumps(s, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


class Literal(str):
    """Text that is JSON already."""


def tagged(doc: Document, value, options: DumpOptions):
    """A value as one-key objects that name its type."""
    if value is None:
        return {"null": None}
    if isinstance(value, bool):
        return {"bool": value}
    if isinstance(value, int):
        return {"int": value}
    if isinstance(value, float):
        return {"real": Literal(number_text(value))}
    if isinstance(value, Name):
        return {"name": str(value)}
    if isinstance(value, bytes):
        return {"text": decode_text(value)} if looks_like_text(value) else {"hex": value.hex()}
    if isinstance(value, Ref):
        return {"ref": f"{value.num} {value.gen}"}
    if isinstance(value, list):
        return {"array": [tagged(doc, v, options) for v in value]}
    if isinstance(value, Stream):
        return {"stream": tagged_stream(doc, value, options)}
    return {"dict": {k: tagged(doc, v, options) for k, v in value.items()}}


def tagged_stream(doc: Document, stream: Stream, options: DumpOptions) -> dict:
    out: dict = {"dict": tagged(doc, stream.dict, options)["dict"], "raw_length": stream.length}
    try:
        out["filters"] = doc.filters(stream.dict)[0]
    except PdfError as e:
        out["filters_error"] = str(e)
    try:
        data = doc.content(stream)
    except PdfError as e:
        out["decoded"] = {"error": str(e)}
        return out
    shown: dict = {"length": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    head = data[: options.preview] if options.preview > 0 else b""
    if head and not _UNPRINTABLE.search(head):
        shown["preview_utf8"] = head.decode() + "…" * (len(data) > options.preview)
    if options.inline:
        shown["hex"] = data.hex()
    out["decoded"] = shown
    return out


def to_json(value, indent: str | None = None, depth: int = 0) -> str:
    """JSON with keys in their order; indented by two spaces, or compact."""
    inner = "" if indent is None else "\n" + indent * (depth + 1)
    outer = "" if indent is None else "\n" + indent * depth
    if isinstance(value, Literal):
        return str(value)
    if isinstance(value, str):
        return string_text(value)
    if isinstance(value, dict):
        colon = ":" if indent is None else ": "
        parts = [string_text(k) + colon + to_json(v, indent, depth + 1) for k, v in value.items()]
        return "{" + ",".join(inner + p for p in parts) + outer + "}" if parts else "{}"
    if isinstance(value, list):
        return "[" + ",".join(inner + to_json(v, indent, depth + 1) for v in value) + outer + "]" if value else "[]"
    return json.dumps(value)


def dump(doc: Document, options: DumpOptions | None = None) -> str:
    """The snapshot of a document."""
    options = options or DumpOptions()
    out: dict = {"version": doc.version, "xref_format": doc.xref_format(), "encrypted": doc.handler is not None}
    out["trailer"] = tagged(doc, doc.trailer, options)
    out["objects"] = {f"{ref.num} {ref.gen}": tagged(doc, value, options) for ref, value, error in doc.objects() if error is None}
    return to_json(out, "  ") + "\n"
