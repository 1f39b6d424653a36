"""Stream codecs: Flate, LZW, ASCII85, ASCIIHex, RunLength, and predictors."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

from pagequarry.sources.syntax import PdfError

#: Names of filters and their abbreviations (fixed values).
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode"}
#: Filters whose output is an image and which are not decoded (fixed values).
IMAGE_FILTERS = frozenset(["DCTDecode", "DCT", "JBIG2Decode", "JPXDecode", "CCITTFaxDecode", "CCF", "Crypt"])


@dataclass(frozen=True)
class Params:
    predictor: int = 0
    columns: int = 0
    colors: int = 0
    bits: int = 0
    early_change: bool = True


def _within(size: int, most: int) -> None:
    if 0 < most < size:
        raise PdfError(f"decoded output exceeds limit of {most} bytes")


def flate(data: bytes, p: Params, most: int) -> bytes:
    machine, out, size = zlib.decompressobj(), [], 0
    try:
        while not machine.eof:
            part = machine.decompress(data, most + 1 - size) if most > 0 else machine.decompress(data)
            out.append(part)
            size += len(part)
            _within(size, most)
            data = machine.unconsumed_tail
            if not machine.eof and not data and not part:
                raise PdfError("FlateDecode: unexpected end")
            if not machine.eof and not data:
                data = b""
    except zlib.error as e:
        raise PdfError(f"FlateDecode: {e}") from None
    return unpredict(b"".join(out), p) if p.predictor > 1 else b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    digits = data.split(b">", 1)[0].translate(None, b" \t\r\n\x0c")
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise PdfError("ASCIIHexDecode: bad digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    body = data.removeprefix(b"<~").split(b"~>", 1)[0].translate(None, b" \t\r\n\x0c")
    if bad := re.search(rb"[^!-uz]", body):
        raise PdfError(f"ASCII85Decode: bad byte 0x{bad[0][0]:02x}")
    # z stands for four zero bytes, but only between groups of five
    runs = body.split(b"z")
    if any(len(r) % 5 for r in runs[:-1]):
        raise PdfError("ASCII85Decode: z inside a group")
    cut = -len(runs[-1]) % 5
    digits = np.frombuffer(b"!!!!!".join(runs) + b"u" * cut, np.uint8).reshape(-1, 5).astype(np.uint64) - 33
    groups = digits @ np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)
    out = (groups & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()
    return out[: len(out) - cut] if cut else out


def run_length(data: bytes, most: int) -> bytes:
    out, at, size = [], 0, 0
    while at < len(data):
        head = data[at]
        if head == 128:
            break
        part = data[at + 1 : at + 2 + head] if head < 128 else data[at + 1 : at + 2] * (257 - head)
        if len(part) < (head + 1 if head < 128 else 1):
            raise PdfError("RunLengthDecode: truncated")
        at += 2 + head if head < 128 else 2
        out.append(part)
        size += len(part)
        _within(size, most)
    return b"".join(out)


def lzw(data: bytes, p: Params, most: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; a missing end code is fine."""
    base = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, held, have = list(base), 9, 0, 0
    out, size, last, at = [], 0, None, 0
    while True:
        while have < width and at < len(data):
            held, have, at = held << 8 | data[at], have + 8, at + 1
        if not have:
            break
        if have < width:  # a trailing partial code is filled up with zeros
            short = -(-(width - have) // 8) * 8
            held, have = held << short, have + short
        have -= width
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise PdfError(f"LZWDecode: invalid code {code}")
        out.append(entry)
        size += len(entry)
        _within(size, most)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if width < 12 and len(table) + p.early_change >= 1 << width:
            width += 1
    return b"".join(out)


def unpredict(data: bytes, p: Params) -> bytes:
    """Undo TIFF (2) or PNG (above 2) prediction."""
    colors, bits, columns = p.colors or 1, p.bits or 8, p.columns or 1
    if min(colors, bits, columns) < 1:
        raise PdfError("predictor: parameters must be positive")
    if not data:
        return b""
    step, row = (colors * bits + 7) // 8, (columns * colors * bits + 7) // 8
    stride = row if p.predictor == 2 else row + 1
    if len(data) % stride:
        raise PdfError(f"predictor: {len(data)} bytes are no rows of {stride}")
    table = np.frombuffer(data, np.uint8).reshape(-1, stride)
    if p.predictor == 2:
        return b"".join(_running(r, step).tobytes() for r in table)
    above, out = np.zeros(row, np.uint8), []
    for line in table:
        tag, body = int(line[0]), line[1:]
        if tag == 0:
            above = body
        elif tag == 1:
            above = _running(body, step)
        elif tag == 2:
            above = body + above
        elif tag in (3, 4):
            above = _blended(body.tobytes(), above.tobytes(), step, tag)
        else:
            raise PdfError(f"predictor: unknown tag {tag}")
        out.append(above.tobytes())
    return b"".join(out)


def _running(line: np.ndarray, step: int) -> np.ndarray:
    """Sums along a row for each byte of a pixel."""
    out = np.empty_like(line)
    for k in range(min(step, len(line))):
        out[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
    return out


def _blended(line: bytes, above: bytes, step: int, tag: int) -> np.ndarray:
    """Average (3) or Paeth (4): every byte needs the one before."""
    out = bytearray(step) + bytearray(len(line))  # the first pixel's left neighbour is zero
    up = bytes(step) + above
    for k, b in enumerate(line, step):
        left, over, corner = out[k - step], up[k], up[k - step]
        if tag == 3:
            guess = (left + over) // 2
        else:
            # the neighbour nearest to left + over - corner; ties go to left, then over
            guess = min((left, over, corner), key=lambda v: abs(left + over - corner - v))
        out[k] = (b + guess) & 0xFF
    return np.frombuffer(bytes(out[step:]), np.uint8)


def decode(name: str, data: bytes, p: Params, most: int) -> bytes:
    """One step of a filter chain; ``most`` caps its output, 0 or less means no cap."""
    if name in IMAGE_FILTERS:
        raise PdfError(f"image filter {name} is not decoded")
    name = SHORT.get(name, name)
    if name == "FlateDecode":
        return flate(data, p, most)
    if name == "LZWDecode":
        return lzw(data, p, most)
    if name == "ASCII85Decode":
        return ascii85(data)
    if name == "ASCIIHexDecode":
        return ascii_hex(data)
    if name == "RunLengthDecode":
        return run_length(data, most)
    raise PdfError(f"unsupported filter {name}")


