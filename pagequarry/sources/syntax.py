"""Tokens and values of PDF files.

One regular expression finds each token; containers are built on an explicit
stack, so nesting costs no Python frames.  Values are plain Python: None, bool,
int, float, bytes (strings), list, dict (first position, last value), and the
types Name and Ref.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_DEPTH = 1000
MAX_INT = (1 << 63) - 1
SPACE = rb"\x00\t\n\x0c\r "
DELIMITER = rb"()<>\[\]{}/%"
SKIP = rb"(?:[" + SPACE + rb"]++|%[^\r\n]*+)*+"
REGULAR = rb"[^" + SPACE + DELIMITER + rb"]"
TOKEN = re.compile(
    SKIP
    + rb"(?:/(?P<name>"
    + REGULAR
    + rb"*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<text>\()|<(?P<hex>[^>]*)(?P<hexend>>?)|(?P<number>[+-]?[0-9.]+|[+-])|(?P<word>"
    + REGULAR
    + rb"+))"
)
#: The commonest tokens whole, with what parts them from the next: references, integers, plain reals, names without escapes, brackets, short strings without escapes.
COMMON = re.compile(
    rb"[" + SPACE + rb"]*+(?:([0-9]{1,18})[" + SPACE + rb"]++([0-9]{1,18})[" + SPACE + rb"]++R(?!" + REGULAR + rb")"
    + rb"|(-?[0-9]{1,18})(?![0-9.])(?![" + SPACE + rb"]*+(?:%|[+-]?[0-9]*+[" + SPACE + rb"]*+(?:%|R)))"
    + rb"|(-?[0-9]{1,15}\.[0-9]{1,15})(?![0-9.])"
    + rb"|/([A-Za-z0-9_.+-]++)(?!" + REGULAR + rb")|(<<)|(>>)|(\[)|(\])|\(([^()\\\r]*+)\))"
)
_GAP, _BREAK = rb"[ \t\r\n]*+", rb"[ \t\r\n]++"
_REAL, _INT, _NAME = rb"-?[0-9]{1,15}\.[0-9]{1,15}", rb"-?[0-9]{1,18}", rb"[A-Za-z0-9_.+-]++"
#: A key of a flat dictionary with its value: a reference, a name, an integer, a plain real, or an array of numbers alone or references alone.
_PAIR = (
    rb"/(" + _NAME + rb")" + _GAP + rb"(?:([0-9]{1,18})" + _BREAK + rb"([0-9]{1,18})" + _BREAK + rb"R|/(" + _NAME + rb")|(" + _REAL + rb"|" + _INT + rb")"
    + rb"|\[" + _GAP + rb"((?:(?:" + _REAL + rb"|" + _INT + rb")(?=[ \t\r\n\]])" + _GAP + rb")*+|(?:[0-9]{1,18}" + _BREAK + rb"[0-9]{1,18}" + _BREAK + rb"R(?=[ \t\r\n\]])" + _GAP + rb")*+)\])(?=[ \t\r\n/>])" + _GAP
)
_PAIRS = re.compile(_PAIR)
#: A flat dictionary of such pairs alone, as most are; whatever else there is goes the general way.
FLAT = rb"<<" + _GAP + rb"(?:" + re.sub(rb"(?<!\\)\((?!\?)", rb"(?:", _PAIR) + rb")*+>>"
_FLAT = re.compile(FLAT)
#: Flat dictionaries by their bytes, up to so many, and of so many bytes.
_KNOWN: dict[bytes, Flat] = {}
_KNOWN_MOST, _KNOWN_BYTES = 4_096, 256
BLANK = re.compile(SKIP)
REFERENCE = re.compile(SKIP + rb"([+-]?[0-9]*)(?![0-9.])" + SKIP + rb"R(?!" + REGULAR + rb")")
ESCAPED_BYTE = re.compile(rb"#(.{0,2})", re.S)
HEX_PAIR = re.compile(rb"[0-9A-Fa-f]{2}\Z")
TEXT_STEP = re.compile(rb"[^()\\\r]+|\r\n?|\\(?:[0-7]{1,3}|\r\n|.)|[()]|\\", re.S)
#: What stands for each escape letter in a string (fixed values).
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
WORDS = {b"true": True, b"false": False, b"null": None}


class PdfError(Exception):
    """Malformed input; becomes a value of an error column."""


class Name(str):
    """A name without its slash; bytes that are not UTF-8 are kept by surrogate escapes."""

    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class Flat(dict):
    """A dictionary of plain values that its bytes alone determine; files may share it, so it is not to be changed."""

    __slots__ = ("rows",)

    def __init__(self):
        super().__init__()
        #: What a reader makes of it, kept with it.
        self.rows = None


class Word(bytes):
    """A token that is no value: a keyword or a delimiter."""


END = Word(b"")


def _name(raw: bytes) -> Name:
    def byte(m: re.Match) -> bytes:
        if len(m[1]) < 2:
            raise PdfError("unexpected end in a name")
        if not HEX_PAIR.match(m[1]):
            raise PdfError("bad #XX escape in a name")
        return bytes.fromhex(m[1].decode())

    return Name((ESCAPED_BYTE.sub(byte, raw) if b"#" in raw else raw).decode("utf-8", "surrogateescape"))


def _hex(raw: bytes) -> bytes:
    digits = raw.translate(None, b"\x00\t\n\x0c\r ")
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise PdfError("bad digit in a hexadecimal string")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _text(buf: bytes, pos: int) -> tuple[bytes, int]:
    """A literal string whose opening bracket ends at ``pos``."""
    out, depth = [], 1
    while m := TEXT_STEP.match(buf, pos):
        part, pos = m[0], m.end()
        first = part[:1]
        if first == b"(":
            depth += 1
        elif first == b")":
            depth -= 1
            if not depth:
                return b"".join(out), pos
        elif first == b"\r":
            part = b"\n"
        elif first == b"\\":
            rest = part[1:]
            if not rest:
                break
            if rest[:1].isdigit() and rest[:1] < b"8":
                part = bytes([int(rest, 8) & 0xFF])
            elif rest[:1] in (b"\r", b"\n"):
                part = b""
            else:
                part = ESCAPES.get(rest, rest)
        out.append(part)
    raise PdfError("unexpected end in a string")


class Tokens:
    """Reads tokens from ``pos`` on; ``start`` is where the last one began."""

    def __init__(self, buf: bytes, pos: int = 0):
        self.buf, self.pos, self.start = buf, pos, pos

    def next(self):
        """The next value token (Name, number text, bytes, …) as (kind, value)."""
        m = TOKEN.match(self.buf, self.pos)
        if m is None:
            blank = BLANK.match(self.buf, self.pos).end()
            if blank >= len(self.buf):
                self.start = self.pos = len(self.buf)
                return "end", END
            raise PdfError(f"unexpected byte 0x{self.buf[blank]:02x} at {blank}")
        kind = m.lastgroup
        # a token begins at its group, or at the slash or bracket before that
        self.start, end = m.start("hex") - 1 if kind == "hexend" else m.start(kind) - (kind == "name"), m.end()
        if kind == "hexend":
            if not m["hexend"]:
                raise PdfError("unexpected end in a hexadecimal string")
            value, kind = _hex(m["hex"]), "string"
        elif kind == "text":
            value, end = _text(self.buf, end)
            kind = "string"
        elif kind == "name":
            raw = m["name"]
            # an escape may need bytes that the name's own characters do not hold
            if b"#" in raw[-2:]:
                raise PdfError("bad #XX escape in a name" if end < len(self.buf) else "unexpected end in a name")
            value = _name(raw)
        else:
            value = m[kind]
            if kind == "number":
                kind = "real" if b"." in value else "int"
        self.pos = end
        return kind, value

    def peek_word(self) -> bytes | None:
        """The next token if it is a keyword; errors count as none."""
        m = TOKEN.match(self.buf, self.pos)
        return m["word"] if m else None


def _number(kind: str, raw: bytes):
    if kind == "real":
        try:
            return float(raw)
        except ValueError:
            raise PdfError(f"bad real {raw!r}") from None
    try:
        n = int(raw)
    except ValueError:
        raise PdfError(f"bad integer {raw!r}") from None
    if not -MAX_INT - 1 <= n <= MAX_INT:
        raise PdfError(f"integer {raw!r} out of range")
    return n


def flat_value(body: bytes) -> Flat:
    """The dictionary that ``FLAT`` matched."""
    if (own := _KNOWN.get(body)) is not None:
        return own
    own, new = Flat(), tuple.__new__
    for key, num, gen, name, number, array in _PAIRS.findall(body):
        if num:
            value = new(Ref, (int(num), int(gen)))
        elif name:
            value = Name(name.decode())
        elif number:
            value = float(number) if b"." in number else int(number)
        elif b"R" in array:
            parts = array.split()
            value = [new(Ref, (int(a), int(b))) for a, b in zip(parts[::3], parts[1::3], strict=True)]
        else:
            value = [float(n) if b"." in n else int(n) for n in array.split()]
        own[key.decode()] = value
    if len(body) <= _KNOWN_BYTES:
        if len(_KNOWN) >= _KNOWN_MOST:
            _KNOWN.clear()
        _KNOWN[body] = own
    return own


def parse_value(tokens: Tokens):
    """One value, with references told from integers by looking ahead."""
    stack: list[tuple[object, list]] = []  # container, [pending key]
    buf, common, flat = tokens.buf, COMMON.match, _FLAT.match
    while True:
        m = common(buf, tokens.pos)
        if m is not None:
            which = m.lastindex
            if stack:
                container, key = stack[-1]
                if not key and type(container) is dict:
                    if which == 5:
                        key.append(m[5].decode())
                        tokens.pos = m.end()
                        continue
                    plain = which == 7
                else:
                    plain = which != 7 and (which != 9 or type(container) is list)
            else:
                plain = which not in (7, 9)
            if plain and not (which in (6, 8) and len(stack) >= MAX_DEPTH):
                tokens.pos = m.end()
                if which == 2:
                    value = Ref(int(m[1]), int(m[2]))
                elif which == 5:
                    value = Name(m[5].decode())
                elif which == 3:
                    value = int(m[3])
                elif which == 4:
                    value = float(m[4])
                elif which == 10:
                    value = m[10]
                elif which == 6:
                    # what is returned itself is the caller's own, and may be changed
                    if not stack or len(stack) + 1 >= MAX_DEPTH or (m := flat(buf, m.end() - 2)) is None:
                        stack.append(({}, []))
                        continue
                    tokens.pos = m.end()
                    value = flat_value(m[0])
                elif which == 8:
                    stack.append(([], []))
                    continue
                else:
                    value = stack.pop()[0]
                if not stack:
                    return value
                container, key = stack[-1]
                if type(container) is list:
                    container.append(value)
                else:
                    container[key.pop()] = value
                continue
        # whatever is not common, and what is wrong, goes the general way
        kind, raw = tokens.next()
        if kind == "end":
            raise PdfError("unexpected end" if not stack else "unterminated array" if isinstance(stack[-1][0], list) else "unterminated dictionary")
        top = stack[-1] if stack else None
        in_key = top is not None and isinstance(top[0], dict) and not top[1]
        if kind == "close":
            if top is None or (raw == b"]") != isinstance(top[0], list) or (raw == b">>" and not in_key):
                raise PdfError(f"stray {raw!r} at {tokens.start}")
            value = stack.pop()[0]
        elif in_key:
            if kind != "name":
                raise PdfError(f"a dictionary key must be a name at {tokens.start}")
            top[1].append(str(raw))
            continue
        elif kind == "open":
            if len(stack) >= MAX_DEPTH:
                raise PdfError("nesting too deep")
            stack.append(([] if raw == b"[" else {}, []))
            continue
        elif kind == "int":
            value = _number(kind, raw)
            if m := REFERENCE.match(tokens.buf, tokens.pos):
                value = Ref(value, _number(kind, m[1]))
                tokens.pos = m.end()
        elif kind == "real":
            value = _number(kind, raw)
        elif kind == "word":
            if raw not in WORDS:
                raise PdfError(f"unexpected keyword {raw!r} at {tokens.start}")
            value = WORDS[raw]
        else:
            value = raw
        if not stack:
            return value
        container, key = stack[-1]
        if isinstance(container, list):
            container.append(value)
        else:
            container[key.pop()] = value
