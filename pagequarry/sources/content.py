"""Content streams as operations: an operator and the operands before it."""

from __future__ import annotations

import re
from typing import NamedTuple

from pagequarry.sources.syntax import DELIMITER, MAX_DEPTH, REGULAR, SPACE, WORDS, Name, PdfError, Tokens

MAX_OPERANDS = 100_000
_IMAGE_END = re.compile(rb"(?<=[" + SPACE + rb"])EI(?=[" + SPACE + DELIMITER + rb"]|\Z)")
_GAP = rb"[ \t\r\n]*+"
#: A key of a dictionary of plain numbers and names, with its value.
_PAIR = rb"/([A-Za-z0-9_.+-]++)" + _GAP + rb"(?:(-?[0-9]{1,18}(?:\.[0-9]{1,15})?)|/([A-Za-z0-9_.+-]++))(?=[ \t\r\n/>])" + _GAP
_PAIRS = re.compile(_PAIR)
#: The commonest tokens whole: names without escapes, numbers, operators, dictionaries of plain numbers and names.
_COMMON = re.compile(
    rb"[" + SPACE + rb"]*+(?:/([A-Za-z0-9_.+-]++)(?!" + REGULAR + rb")|([+-]?[0-9.]++)|([A-Za-z'\"]" + REGULAR + rb"*+)|(<<" + _GAP + rb"(?:" + re.sub(rb"\((?!\?)", rb"(?:", _PAIR) + rb")*+>>))"
)


class Operand(NamedTuple):
    """kind is number, name, string, bool, null, array or dict; a number keeps its literal."""

    kind: str
    value: object = None
    literal: str | None = None


class SharedOperand(Operand):
    """A dictionary that its bytes alone determine, with the row that a reader makes of it; not to be changed."""

    row: tuple | None = None


#: Such dictionaries by their bytes, up to so many, and of so many bytes.
_KNOWN: dict[bytes, SharedOperand] = {}
_KNOWN_MOST, _KNOWN_BYTES = 4_096, 128


class Operation(NamedTuple):
    operator: str
    operands: list[Operand]
    offset: int
    image: bytes | None = None


def _number(raw: bytes) -> Operand:
    try:
        value = float(raw)
    except ValueError:
        value = 0.0
    return Operand("number", value, raw.decode())


def _scalar(kind: str, raw) -> Operand | None:
    if kind in ("int", "real"):
        return _number(raw)
    if kind == "name":
        return Operand("name", raw)
    if kind == "string":
        return Operand("string", raw)
    if kind == "word" and raw in WORDS:
        return Operand("null") if WORDS[raw] is None else Operand("bool", WORDS[raw])
    return None


def _value(tokens: Tokens, kind: str, raw) -> Operand:
    """The value that begins with a token."""
    stack: list[tuple[object, list]] = []
    while True:
        found = _scalar(kind, raw)
        container, key = stack[-1] if stack else (None, None)
        in_key = isinstance(container, dict) and not key
        if kind == "end":
            raise PdfError("unexpected end")
        if kind == "close":
            if container is None or (raw == b"]") != isinstance(container, list) or (raw == b">>" and not in_key):
                raise PdfError(f"unexpected {raw!r} at {tokens.start}")
            stack.pop()
            found = Operand("array" if raw == b"]" else "dict", container)
        elif in_key:
            if kind != "name":
                raise PdfError(f"a dictionary key must be a name at {tokens.start}")
            key.append(str(raw))
            kind, raw = tokens.next()
            continue
        elif kind == "open":
            if len(stack) >= MAX_DEPTH:
                raise PdfError("nesting too deep")
            stack.append(([] if raw == b"[" else {}, []))
            kind, raw = tokens.next()
            continue
        elif found is None:
            raise PdfError(f"unexpected keyword {raw!r} at {tokens.start}")
        if not stack:
            return found
        container, key = stack[-1]
        if isinstance(container, list):
            container.append(found)
        else:
            container[key.pop()] = found
        if len(container) > MAX_OPERANDS:
            raise PdfError("container too large")
        kind, raw = tokens.next()


def _inline_image(tokens: Tokens) -> tuple[Operand, bytes]:
    """The dictionary and bytes between BI and EI."""
    own: dict[str, Operand] = {}
    while True:
        kind, raw = tokens.next()
        if kind == "word" and raw == b"ID":
            break
        if kind != "name":
            raise PdfError("unexpected end" if kind == "end" else f"a name was expected in an inline image at {tokens.start}")
        own[str(raw)] = _value(tokens, *tokens.next())
    start = tokens.pos + (tokens.buf[tokens.pos : tokens.pos + 1] in (b" ", b"\t", b"\n", b"\r"))
    m = _IMAGE_END.search(tokens.buf, start)
    if m is None:
        raise PdfError("unexpected end of an inline image")
    tokens.pos = m.end()
    return Operand("dict", own), tokens.buf[start : max(start, m.start() - 1)]


def _plain_dictionary(body: bytes) -> SharedOperand:
    if (found := _KNOWN.get(body)) is None:
        found = SharedOperand("dict", {key.decode(): _number(number) if number else Operand("name", Name(name.decode())) for key, number, name in _PAIRS.findall(body)})
        if len(body) <= _KNOWN_BYTES:
            if len(_KNOWN) >= _KNOWN_MOST:
                _KNOWN.clear()
            _KNOWN[body] = found
    return found


def operations(buf: bytes):
    """All operations in order; operands at the end without an operator are dropped."""
    tokens, operands = Tokens(buf), []
    common = _COMMON.match
    while True:
        if len(operands) > MAX_OPERANDS:
            raise PdfError("too many operands")
        if m := common(buf, tokens.pos):
            which, raw = m.lastindex, m[m.lastindex]
            if which != 3:
                operands.append(_number(raw) if which == 2 else Operand("name", Name(raw.decode())) if which == 1 else _plain_dictionary(raw))
                tokens.pos = m.end()
                continue
            if raw not in WORDS and raw != b"BI":
                tokens.pos = m.end()
                yield Operation(raw.decode("utf-8", "surrogateescape"), operands, m.start(3), None)
                operands = []
                continue
        kind, raw = tokens.next()
        offset = tokens.start
        if kind == "end":
            return
        if kind == "word" and raw not in WORDS:
            image = None
            if raw == b"BI":
                own, image = _inline_image(tokens)
                operands.append(own)
                raw = b"EI"
            yield Operation(raw.decode("utf-8", "surrogateescape"), operands, offset, image)
            operands = []
        else:
            operands.append(_value(tokens, kind, raw))
