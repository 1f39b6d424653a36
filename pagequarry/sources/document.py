"""One PDF file: cross-reference sections, objects, streams, and its trees.

Only what must be done byte by byte, or file by file in order, is done here.
Sections are read newest first and a definition that is already there stays.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass
from typing import NamedTuple

from pagequarry.sources import codecs
from pagequarry.sources.security import Handler, Settings
from pagequarry.sources.syntax import FLAT, MAX_DEPTH, REGULAR, SPACE, Name, PdfError, Ref, Tokens, flat_value, parse_value

HEADER_WINDOW = TAIL_WINDOW = 1024
DEFAULT_MAX_STREAM = 16 << 20
_STARTXREF = re.compile(rb"startxref[ \t\r\n]*([0-9]*)")
_EOL = re.compile(rb"[ \t]*(?:\r\n|\r|\n)?")
# looked for from the first digit of a number only, so a long run of digits or blanks is passed once
_INDIRECT = re.compile(rb"(?<!\d)(\d{1,19})[" + SPACE + rb"]++(\d{1,19})[" + SPACE + rb"]*+obj(?=[" + SPACE + rb"]|\Z)")
#: A subsection of one entry, as most are; others are read row by row.
_ONE_ENTRY = re.compile(rb"(\d{1,18}) 1[ \t]*(?:\r\n|\r|\n)(\d{10}).(\d{5}).([nf])..", re.S)
_ENTRIES = re.compile(rb"(?:\d{1,18} 1[ \t]*(?:\r\n|\r|\n)\d{10}.\d{5}.[nf]..)++", re.S)
_HEADER = re.compile(rb"[^\r\n]*(?=[\r\n])")
_XREF = re.compile(rb"[" + SPACE + rb"]*xref")
_COUNT = re.compile(rb"[+-]?\d{1,19}")
_OBJECT = re.compile(rb"[" + SPACE + rb"]*+(\d{1,18})[" + SPACE + rb"]++(\d{1,18})[" + SPACE + rb"]++obj(?!" + REGULAR + rb")")
#: An object that is a flat dictionary, or a stream's of that kind, as most are; and a trailer of that kind.
_FLAT_OBJECT = re.compile(rb"[" + SPACE + rb"]*+(\d{1,18})[" + SPACE + rb"]++(\d{1,18})[" + SPACE + rb"]++obj[" + SPACE + rb"]*+(" + FLAT + rb")[" + SPACE + rb"]*+(?:endobj|(stream))(?!" + REGULAR + rb")")
_FLAT_TRAILER = re.compile(rb"[" + SPACE + rb"]*+(" + FLAT + rb")")
_VERSION_END = re.compile(rb"[\r\n \t]")
_MISSING = object()
#: The end of an object that is no stream, as most are.
_END = re.compile(rb"[" + SPACE + rb"]*+endobj(?!" + REGULAR + rb")")
#: Bytes of decoded streams that a file keeps while it is read.
CACHE_BYTES = 32 << 20
_MAX_INT = (1 << 63) - 1
#: Bytes of packed objects that are read, against those of the file and of a stream at most.
PARSE_RATIO = 16


@dataclass(slots=True)
class Stream:
    """A stream's dictionary and where its raw bytes are."""

    dict: dict
    start: int
    length: int
    num: int
    gen: int


class Entry(NamedTuple):
    """A row of a cross-reference section; kind 0 is free, 1 in the file, 2 in an object stream."""

    section: int
    order: int
    num: int
    gen: int
    kind: int
    offset: int = 0
    container: int = 0
    index: int = 0


def _integer(raw: bytes) -> int:
    text = raw.lstrip(b" \t")
    return int(text) if re.fullmatch(rb"[+-]?\d{1,19}", text) else 0


class Kept(OrderedDict):
    """Values by key, the latest ones of ``CACHE_BYTES`` together."""

    def __init__(self):
        super().__init__()
        self.total, self.sizes = 0, {}

    def keep(self, key, value, size: int) -> None:
        self[key], self.sizes[key] = value, size
        self.total += size
        while self.total > CACHE_BYTES and len(self) > 1:
            old, _ = self.popitem(last=False)
            self.total -= self.sizes.pop(old)


class Document:
    """A parsed file; raises PdfError if it cannot be opened.  ``later``: the password may be checked with those of other files."""

    def __init__(self, buf: bytes, max_stream: int = DEFAULT_MAX_STREAM, password: bytes = b"", later: bool = False):
        self.buf, self.max_stream, self.password, self._later = buf, max_stream, password, later
        self.entries: list[Entry] = []
        self.live: dict[Ref, Entry] = {}
        self.trailer: dict | None = None
        self.recovered = False
        self.handler: Handler | None = None
        self._objects: dict[Ref, object] = {}
        self._active: set[Ref] = set()
        self._decoded, self._containers = Kept(), Kept()
        #: Section and dictionary of every trailer, newest first.
        self.trailers: list[tuple[int, dict]] = []
        self._parsed = 0
        at = buf[:HEADER_WINDOW].find(b"%PDF-")
        if at < 0:
            raise PdfError("not a PDF (missing %PDF- header)")
        self.version = _VERSION_END.split(buf[at + 5 : at + 21], maxsplit=1)[0].decode("utf-8", "surrogateescape")
        self._read_sections()
        self._open_security()

    # --- cross-reference sections ---

    def _read_sections(self) -> None:
        found = _STARTXREF.findall(self.buf, max(0, len(self.buf) - TAIL_WINDOW))
        if not found or not found[-1] or int(found[-1]) > _MAX_INT:
            self._recover("startxref not found")
            return
        at, seen = int(found[-1]), set()
        while True:
            if at in seen:
                raise PdfError(f"cross-reference loop at offset {at}")
            seen.add(at)
            try:
                before = self._section(at, len(seen) - 1)
            except PdfError as e:
                if len(seen) > 1:
                    raise
                self._recover(str(e))
                return
            if not before:
                break
            at = before
        if self.trailer is None:
            raise PdfError("no trailer found")

    def _add(self, entry: Entry) -> None:
        self.entries.append(entry)
        if entry.kind:
            self.live.setdefault(Ref(entry.num, entry.gen), entry)

    def _add_ones(self, found: list[tuple], number: int, order: int) -> int:
        """Entries of subsections of one each; the order of the next one."""
        new, live, entries = tuple.__new__, self.live, self.entries
        for num, offset, gen, flag in found:
            num, gen = int(num), int(gen)
            entry = new(Entry, (number, order, num, gen, 1 if flag == b"n" else 0, int(offset), 0, 0))
            entries.append(entry)
            if flag == b"n":
                live.setdefault(new(Ref, (num, gen)), entry)
            order += 1
        return order

    def _merge_trailer(self, own: dict, section: int) -> None:
        self.trailers.append((section, dict(own)))
        if self.trailer is None:
            self.trailer = own
        else:
            for key, value in own.items():
                self.trailer.setdefault(key, value)

    def _section(self, at: int, number: int) -> int:
        if not 0 <= at < len(self.buf):
            raise PdfError(f"cross-reference offset {at} out of range")
        m = _XREF.match(self.buf, at)
        return self._table(m.end(), number) if m else self._stream_section(at, number)

    def _table(self, at: int, number: int) -> int:
        at, order = _EOL.match(self.buf, at).end(), 0
        while True:
            if m := _ENTRIES.match(self.buf, at):
                order, at = self._add_ones(_ONE_ENTRY.findall(self.buf, at, m.end()), number, order), m.end()
            m = _HEADER.match(self.buf, at)
            if m is None:
                raise PdfError("unterminated subsection header")
            line = m[0].strip(b" \t\x0b\x0c\x85\xa0")
            if line == b"trailer":
                at = _EOL.match(self.buf, at + len(b"trailer")).end()
                break
            if not line:
                at = _EOL.match(self.buf, m.end()).end()
                continue
            parts = line.split()
            if len(parts) != 2 or not all(map(_COUNT.fullmatch, parts)):
                raise PdfError(f"bad subsection header {line!r}")
            first, count = map(int, parts)
            if abs(first) + max(count, 0) > _MAX_INT:
                raise PdfError(f"object numbers out of range in {line!r}")
            at = _EOL.match(self.buf, m.end()).end()
            for k in range(count):
                row = self.buf[at : at + 20]
                if len(row) < 20:
                    raise PdfError("truncated cross-reference entry")
                at += 20
                kind = 1 if row[17:18] == b"n" else 0
                if kind or row[17:18] == b"f":
                    self._add(Entry(number, order, first + k, _integer(row[11:16]), kind, _integer(row[:10])))
                    order += 1
        if m := _FLAT_TRAILER.match(self.buf, at):
            trailer = dict(flat_value(m[1]))
        else:
            tokens = Tokens(self.buf, at)
            kind, raw = tokens.next()
            if kind != "open" or raw != b"<<":
                raise PdfError("trailer dictionary missing")
            trailer = parse_value(Tokens(self.buf, tokens.start))
        self._merge_trailer(trailer, number)
        if isinstance(extra := trailer.get("XRefStm"), int) and not isinstance(extra, bool):
            self._stream_section(extra, number, order)
        before = trailer.get("Prev")
        return before if isinstance(before, int) and not isinstance(before, bool) else 0

    def _stream_section(self, at: int, number: int, order: int = 0) -> int:
        if not 0 <= at < len(self.buf):
            raise PdfError(f"cross-reference stream offset {at} out of range")
        num, gen, body, tokens = self._indirect(at)
        if not isinstance(body, dict) or tokens.peek_word() != b"stream":
            raise PdfError("cross-reference stream expected")
        tokens.next()
        stream = self._stream(body, tokens.pos, num, gen)
        rows = self._decode(stream, encrypted=False)
        self._merge_trailer(body, number)
        widths = self.get(body, "W")
        if not isinstance(widths, list) or len(widths) < 3:
            raise PdfError("/W missing or too short")
        if any(type(w) is not int or w < 0 for w in widths) or not sum(widths):
            raise PdfError("bad /W")
        index = self.get(body, "Index")
        if not isinstance(index, list):
            size = self.get(body, "Size")
            if type(size) is not int:
                raise PdfError("/Size missing")
            index = [0, size]
        if any(type(n) is not int for n in index):
            raise PdfError("/Index entry is no integer")
        size, place = sum(widths), 0
        edges = [sum(widths[:k]) for k in range(4)]
        for first, count in zip(index[::2], index[1::2], strict=False):
            if abs(first) + max(count, 0) > _MAX_INT:
                raise PdfError("object numbers out of range in /Index")
            for k in range(count):
                row = rows[place : place + size]
                if len(row) < size:
                    raise PdfError("cross-reference stream data truncated")
                place += size
                kind, a, b = (int.from_bytes(row[x:y], "big") & ((1 << 64) - 1) for x, y in zip(edges[:-1], edges[1:], strict=True))
                kind = kind if widths[0] else 1
                if kind == 2:
                    self._add(Entry(number, order, first + k, 0, 2, container=a, index=b))
                elif kind in (0, 1):
                    self._add(Entry(number, order, first + k, min(b, _MAX_INT), kind, a))
                order += kind <= 2
        before = body.get("Prev")
        return before if type(before) is int else 0

    def _recover(self, why: str) -> None:
        """Rebuild the index from object headers; of several copies the first in the file stays."""
        self.recovered = True
        number = max((e.section for e in self.entries), default=-1) + 1
        for order, m in enumerate(_INDIRECT.finditer(self.buf)):
            num, gen = int(m[1]), int(m[2])
            if max(num, gen) <= _MAX_INT:
                self._add(Entry(number, order, num, gen, 1, m.start()))
        if self.trailer is None and (at := self.buf.rfind(b"trailer")) >= 0:
            try:
                tokens = Tokens(self.buf, at + len(b"trailer"))
                if tokens.next() == ("open", b"<<"):
                    self._merge_trailer(parse_value(Tokens(self.buf, tokens.start)), number)
            except PdfError:
                pass
        if self.trailer is None:
            for ref in sorted(self.live):
                try:
                    own = self.resolve(ref)
                    if isinstance(own, dict) and self.get(own, "Type") == "Catalog" and isinstance(self.get(own, "Type"), Name):
                        self._merge_trailer({"Root": ref}, number)
                        break
                except PdfError:
                    continue
        if self.trailer is None:
            raise PdfError(f"{why}; recovery found no trailer")

    # --- objects ---

    def resolve(self, value):
        """What a reference leads to, one step; missing objects are null."""
        if not isinstance(value, Ref):
            return value
        if (found := self._objects.get(value, _MISSING)) is not _MISSING:
            return found
        if value in self._active:
            raise PdfError(f"reference cycle at {value.num} {value.gen} R")
        self._active.add(value)
        try:
            entry = self.live.get(value)
            if entry is None:
                found = None
            elif entry.kind == 1:
                found = self._object_at(entry.offset, value)
            else:
                found = self._packed(entry.container, entry.index, value)
        except RecursionError:
            raise PdfError("references nest too deep") from None
        finally:
            self._active.discard(value)
        self._objects[value] = found
        return found

    def get(self, own: dict, key: str):
        """A dictionary's value, resolved; None if missing or unreadable."""
        value = own.get(key)
        if type(value) is not Ref:
            return value
        try:
            return self.resolve(value)
        except PdfError:
            return None

    def dict_of(self, value) -> dict | None:
        """The dictionary a value is or, for a stream, has."""
        try:
            found = self.resolve(value)
        except PdfError:
            return None
        return found.dict if isinstance(found, Stream) else found if isinstance(found, dict) else None

    def _indirect(self, at: int):
        tokens = Tokens(self.buf, at)
        if m := _OBJECT.match(self.buf, at):
            tokens.pos = m.end()
            return int(m[1]), int(m[2]), parse_value(tokens), tokens
        (k1, num), (k2, gen), (k3, word) = tokens.next(), tokens.next(), tokens.next()
        if (k1, k2, k3, word) != ("int", "int", "word", b"obj"):
            raise PdfError(f"bad object header at {at}")
        return _integer(num), _integer(gen), parse_value(tokens), tokens

    def _object_at(self, at: int, ref: Ref):
        if not 0 <= at < len(self.buf):
            raise PdfError(f"offset {at} out of range")
        if (m := _FLAT_OBJECT.match(self.buf, at)) and int(m[1]) == ref.num:
            own = flat_value(m[3])
            return self._stream(own, m.end(), ref.num, ref.gen) if m[4] else own
        num, _, body, tokens = self._indirect(at)
        if num != ref.num:
            raise PdfError(f"object {num} found where {ref.num} was expected")
        if _END.match(self.buf, tokens.pos) or tokens.peek_word() != b"stream":
            return body
        if not isinstance(body, dict):
            raise PdfError("stream without a dictionary")
        tokens.next()
        return self._stream(body, tokens.pos, ref.num, ref.gen)

    def _stream(self, own: dict, at: int, num: int, gen: int) -> Stream:
        """The stream after its keyword."""
        if "Length" not in own:
            raise PdfError("missing /Length")
        length = self.resolve(own["Length"])
        if type(length) is not int or length < 0:
            raise PdfError("bad /Length")
        at += self.buf[at : at + 1] == b"\r"
        at += self.buf[at : at + 1] == b"\n"
        if length > len(self.buf) - at:
            raise PdfError("stream runs past the end")
        return Stream(own, at, length, num, gen)

    def _packed(self, container: int, index: int, ref: Ref):
        if container not in self._containers:
            stream = self.resolve(Ref(container, 0))
            if not isinstance(stream, Stream) or self.get(stream.dict, "Type") != "ObjStm":
                raise PdfError(f"{container} is no object stream")
            n, first = self.get(stream.dict, "N"), self.get(stream.dict, "First")
            if type(n) is not int or type(first) is not int:
                raise PdfError("object stream without /N or /First")
            content = self.content(stream)
            if not 0 <= first <= len(content) or not 0 <= n <= len(content):
                raise PdfError("object stream with implausible /N or /First")
            header, pairs = Tokens(content[:first]), []
            for _ in range(n):
                (k1, a), (k2, b) = header.next(), header.next()
                if (k1, k2) != ("int", "int"):
                    raise PdfError("bad object stream header")
                pairs.append((_integer(a), _integer(b)))
            self._containers.keep(container, (content, first, pairs), len(content) + 64 * len(pairs))
        content, first, pairs = self._containers[container]
        if not 0 <= index < len(pairs) or pairs[index][0] != ref.num:
            raise PdfError(f"object stream {container} does not hold {ref.num} at {index}")
        at = first + pairs[index][1]
        if not 0 <= at < len(content):
            raise PdfError("object offset out of range")
        # objects may overlap, all of them even, so what is read is counted
        if self._parsed > PARSE_RATIO * (len(self.buf) + max(self.max_stream, 0)):
            raise PdfError("packed objects overlap too much")
        tokens = Tokens(content, at)
        value = parse_value(tokens)
        self._parsed += tokens.pos - at
        return value

    def objects(self, wanted=None):
        """All live references, or those that are wanted, with their value or error, by number and generation."""
        for ref in sorted(self.live if wanted is None else filter(wanted, self.live)):
            try:
                yield ref, self.resolve(ref), None
            except PdfError as e:
                yield ref, None, str(e)

    # --- streams ---

    def filters(self, own: dict) -> tuple[list[str], list[codecs.Params]]:
        """Filter names and their parameters, in order."""
        if "Filter" not in own and "F" not in own:
            return [], []
        value = self.resolve(own["Filter"] if "Filter" in own else own["F"])
        names = [self.resolve(v) for v in value] if isinstance(value, list) else [value]
        if not all(isinstance(n, Name) for n in names):
            raise PdfError("/Filter is not made of names")
        given = self.resolve(own["DecodeParms"] if "DecodeParms" in own else own.get("DP"))
        dicts = [given] if isinstance(given, dict) else [self.resolve(v) for v in given[: len(names)]] if isinstance(given, list) else []
        params = [self._params(d) if isinstance(d, dict) else codecs.Params() for d in dicts[: len(names)]]
        return [str(n) for n in names], params + [codecs.Params()] * (len(names) - len(params))

    def _params(self, own: dict) -> codecs.Params:
        number = lambda key: v if type(v := self.get(own, key)) is int else 0
        early = self.get(own, "EarlyChange")
        return codecs.Params(number("Predictor"), number("Columns"), number("Colors"), number("BitsPerComponent"), not (type(early) is int and early == 0))

    def _decode(self, stream: Stream, encrypted: bool) -> bytes:
        data = self.buf[stream.start : stream.start + stream.length]
        if encrypted and self.handler:
            data = self.handler.decrypt(data, stream.num, stream.gen)
        for name, params in zip(*self.filters(stream.dict), strict=True):
            data = codecs.decode(name, data, params, self.max_stream)
        return data

    def content(self, stream: Stream) -> bytes:
        """A stream's decoded bytes."""
        key = (stream.start, stream.num)
        if key not in self._decoded:
            data = self._decode(stream, encrypted=True)
            self._decoded.keep(key, data, len(data))
        return self._decoded[key]

    # --- security ---

    def _open_security(self) -> None:
        if "Encrypt" not in self.trailer:
            return
        own = self.dict_of(self.trailer["Encrypt"])
        if own is None:
            raise PdfError("/Encrypt is no dictionary")
        if self.get(own, "Filter") != "Standard":
            raise PdfError("encryption filter is not supported")

        def typed(key, kind, default):
            value = self.get(own, key)
            return value if type(value) is kind else default

        ids = self.get(self.trailer, "ID")
        settings = Settings(
            typed("V", int, 0), typed("R", int, 0), typed("Length", int, 40), typed("P", int, 0),
            typed("O", bytes, b""), typed("U", bytes, b""), typed("OE", bytes, b""), typed("UE", bytes, b""),
            ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"",
            typed("EncryptMetadata", bool, True), str(typed("StmF", Name, "")),
        )
        crypt_filters = self.get(own, "CF")
        for name, value in crypt_filters.items() if isinstance(crypt_filters, dict) else ():
            if isinstance(value, dict) and isinstance(method := self.get(value, "CFM"), Name):
                settings.methods[name] = str(method)
        self.handler = Handler(settings, self.password, self._later)

    # --- trees ---

    def catalog(self) -> dict:
        if "Root" not in (self.trailer or {}):
            raise PdfError("trailer has no /Root")
        found = self.dict_of(self.trailer["Root"])
        if found is None:
            raise PdfError("/Root is no dictionary")
        return found

    def xref_format(self) -> str:
        kind = self.get(self.trailer, "Type")
        return "stream" if isinstance(kind, Name) and kind == "XRef" else "hybrid" if "XRefStm" in self.trailer else "classical"

    def _walk(self, root, seen: set[Ref], kids_of):
        """Depth-first, parents first: (value, dictionary, depth); each reference is entered once."""
        stack = [(root, 0)]
        while stack:
            value, depth = stack.pop()
            if depth and isinstance(value, Ref):
                if value in seen:
                    continue
                seen.add(value)
            own = self.dict_of(value)
            if own is None or depth > MAX_DEPTH:
                continue
            yield value, own, depth
            stack.extend((kid, depth + 1) for kid in reversed(list(kids_of(own))))

    def pages(self):
        """(reference or None, dictionary) of each page, in order."""
        cat = self.catalog()
        if "Pages" not in cat:
            raise PdfError("catalog has no /Pages")
        if self.dict_of(cat["Pages"]) is None:
            raise PdfError("/Pages is no dictionary")
        seen = {cat["Pages"]} if isinstance(cat["Pages"], Ref) else set()
        kids = lambda own: k if isinstance(k := self.get(own, "Kids"), list) else ()
        for value, own, _ in self._walk(cat["Pages"], seen, kids):
            kind = self.get(own, "Type")
            inner = "Kids" in own or "Count" in own or (isinstance(kind, Name) and kind == "Pages")
            if not inner:
                yield value if isinstance(value, Ref) else None, own

    def chain(self, own: dict, ref: Ref | None = None):
        """A page's dictionary, which ``ref`` leads to, and its ancestors by /Parent."""
        # equal dictionaries may be one, so each is known by its reference, or as what another one holds
        key = "page" if ref is None else ref
        seen: set = {key}
        for _ in range(MAX_DEPTH + 1):
            yield own
            named = own.get("Parent")
            parent = self.get(own, "Parent")
            if not isinstance(parent, dict) or (key := named if type(named) is Ref else (key, "Parent")) in seen:
                return
            seen.add(key)
            own = parent

    def attachments(self):
        """(name, specification's reference or None, its dictionary), in tree order."""
        try:
            names = self.get(self.catalog(), "Names")
        except PdfError:
            return
        root = self.get(names, "EmbeddedFiles") if isinstance(names, dict) else None
        if not isinstance(root, dict):
            return
        # kids come before a node's own names, so nodes are left on the stack until their kids are done
        seen: set[Ref] = set()
        stack: list = [(root, 0, None)]
        while stack:
            node, depth, kids = stack.pop()
            if kids is None:
                if depth > MAX_DEPTH:
                    continue
                found = self.get(node, "Kids")
                kids = iter(found if isinstance(found, list) else ())
            for kid in kids:
                if isinstance(kid, Ref):
                    if kid in seen:
                        continue
                    seen.add(kid)
                child = self.dict_of(kid)
                if child is not None:
                    stack += [(node, depth, kids), (child, depth + 1, None)]
                    break
            else:
                found = self.get(node, "Names")
                found = found if isinstance(found, list) else []
                for name, spec in zip(found[::2], found[1::2], strict=False):
                    own = self.dict_of(spec)
                    if isinstance(name, bytes) and own is not None:
                        yield name, spec if isinstance(spec, Ref) else None, own
