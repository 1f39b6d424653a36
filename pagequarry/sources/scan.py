"""The scan: one task reads whole files and emits the rows of one table.

``scan(files, table)`` takes rows (doc_id, content) in batch or streaming and
returns that table only, or wanted columns of it, so what a query does not ask for is
not decoded.  A file that cannot be opened gives one row of ``documents`` with its
error, and none elsewhere unless ``open_errors`` asks for it; an object or stream that
cannot be read, or a file that ends early, gives a row with its error.
"""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.operators.dump import DumpOptions, Literal, dump, tagged, to_json
from pagequarry.sources.content import Operand, SharedOperand, operations
from pagequarry.sources.document import DEFAULT_MAX_STREAM, Document, Stream
from pagequarry.sources.security import refused
from pagequarry.sources.syntax import Flat, Name, PdfError, Ref
from pagequarry.workspace import ship

_MAX = (1 << 63) - 1
_MAX_SMALL = (1 << 31) - 1
#: Rows are handed on after this many, or this many bytes of binary values.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Rows after which the first batch is handed on; each later one may have twice as many, so a limit ends early.
FIRST_ROWS = 16
#: Bytes of a page's content, which is one value.
MAX_PAGE = 256 << 20


@dataclass(frozen=True)
class Only:
    """A condition on a column that the scan tests before it makes a row: op is one of = in < <= > >=."""

    column: str
    op: str
    value: object

    def holds(self, own) -> bool:
        if own is None:
            return False
        if self.op == "in":
            return own in self.value
        return {"=": own == self.value, "<": own < self.value, "<=": own <= self.value, ">": own > self.value, ">=": own >= self.value}[self.op]


@dataclass(frozen=True)
class ScanOptions:
    """Cap of decoded streams (0 or less: none), password, how dumps look, and what is wanted."""

    max_stream: int = DEFAULT_MAX_STREAM
    password: bytes = b""
    dump: DumpOptions = DumpOptions()
    #: Whether ``page_spine`` decodes the pages' content streams.
    contents: bool = True
    #: Whether every table, and not ``documents`` alone, has a row for a file that cannot be opened.
    open_errors: bool = False
    #: Whether objects in object streams are read (``operators.packed`` reads them by a join).
    packed: bool = True
    #: Columns that are wanted (None: all); what no wanted column needs is neither parsed nor decoded.
    columns: tuple[str, ...] | None = None
    #: Conditions on PUSHED columns that all hold for wanted rows.
    only: tuple[Only, ...] = ()

    def needs(self, *columns: str) -> bool:
        return self.columns is None or any(c in self.columns for c in columns)

    def holds(self, column: str, value) -> bool:
        return all(c.holds(value) for c in self.only if c.column == column)


_ATTRIBUTE = "struct<depth:int,key:string,kind:string,numbers:array<double>,int_val:bigint,keys:array<string>>"
_OPERAND = "struct<kind:string,number:double,literal:string,name:string,bytes:binary,bool_val:boolean,json:string>"
_NODE = "node_id int, parent_id int, depth int, pos int, key string, kind string, bool_val boolean, int_val bigint, real_val double, name_val string, bytes_val binary, ref_num bigint, ref_gen bigint"
_PARAMS = "struct<predictor:int,columns:int,colors:int,bpc:int,no_early_change:boolean>"
#: Columns of each table after doc_id.
SCHEMAS = {
    "documents": "header_version string, catalog_version string, xref_format string, encrypted boolean, recovered boolean, n_objects int, page_count int, trailer_json string, error string",
    "xref_entries": "section_ord int, entry_ord int, num bigint, gen bigint, kind int, offset bigint, stm_num bigint, stm_idx bigint, error string",
    "trailers": "key string, pos int, kind string, json string, error string",
    "trailer_nodes": f"section_ord int, trailer_ord int, {_NODE}, error string",
    "objects": "num bigint, gen bigint, kind string, tagged_json string, error string",
    "nodes": f"num bigint, gen bigint, {_NODE}, error string",
    "graph": f"section_ord int, trailer_ord int, num bigint, gen bigint, {_NODE}, error string",
    "streams": f"num bigint, gen bigint, raw_offset bigint, raw_length bigint, raw binary, filters array<string>, params array<{_PARAMS}>, decoded binary, error string",
    "page_spine": f"page_index int, num bigint, gen bigint, parents array<struct<num:bigint,gen:bigint>>, attributes array<{_ATTRIBUTE}>, contents array<binary>, content_error string",
    "content_ops": f"page_index int, op_index int, operator string, offset bigint, operands array<{_OPERAND}>, image binary, error string",
    "info_entries": "key string, bytes_val binary, error string",
    "info": "title binary, author binary, subject binary, keywords binary, creator binary, producer binary, creation_date binary, mod_date binary, custom array<struct<key:string,value:binary>>, error string",
    "attachments": "ord int, name_bytes binary, spec_num bigint, spec_gen bigint, file_bytes binary, error string",
    "struct_elems": "ord int, depth int, role string, mapped_role string, error string",
    "dumps": "json string, error string",
    "security": "cipher string, file_key binary, error string",
}
#: Columns of each table whose conditions the scan tests itself.
PUSHED = {"objects": ("num", "gen", "kind"), "nodes": ("num", "gen"), "streams": ("num", "gen"), "page_spine": ("page_index",), "content_ops": ("page_index",)}


#: Kinds by exact type; ``kind_of`` asks for subclasses only of what is not here.
_KINDS = {type(None): "null", bool: "bool", int: "int", float: "real", Name: "name", bytes: "string", Ref: "ref", list: "array", dict: "dict", Flat: "dict", Stream: "stream"}


def kind_of(value) -> str:
    if found := _KINDS.get(type(value)):
        return found
    for kind, name in ((bool, "bool"), (int, "int"), (float, "real"), (Name, "name"), (bytes, "string"), (Ref, "ref"), (list, "array"), (dict, "dict")):
        if isinstance(value, kind):
            return name
    return "stream"


def _shown(text: str) -> str:
    return str(text) if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _documents(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    version = pages = trailer = count = None
    if o.needs("catalog_version"):
        try:
            found = doc.get(doc.catalog(), "Version")
            version = _shown(found) if isinstance(found, Name) else None
        except PdfError:
            pass
    if o.needs("page_count"):
        try:
            pages = sum(1 for _ in doc.pages())
        except PdfError:
            pass
    if o.needs("trailer_json"):
        trailer = to_json(tagged(doc, doc.trailer, o.dump)["dict"])
    if o.needs("n_objects"):
        count = sum(e is None for _, _, e in doc.objects())
    yield _shown(doc.version), version, doc.xref_format() if o.needs("xref_format") else None, doc.handler is not None, doc.recovered, count, pages, trailer, None


def _wanted(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    """Objects whose number and generation are wanted."""
    if not o.only and o.packed:
        return doc.objects()
    return doc.objects(lambda ref: o.holds("num", ref.num) and o.holds("gen", ref.gen) and (o.packed or doc.live[ref].kind == 1))


def _xref_entries(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for e in doc.entries:
        yield e.section, e.order, e.num, min(e.gen, _MAX), e.kind, min(e.offset, _MAX), min(e.container, _MAX), min(e.index, _MAX), None


def _trailers(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for pos, (key, value) in enumerate(doc.trailer.items()):
        yield _shown(key), pos, kind_of(value), to_json(tagged(doc, value, o.dump)) if o.needs("json") else None, None


def _objects(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for ref, value, error in _wanted(doc, o):
        kind = None if error else kind_of(value)
        if o.holds("kind", kind):
            yield ref.num, ref.gen, kind, to_json(tagged(doc, value, o.dump)) if o.needs("tagged_json") and not error else None, error


def _flat_rows(own: Flat) -> list[tuple]:
    """Rows of a flat dictionary, counted from it, without its own one."""
    if own.rows is None:
        found: list[tuple] = []
        for pos, (key, value) in enumerate(own.items()):
            number = len(found) + 1
            found.append((number, 0, 1, pos, key, *_shown_value(value)))
            if type(value) is list:
                found += [(number + 1 + k, number, 2, k, None, *_shown_value(v)) for k, v in enumerate(value)]
        own.rows = found
    return own.rows


_NO_VALUE = (None,) * 7


def _shown_value(own) -> tuple:
    """Kind and the columns of values of one node."""
    kind = kind_of(own)
    if kind == "ref":
        return kind, None, None, None, None, None, own.num, own.gen
    if kind == "name":
        return kind, None, None, None, _shown(own), None, None, None
    if kind == "int":
        return kind, None, own, None, None, None, None, None
    if kind == "real":
        return kind, None, None, own, None, None, None, None
    if kind == "string":
        return kind, None, None, None, None, own, None, None
    if kind == "bool":
        return kind, own, None, None, None, None, None, None
    return kind, *_NO_VALUE


def node_rows(value, before: tuple = (), after: tuple = ()) -> Iterator[tuple]:
    """A value and all that is in it, parents first: number, number of the parent, depth, place, key, kind and value, between columns that are the same for all."""
    number, stack = 0, [(value, None, 0, 0, None)]
    while stack:
        own, parent, depth, pos, key = stack.pop()
        if type(own) is Flat:
            yield (*before, number, parent, depth, pos, key, "dict", *_NO_VALUE, *after)
            rows = _flat_rows(own)
            if number:
                for row in rows:
                    yield (*before, row[0] + number, row[1] + number, row[2] + depth, *row[3:], *after)
            else:
                for row in rows:
                    yield (*before, *row, *after)
            number += 1 + len(rows)
            continue
        yield (*before, number, parent, depth, pos, key, *(shown := _shown_value(own)), *after)
        kind = shown[0]
        if kind == "array":
            for k in range(len(own) - 1, -1, -1):
                stack.append((own[k], number, depth + 1, k, None))
        elif kind in ("dict", "stream"):
            items = list((own.dict if kind == "stream" else own).items())
            for k in range(len(items) - 1, -1, -1):
                stack.append((items[k][1], number, depth + 1, k, _shown(items[k][0])))
        number += 1


def _nodes(doc: Document, o: ScanOptions, before: tuple = ()) -> Iterator[tuple]:
    for ref, value, error in _wanted(doc, o):
        if error:
            yield *before, ref.num, ref.gen, *[None] * 13, error
            continue
        yield from node_rows(value, (*before, ref.num, ref.gen), (None,))


def _trailer_nodes(doc: Document, o: ScanOptions, between: tuple = ()) -> Iterator[tuple]:
    for order, (section, own) in enumerate(doc.trailers):
        yield from node_rows(own, (section, order, *between), (None,))


def _graph(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    """Rows of ``trailer_nodes``, without object numbers, and of ``nodes``, without places of trailers."""
    yield from _trailer_nodes(doc, o, (None, None))
    yield from _nodes(doc, o, (None, None))


def _streams(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for ref, value, _ in _wanted(doc, o):
        if not isinstance(value, Stream):
            continue
        names = params = data = error = None
        try:
            names, given = doc.filters(value.dict) if o.needs("filters", "params", "decoded", "error") else ([], [])
            names = [_shown(n) for n in names]
            # what is beyond 32 bits is no size of anything and shows as the bound
            small = lambda n: max(-_MAX_SMALL, min(_MAX_SMALL, n))
            params = [{"predictor": small(p.predictor), "columns": small(p.columns), "colors": small(p.colors), "bpc": small(p.bits), "no_early_change": not p.early_change} for p in given]
            data = doc.content(value) if o.needs("decoded", "error") else None
        except PdfError as e:
            error = str(e)
        raw = doc.buf[value.start : value.start + value.length] if o.needs("raw") else None
        yield ref.num, ref.gen, value.start, value.length, raw, names, params, data, error


#: Attributes of pages that views resolve, and whether ancestors lend them (fixed values).
PAGE_KEYS = {"MediaBox": True, "CropBox": True, "Rotate": True, "Resources": True, "BleedBox": False, "TrimBox": False, "ArtBox": False}


def _attributes(doc: Document, own: dict, depth: int) -> list[tuple]:
    """Attributes of a page or an ancestor: depth, key, kind, numbers, int_val, keys."""
    out: list[tuple] = []
    for key in own.keys() & _INHERITED if depth else own.keys() & PAGE_KEYS.keys():
        try:
            value = doc.resolve(own[key])
        except PdfError:
            continue  # what cannot be read does not hide an ancestor's value
        numbers = keys = None
        kind = type(value)
        if kind is list:
            numbers = []
            for v in value:
                if type(v) is Ref:
                    try:
                        v = doc.resolve(v)
                    except PdfError:
                        v = None
                numbers.append(float(v) if type(v) in (int, float) else None)
        elif isinstance(value, dict):
            keys = [_shown(k) for k in value]
        out.append((depth, key, kind_of(value), numbers, value if kind is int else None, keys))
    if len(out) > 1:
        out.sort(key=_place)
    return out


_INHERITED = {k for k, lent in PAGE_KEYS.items() if lent}


def _place(attribute: tuple) -> int:
    return _PLACE[attribute[1]]


_PLACE = {k: n for n, k in enumerate(PAGE_KEYS)}


def _contents(doc: Document, page: dict) -> list[bytes]:
    if "Contents" not in page:
        return []
    found = doc.resolve(page["Contents"])
    parts = [found] if isinstance(found, Stream) else [doc.resolve(v) for v in found] if isinstance(found, list) else []
    if not all(isinstance(p, Stream) for p in parts):
        raise PdfError("/Contents entry is no stream")
    out, size = [], 0
    for p in parts:
        out.append(doc.content(p))
        # a page is one value, and its streams may be one stream many times
        size += len(out[-1])
        if size > MAX_PAGE:
            raise PdfError(f"a page's content exceeds {MAX_PAGE} bytes")
    return out


def _pages(doc: Document) -> Iterator[tuple]:
    try:
        yield from doc.pages()
    except PdfError:
        return


def _page_spine(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    chained = o.needs("parents", "attributes")
    for index, (ref, own) in enumerate(_pages(doc)):
        if not o.holds("page_index", index):
            continue
        attributes, parents = [], []
        for depth, node in enumerate(doc.chain(own, ref) if chained else ()):
            attributes += _attributes(doc, node, depth)
            if type(parent := node.get("Parent")) is Ref:
                parents.append(parent)
        contents = error = None
        try:
            contents = _contents(doc, own) if o.contents and o.needs("contents", "content_error") else None
        except PdfError as e:
            error = str(e)
        yield index, ref.num if ref else None, ref.gen if ref else None, parents, attributes, contents, error


def _operand_json(x: Operand):
    if x.kind == "array":
        return [_operand_json(v) for v in x.value]
    if x.kind == "dict":
        return {k: _operand_json(v) for k, v in x.value.items()}
    shown = {"number": lambda: Literal(x.literal) if _plain(x.literal) else x.value, "name": lambda: str(x.value), "string": lambda: x.value.hex(), "bool": lambda: x.value, "null": lambda: None}
    return {x.kind: shown[x.kind]()}


def _plain(literal: str) -> bool:
    return literal.lstrip("-").isdigit() and not (literal.lstrip("-").startswith("0") and len(literal.lstrip("-")) > 1)


_OPERAND_NAMES = ("kind", "number", "literal", "name", "bytes", "bool_val", "json")


def operand_row(x: Operand) -> dict:
    return dict(zip(_OPERAND_NAMES, operand_values(x), strict=True))


def operand_values(x: Operand) -> tuple:
    """kind, number, literal, name, bytes, bool_val, json."""
    if type(x) is SharedOperand:
        if x.row is None:
            x.row = (x.kind, None, None, None, None, None, to_json(_operand_json(x)))
        return x.row
    kind, value, literal = x
    if kind == "number":
        return kind, value, literal, None, None, None, None
    if kind == "name":
        return kind, None, literal, _shown(value), None, None, None
    if kind == "string":
        return kind, None, literal, None, value, None, None
    if kind == "bool":
        return kind, None, literal, None, None, value, None
    return kind, None, literal, None, None, None, to_json(_operand_json(x)) if kind in ("array", "dict") else None


def operation_rows(content: bytes, operand: Callable[[Operand], object] = operand_row) -> Iterator[tuple]:
    """op_index, operator, offset, operands, image, error; an error ends the rows."""
    index = 0
    try:
        for index, op in enumerate(operations(content)):
            yield index, _shown(op.operator), op.offset, [operand(x) for x in op.operands], op.image, None
            index += 1
    except PdfError as e:
        yield index, None, None, None, None, str(e)


def _content_ops(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for index, (_, own) in enumerate(_pages(doc)):
        if not o.holds("page_index", index):
            continue
        try:
            content = b"\n".join(_contents(doc, own))
        except PdfError as e:
            yield index, 0, None, None, None, None, str(e)
            continue
        for row in operation_rows(content, operand_values):
            yield index, *row


def _info_entries(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    own = doc.dict_of(doc.trailer.get("Info"))
    for key in own or ():
        value = doc.get(own, key)
        if isinstance(value, bytes):
            yield _shown(key), value, None


#: Columns of the information entries that a document usually has (fixed values).
INFO_KEYS = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "mod_date"}


def _info(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    # names that differ only in bytes that cannot be shown are one key, and the last one stays
    own = {k: v for k, v, _ in _info_entries(doc, o)}
    known = [own.pop(k, None) for k in INFO_KEYS]
    yield *known, [{"key": k, "value": v} for k, v in own.items()], None


def _attachments(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    for order, (name, ref, own) in enumerate(doc.attachments()):
        files = doc.get(own, "EF")
        data = error = None
        stream = doc.get(files, "F") if isinstance(files, dict) else None
        if isinstance(stream, Stream) and o.needs("file_bytes", "error"):
            try:
                data = doc.content(stream)
            except PdfError as e:
                error = str(e)
        yield order, name, ref.num if ref else None, ref.gen if ref else None, data, error


def _struct_elems(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    try:
        root = doc.get(doc.catalog(), "StructTreeRoot")
    except PdfError:
        return
    if not isinstance(root, dict):
        return
    roles = doc.get(root, "RoleMap")
    mapped = {k: v for k, v in roles.items() if isinstance(v, Name)} if isinstance(roles, dict) else {}
    seen: set[Ref] = set()

    def kids(own: dict):
        k = own.get("K")
        if isinstance(k, Ref):
            found = doc.get(own, "K")
            if not isinstance(found, list):
                return [k] if isinstance(found, dict) else []
            if k in seen:
                return []
            seen.add(k)
            k = found
        return k if isinstance(k, list) else [k] if isinstance(k, dict) else []

    for order, (_, own, depth) in enumerate(doc._walk(root, seen, kids)):
        names = [v for v in (doc.get(own, "S"), doc.get(own, "Type")) if isinstance(v, Name) and v]
        role = names[0] if names else ""
        yield order, depth, _shown(role), _shown(mapped[role]) if role in mapped else None, None


def _security(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    if doc.handler is not None:
        yield doc.handler.cipher, doc.handler.key, None


def _dumps(doc: Document, o: ScanOptions) -> Iterator[tuple]:
    yield dump(doc, o.dump), None


MAKERS = {
    "documents": _documents, "xref_entries": _xref_entries, "trailers": _trailers, "trailer_nodes": _trailer_nodes, "objects": _objects, "nodes": _nodes, "graph": _graph,
    "streams": _streams, "page_spine": _page_spine, "content_ops": _content_ops, "info_entries": _info_entries, "info": _info,
    "attachments": _attachments, "struct_elems": _struct_elems, "dumps": _dumps, "security": _security,
}


def column_names(table: str) -> list[str]:
    """Columns of a table after doc_id."""
    return [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMAS[table])]


def error_row(table: str, error: str) -> tuple:
    """The row that tells of an error."""
    return (*[None] * (len(column_names(table)) - 1), error)


def open_file(content: bytes | None, options: ScanOptions, later: bool = False) -> Document | Exception:
    """A file's document, or why there is none."""
    try:
        return Document(content or b"", options.max_stream, options.password, later)
    except Exception as e:  # noqa: BLE001
        return e


def rows_in(table: str, doc: Document | Exception, options: ScanOptions) -> Iterator[tuple]:
    """The rows of an opened file, see :func:`rows_of`."""
    if isinstance(doc, PdfError):
        if table == "documents" or options.open_errors:
            yield error_row(table, str(doc))
        return
    if isinstance(doc, Exception):
        yield error_row(table, f"{type(doc).__name__}: {doc}"[:500])
        return
    try:
        yield from MAKERS[table](doc, options)
    except Exception as e:  # noqa: BLE001
        yield error_row(table, f"{type(e).__name__}: {e}"[:500])


def rows_of(table: str, content: bytes | None, options: ScanOptions) -> Iterator[tuple]:
    """The rows of one file; never raises on malformed input.

    A file that cannot be opened gives a row of ``documents`` alone, unless asked otherwise.  Whatever else
    goes wrong ends the file's rows with one that holds the error in its last column.
    """
    yield from rows_in(table, open_file(content, options), options)


def unchecked(doc: Document | Exception) -> bool:
    """Whether a document's password is still to be checked."""
    return isinstance(doc, Document) and doc.handler is not None and doc.handler.unchecked is not None


#: Files, and their bytes, that are opened before their passwords are checked together.
CHECKED_FILES, CHECKED_BYTES = 256, 1 << 20


def opened(files: Iterator[tuple[str, Callable[[], bytes | None]]], options: ScanOptions) -> Iterator[tuple[str, Document | Exception]]:
    """Each file's document in order; encrypted files are opened some ahead, the first after ``FIRST_ROWS``, others when they are due."""
    held: deque[tuple[str, Document | Exception]] = deque()
    size, most = 0, FIRST_ROWS

    def checked() -> Iterator[tuple[str, Document | Exception]]:
        asked = [k for k, (_, doc) in enumerate(held) if unchecked(doc)]
        wrong = refused([held[k][1].handler for k in asked])
        for k in (k for k, no in zip(asked, wrong, strict=True) if no):
            held[k] = (held[k][0], PdfError("password incorrect"))
        # a document keeps what it decoded, so it is let go with its rows
        while held:
            yield held.popleft()

    for doc_id, read in files:
        try:
            content = read()
            doc = open_file(content, options, later=True)
        except OSError as e:
            content, doc = None, PdfError(f"{type(e).__name__}: {e}"[:500])
        if not held and not unchecked(doc):
            yield doc_id, doc
            continue
        held.append((doc_id, doc))
        size += len(content or b"")
        if len(held) >= most or size >= CHECKED_BYTES:
            yield from checked()
            size, most = 0, min(CHECKED_FILES, 2 * most)
    yield from checked()


def _weight(value) -> int:
    """Bytes of all strings in a value, however deep."""
    kind = type(value)
    if kind in _PLAIN:
        return 0
    if kind is bytes or kind is str:
        return len(value)
    if kind is dict:
        value = value.values()
    elif kind is not list and kind is not tuple:
        return len(value) if isinstance(value, (bytes, str)) else 0
    total = 0
    for v in value:
        kind = type(v)
        if kind is bytes or kind is str:
            total += len(v)
        elif kind not in _PLAIN:
            total += _weight(v)
    return total


_PLAIN = {type(None), int, float, bool}


def schema_of(table: str, columns: tuple[str, ...] | None = None) -> StructType:
    """doc_id and the wanted columns of a table."""
    whole = StructType.fromDDL(f"doc_id string, {SCHEMAS[table]}")
    return whole if columns is None else StructType([whole["doc_id"], *[whole[c] for c in columns if c != "doc_id"]])


def batches_of(files: Iterator[tuple[str, Callable[[], bytes | None]]], table: str, options: ScanOptions, schema: StructType) -> Iterator[pa.RecordBatch]:
    """Rows of a table for files (doc_id, how to read it) as Arrow batches of bounded bytes; a file is read when its rows are due."""
    # nesting is bounded by the parser; Python's own frames must not end sooner
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    arrow = to_arrow_schema(schema)
    names = column_names(table)
    pick = None if schema.names[1:] == names else [names.index(c) for c in schema.names[1:]]
    picked = None if pick is None or len(pick) < 2 else itemgetter(*pick)
    last = schema.names[-1] if schema.names[-1].endswith("error") else None
    # numbers and truth values have no bytes to count, and a document's name is counted once for each row
    heavy = [k for k, f in enumerate(arrow) if k and not pa.types.is_primitive(f.type) and f.name != "kind"]
    held: list[tuple] = []
    weight, most = 0, FIRST_ROWS

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def checked(row: tuple) -> list[tuple]:
        """The row itself, or that it holds a value which its columns cannot."""
        try:
            packed([row])
            return [row]
        except _UNFIT as e:
            return [(row[0], *[None] * (len(row) - 2), f"{type(e).__name__}: {e}"[:500])] if last else []

    def batch() -> pa.RecordBatch:
        try:
            return packed(held)
        except _UNFIT:
            return packed([r for row in held for r in checked(row)])

    for doc_id, doc in opened(files, options):
        own_weight = len(doc_id or "") + _KIND_BYTES
        for row in rows_in(table, doc, options):
            row = (doc_id, *(row if pick is None else picked(row) if picked else [row[k] for k in pick]))
            held.append(row)
            weight += own_weight
            for k in heavy:
                value = row[k]
                if value is not None:
                    weight += len(value) if type(value) in (bytes, str) else _weight(value)
            if len(held) >= most or weight >= BATCH_BYTES:
                yield batch()
                held, weight, most = [], 0, min(BATCH_ROWS, 2 * most)
    if held:
        yield batch()


#: Bytes of a column of kinds, about.
_KIND_BYTES = 5
_UNFIT = (pa.ArrowException, OverflowError, ValueError, TypeError)


def scan(files: DataFrame, table: str, options: ScanOptions | None = None, columns: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """One table of a corpus given as rows (doc_id, content); of ``columns`` only these, and only what they need is done."""
    ship(files.sparkSession)
    options = options or ScanOptions()
    if columns is not None:
        options = replace(options, columns=tuple(columns))
    schema = schema_of(table, options.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((doc_id.as_py(), content.as_py) for got in batches for doc_id, content in zip(got.column(0), got.column(1), strict=True))
        return batches_of(found, table, options, schema)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Files under a path as rows (doc_id, content); filters on length and time prune files before they are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.load(path).select(F.col("path").alias("doc_id"), "content", "length", "modificationTime")
