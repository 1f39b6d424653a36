"""Queries that carry table rows through PDF files and read them back.

Each takes rows of the shared tables, writes them into PDF files that use one
feature of the format, scans those files, and returns what it read.  The SQL
beside it computes the same from the tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import codecs, tables
from pagequarry.functions import text as T
from pagequarry.operators import packed, trees, values, views
from pagequarry.sources.datasource import folder_of, read_spread, register
from pagequarry.sources.scan import ScanOptions, scan
from pagequarry.streaming.ingest import ingest, stream_rows
from pagequarry.testing import pdfwriter as P
from pagequarry.workspace import shared_folder, ship, stage_rows, temporary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Bytes of rows that are taken as Python values at once.
FILES_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(rows: DataFrame, key: str, write: Callable[[dict], bytes] | None = None, write_all: Callable[[list[dict]], list[bytes]] | None = None) -> DataFrame:
    """One file per row, as (doc_id, content); ``write_all`` makes those of several rows together."""
    write_all = write_all or (lambda records: [write(r) for r in records])
    # by the key: rows that go round by turns are sorted first, whatever they hold
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many rows at once as make 1 MB of the batch, so that rows and files of large documents are few
            step = max(1, min(200, batch.num_rows * FILES_BYTES // max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                records = batch.slice(k, step).to_pylist()
                yield pa.RecordBatch.from_pydict({"doc_id": [str(r[key]) for r in records], "content": pa.array(write_all(records), pa.binary())})

    return rows.mapInArrow(run, "doc_id string, content binary")


def grouped_files(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str, write: Callable[[dict], bytes]) -> DataFrame:
    """One file per key, as (doc_id, content): ``write`` takes the key and, under a name, the rows of it in order.

    Rows are dealt by key once and sorted there, so that a key's rows stand together and are no value of their own.
    """
    # as many tasks as cores, as in files_of: each of more would start Python anew, and sorting spills
    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key, *order).select(key, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, contents, size = [], [], 0
        packed = lambda: pa.RecordBatch.from_pydict({"doc_id": ids, "content": pa.array(contents, pa.binary())})
        each = (row for b in batches for row in zip(*(_plain_values(c) for c in b.columns), strict=True))
        for own, found in groupby(each, key=itemgetter(0)):
            body = write({key: own, name: [dict(zip(columns, row[1:], strict=True)) for row in found]})
            ids.append(str(own))
            contents.append(body)
            size += len(body)
            if len(ids) >= 200 or size >= FILES_BYTES:
                yield packed()
                ids, contents, size = [], [], 0
        if ids:
            yield packed()

    return dealt.mapInArrow(run, "doc_id string, content binary")


def _plain_values(column: pa.Array) -> list:
    """Values as Python has them, nulls too; columns of numbers without nulls at once."""
    return column.to_pylist() if column.null_count or not pa.types.is_primitive(column.type) or pa.types.is_temporal(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _doc(name: str = "doc_id"):
    return F.col("doc_id").cast("long").alias(name)


def _info_file(title: bytes, author: bytes | None = None, more: bytes = b"") -> bytes:
    info = b"<</Title " + title + (b" /Author " + author if author is not None else b"") + more + b">>"
    return P.Writer().classic({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>", 3: info}, b"/Root 1 0 R /Info 3 0 R").out


@query("SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS author FROM customer")
def q01_doc_info(spark, sf_dir):
    """Information dictionaries, one file per customer."""
    write = lambda r: _info_file(P.literal(r["c_name"].encode()), P.literal(r["c_mktsegment"].encode()))
    files = files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", write)
    return views.document_info(files).select(_doc(), "title", "author")


# --- codecs ---

_TEXT_SQL = "SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha FROM documents"


def _text_files(spark, sf_dir, body: Callable[[bytes], bytes]) -> DataFrame:
    return files_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", lambda r: P.one_stream(body(r["text"].encode())))


def _digests(streams: DataFrame) -> DataFrame:
    return streams.where("num = 3").select(_doc(), F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("sha"))


@query(_TEXT_SQL)
def q02_flate(spark, sf_dir):
    """Document texts in Flate streams."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(zlib.compress(t), b"/Filter /FlateDecode")), "streams"))


@query(_TEXT_SQL)
def q03_ascii_hex(spark, sf_dir):
    """Document texts in hexadecimal streams."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(t.hex().encode() + b">", b"/Filter /AHx")), "streams"))


@query(_TEXT_SQL)
def q04_ascii85(spark, sf_dir):
    """Document texts in base-85 streams."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(P.ascii85(t), b"/Filter /ASCII85Decode")), "streams"))


@query(_TEXT_SQL)
def q05_run_length(spark, sf_dir):
    """Document texts in run-length streams."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(P.run_length(t), b"/Filter [/RunLengthDecode]")), "streams"))


@query(_TEXT_SQL)
def q06_lzw(spark, sf_dir):
    """Document texts in LZW streams."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(P.lzw(t), b"/Filter /LZWDecode")), "streams"))


@query(_TEXT_SQL)
def q07_filter_chain(spark, sf_dir):
    """Document texts through a chain with abbreviated keys and names."""
    return _digests(scan(_text_files(spark, sf_dir, lambda t: P.stream(P.ascii85(zlib.compress(t)), b"/F [/A85 /Fl] /DP [null <</Predictor 1>>]")), "streams"))


@query("SELECT doc_id, CAST((octet_length(encode(text)) + 63) // 64 * 64 AS BIGINT) AS n_bytes, sha256(text) AS sha FROM documents")
def q08_predictors(spark, sf_dir):
    """Document texts with all five PNG predictors."""
    body = lambda t: P.stream(zlib.compress(P.png_rows(t, 64)), b"/Filter /FlateDecode /DecodeParms <</Predictor 15 /Columns 64>>")
    streams = scan(_text_files(spark, sf_dir, body), "streams").where("num = 3")
    text = F.unhex(F.regexp_replace(F.hex("decoded"), "(?:00)+$", ""))
    return streams.select(_doc(), F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))


@query("SELECT doc_id, octet_length(encode(text)) > 2000 AS over_cap FROM documents")
def q09_stream_cap(spark, sf_dir):
    """A cap on decoded bytes turns longer streams into error rows."""
    files = _text_files(spark, sf_dir, lambda t: P.stream(zlib.compress(t), b"/Filter /FlateDecode"))
    return scan(files, "streams", ScanOptions(max_stream=2000)).where("num = 3").select(_doc(), F.col("error").isNotNull().alias("over_cap"))


# --- text and dates ---


@query("SELECT c_custkey AS doc_id, c_name || ' éüñ' AS title FROM customer")
def q10_document_encoding(spark, sf_dir):
    """Titles in document encoding."""
    files = files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", lambda r: _info_file(P.literal((r["c_name"] + " éüñ").encode("latin-1"))))
    return views.document_info(files).select(_doc(), "title")


@query("SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha FROM documents")
def q11_unicode_text(spark, sf_dir):
    """Whole texts as UTF-16 of either order, or UTF-8, by the document's number."""

    def write(r):
        mark, code = [(b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")][r["doc_id"] % 3]
        return _info_file(P.hexed(mark + r["text"].encode(code)))

    files = files_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", write)
    return views.document_info(files).select(_doc(), F.length("title").cast("long").alias("n_chars"), F.sha2(F.col("title").cast("binary"), 256).alias("sha"))


def _date_files(rows: DataFrame, key: str, stamp: str, tail: str) -> DataFrame:
    dated = rows.select(key, F.date_format(stamp, "yyyyMMddHHmmss").alias("d"))
    return files_of(dated, key, lambda r: _info_file(b"(x)", more=b" /CreationDate " + P.literal(f"D:{r['d']}{tail}".encode())))


@query("SELECT o_orderkey AS doc_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch_s FROM orders")
def q12_dates(spark, sf_dir):
    """Dates without an offset."""
    files = _date_files(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "Z")
    return views.document_info(files).select(_doc(), F.unix_timestamp("creation_date").alias("epoch_s"))


@query("SELECT event_id AS doc_id, CAST(floor(epoch(ts)) AS BIGINT) - 19800 AS epoch_s, CAST(19800 AS INTEGER) AS tz_s FROM events")
def q13_date_offsets(spark, sf_dir):
    """Dates with an offset."""
    files = _date_files(table(spark, sf_dir, "events"), "event_id", "ts", "+05'30'")
    return views.document_info(files).select(_doc(), F.unix_timestamp("creation_date").alias("epoch_s"), F.col("creation_tz_s").alias("tz_s"))


@query(
    "SELECT p_partkey AS doc_id, p_size % 3 <> 0 AS is_text, CASE WHEN p_size % 3 = 0 THEN '' WHEN length(p_name) > 8 "
    "THEN substr(p_name, 1, 8) || '…' ELSE p_name END AS shown FROM part"
)
def q14_heuristics(spark, sf_dir):
    """Text or binary, and previews."""
    write = lambda r: _info_file(P.hexed(b"\x01" * (r["p_size"] % 3 == 0) + r["p_name"].encode()))
    entries = scan(files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", write), "info_entries")
    return entries.select(_doc(), T.looks_like_text(F.col("bytes_val")).alias("is_text"), T.preview(F.col("bytes_val"), 8).alias("shown"))


# --- pages ---


def _lines_files(spark, sf_dir, columns: list[str], write: Callable[[dict], bytes]) -> DataFrame:
    """One file per order; ``write`` takes its number and its lines, in order, of the columns asked for."""
    # all columns of the order are sorted by, so lines of one number have one order
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE)
    return grouped_files(rows, "l_orderkey", _LINE, columns, "lines", write)


_LINE = ["l_linenumber", "l_extendedprice", "l_quantity"]


_LINES = "WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity) - 1 AS INTEGER) AS page_index FROM lineitem) "


def _page_files(spark, sf_dir, attributes: Callable[[dict], bytes], root: bytes = b"") -> DataFrame:
    return _lines_files(spark, sf_dir, _LINE, lambda r: P.page_file([(attributes(x), []) for x in r["lines"]], root))


@query("SELECT l_orderkey AS doc_id, CAST(count(*) AS INTEGER) AS page_count FROM lineitem GROUP BY l_orderkey")
def q15_page_tree(spark, sf_dir):
    """Pages in nested nodes of two."""

    def write(r):
        n = len(r["lines"])
        objects = {1: b"<</Type /Catalog /Pages 2 0 R>>"}
        leaves = list(range(100, 100 + n))
        groups = [leaves[k : k + 2] for k in range(0, n, 2)]
        for k, own in enumerate(groups):
            objects[10 + k] = b"<</Type /Pages /Parent 2 0 R /Count %d /Kids [%s %d 0 R]>>" % (len(own), b" ".join(b"%d 0 R" % x for x in own), own[0])
            objects |= {x: b"<</Type /Page /Parent %d 0 R>>" % (10 + k) for x in own}
        objects[2] = b"<</Type /Pages /Count %d /Kids [%s]>>" % (n, b" ".join(b"%d 0 R" % (10 + k) for k in range(len(groups))))
        return P.Writer().classic(objects).out

    return scan(_lines_files(spark, sf_dir, ["l_linenumber"], write), "documents", columns=["page_count"]).select(_doc(), "page_count")


@query(
    _LINES + "SELECT l_orderkey AS doc_id, page_index, least(l_quantity, -1.5) AS llx, least(l_extendedprice, 7) AS lly, "
    "greatest(l_quantity, -1.5) AS urx, greatest(l_extendedprice, 7) AS ury FROM l"
)
def q16_boxes(spark, sf_dir):
    """Boxes with corners in any order."""
    files = _page_files(spark, sf_dir, lambda x: b"/MediaBox [%s %s -1.5 7]" % (repr(x["l_quantity"]).encode(), repr(x["l_extendedprice"]).encode()))
    return views.pages(files, contents=False, columns=("page_index", "media_box")).select(_doc(), "page_index", "media_box.*")


@query(
    _LINES + "SELECT l_orderkey AS doc_id, page_index, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 100.0 END AS width, "
    "CAST(CASE WHEN l_linenumber % 3 = 0 THEN 180 ELSE 90 END AS INTEGER) AS rotation FROM l"
)
def q17_inheritance(spark, sf_dir):
    """Attributes of the root unless a page has its own."""

    def own(x):
        box = b"/MediaBox [0 0 %s 5]" % repr(x["l_quantity"]).encode() if x["l_linenumber"] % 2 == 0 else b""
        return box + (b" /Rotate 180" if x["l_linenumber"] % 3 == 0 else b"")

    files = _page_files(spark, sf_dir, own, b"/MediaBox [0 0 100 200] /Rotate 90")
    return views.pages(files, contents=False, columns=("page_index", "media_box", "rotation")).select(_doc(), "page_index", (F.col("media_box.urx") - F.col("media_box.llx")).alias("width"), "rotation")


@query(
    _LINES + ", r AS (SELECT *, 90 * l_linenumber - 180 + CASE WHEN l_linenumber % 4 = 3 THEN 45 ELSE 0 END AS x FROM l) "
    "SELECT l_orderkey AS doc_id, page_index, CAST(CASE WHEN ((x % 360) + 360) % 360 % 90 = 0 THEN ((x % 360) + 360) % 360 ELSE 0 END AS INTEGER) AS rotation FROM r"
)
def q18_rotation(spark, sf_dir):
    """Negative, large and odd rotations."""
    files = _page_files(spark, sf_dir, lambda x: b"/Rotate %d" % (90 * x["l_linenumber"] - 180 + 45 * (x["l_linenumber"] % 4 == 3)))
    return views.pages(files, contents=False, columns=("page_index", "rotation")).select(_doc(), "page_index", "rotation")


@query(
    "WITH d AS (SELECT doc_id, text, CAST(length(text) // 3 AS INTEGER) AS k FROM documents) SELECT doc_id, sha256(substr(text, 1, k) || chr(10) || "
    "substr(text, k + 1, k) || chr(10) || substr(text, 2 * k + 1)) AS sha FROM d"
)
def q19_page_content(spark, sf_dir):
    """Content split over three streams, joined by line feeds."""

    def write(r):
        t, k = r["text"], len(r["text"]) // 3
        return P.page_file([(b"", [t[:k].encode(), t[k : 2 * k].encode(), t[2 * k :].encode()])])

    files = files_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", write)
    return views.pages(files).select(_doc(), F.sha2("content", 256).alias("sha"))


@query(
    "SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 1 THEN 'ExtGState,' ELSE '' END || 'Font' || CASE WHEN p_size % 3 = 0 THEN ',XObject' ELSE '' END AS names FROM part"
)
def q20_resources(spark, sf_dir):
    """Names of inherited resources, sorted."""

    def write(r):
        keys = [b"/XObject <<>>"] * (r["p_size"] % 3 == 0) + [b"/Font <<>>"] + [b"/ExtGState <<>>"] * (r["p_size"] % 2)
        return P.page_file([(b"", [])], b"/Resources <<" + b" ".join(keys) + b">>")

    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", write)
    return views.pages(files, contents=False).select(_doc(), F.array_join("resource_keys", ",").alias("names"))


# --- cross-reference sections ---

_PART_SQL = "SELECT p_partkey AS doc_id, p_name AS title FROM part"
_BASE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>"}


@query(_PART_SQL)
def q21_xref_stream(spark, sf_dir):
    """Cross-reference streams."""
    write = lambda r: P.Writer("2.0").packed({**_BASE, 3: b"<</Title %s>>" % P.literal(r["p_name"].encode())}, {}, b"/Root 1 0 R /Info 3 0 R").out
    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", write)
    return views.document_info(files).select(_doc(), "title")


@query(_PART_SQL)
def q22_object_stream(spark, sf_dir):
    """Objects packed in an object stream."""
    write = lambda r: P.Writer("1.5").packed({}, {**_BASE, 3: b"<</Title %s>>" % P.literal(r["p_name"].encode())}, b"/Root 1 0 R /Info 3 0 R").out
    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", write)
    return views.document_info(files).select(_doc(), "title")


def _events_by_user(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))


@query("SELECT user_id AS doc_id, max(event_id) AS value, count(*) AS versions FROM events GROUP BY user_id")
def q23_updates(spark, sf_dir):
    """Incremental updates: the newest definition of an object is in force."""

    def write(r):
        w = P.Writer()
        for k, x in enumerate(r["ids"]):
            w.classic({**(_BASE if k == 0 else {}), 5: b"%d" % x}, size=6)
        return w.out

    files = stage_rows(files_of(_events_by_user(spark, sf_dir), "user_id", write), "files")
    entries = scan(files, "xref_entries").where("num = 5")
    versions = entries.groupBy("doc_id").agg(F.count("*").alias("versions"))
    newest = views.live_entries(entries).select("doc_id", "num", "gen")
    values = scan(files, "nodes").where("num = 5 and node_id = 0").select("doc_id", "num", "gen", "int_val")
    return newest.join(values, ["doc_id", "num", "gen"]).join(versions, "doc_id").select(_doc(), F.col("int_val").alias("value"), "versions")


@query("SELECT c_custkey AS doc_id, c_name AS title FROM customer")
def q24_trailers(spark, sf_dir):
    """Older trailers fill in what newer ones lack."""

    def write(r):
        w = P.Writer().classic({**_BASE, 3: b"<</Title %s>>" % P.literal(r["c_name"].encode())}, b"/Root 1 0 R /Info 3 0 R")
        return w.classic({4: b"null"}).out

    files = files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", write)
    return views.document_info(files).select(_doc(), "title")


@query("SELECT user_id AS doc_id, min(event_id) AS value, true AS recovered FROM events GROUP BY user_id")
def q25_recovery(spark, sf_dir):
    """Files without an index: of several copies of an object the first is in force."""

    def write(r):
        body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in [*_BASE.items(), *((5, b"%d" % x) for x in r["ids"])])
        return b"%PDF-1.4\n" + body + b"trailer\n<</Root 1 0 R>>\nstartxref\n9999999\n%%EOF"

    files = stage_rows(files_of(_events_by_user(spark, sf_dir), "user_id", write), "files")
    state = scan(files, "documents", columns=["recovered"])
    return scan(files, "nodes").where("num = 5 and node_id = 0").join(state, "doc_id").select(_doc(), F.col("int_val").alias("value"), "recovered")


# --- content streams ---


@query(
    "SELECT user_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'Tc' ELSE 'Tw' END AS operator, count(*) AS n, max(value) AS most FROM events GROUP BY ALL"
)
def q26_content_operations(spark, sf_dir):
    """Operations of content streams, counted by operator."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "value")).alias("events"))
    write = lambda r: P.page_file([(b"", [b"\n".join(b"%s T%s" % (repr(x["value"]).encode(), b"cw"[x["event_id"] % 2 : x["event_id"] % 2 + 1]) for x in r["events"])])])
    ops = scan(files_of(rows, "user_id", write), "content_ops")
    return ops.groupBy(_doc(), "operator").agg(F.count("*").alias("n"), F.max(F.get("operands", 0)["number"]).alias("most"))


@query("SELECT p_partkey AS doc_id, replace(p_name, ' ', '') AS joined FROM part")
def q27_shown_text(spark, sf_dir):
    """Strings of arrays with kerning."""
    write = lambda r: P.page_file([(b"", [b"BT [" + b" -120 ".join(P.literal(w.encode()) for w in r["p_name"].split(" ")) + b"] TJ ET"])])
    ops = scan(files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", write), "content_ops").where("operator = 'TJ'")
    parts = F.from_json(F.get("operands", 0)["json"], "array<struct<string:string,number:double>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda x: x["string"].isNotNull()), lambda x: x["string"]), "")
    return ops.select(_doc(), F.decode(F.unhex(joined), "UTF-8").alias("joined"))


@query("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS mcid FROM lineitem")
def q28_marked_content(spark, sf_dir):
    """Marked-content numbers."""
    write = lambda r: P.page_file([(b"", [b"\n".join(b"/P <</MCID %d>> BDC EMC" % x["l_linenumber"] for x in r["lines"])])])
    ops = scan(_lines_files(spark, sf_dir, ["l_linenumber"], write), "content_ops", columns=["operator", "operands"]).where("operator = 'BDC'")
    return ops.select(_doc(), F.get_json_object(F.get("operands", 1)["json"], "$.MCID.number").cast("long").alias("mcid"))


@query("SELECT p_partkey AS doc_id, octet_length(encode(p_name)) AS n_bytes, sha256(p_name) AS sha FROM part")
def q29_inline_images(spark, sf_dir):
    """Bytes of inline images."""
    write = lambda r: P.page_file([(b"", [b"q BI /W 1 /H 1 ID " + r["p_name"].encode() + b"\nEI Q"])])
    ops = scan(files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", write), "content_ops").where("operator = 'EI'")
    return ops.select(_doc(), F.octet_length("image").cast("long").alias("n_bytes"), F.sha2("image", 256).alias("sha"))


# --- other trees, snapshots, encryption ---


@query("SELECT page_id AS doc_id, url AS name, sha256(html) AS sha FROM pages")
def q30_attachments(spark, sf_dir):
    """Attachments in a name tree with kids."""

    def write(r):
        objects = {
            1: b"<</Type /Catalog /Pages 2 0 R /Names <</EmbeddedFiles 3 0 R>>>>", 2: _BASE[2], 3: b"<</Kids [4 0 R 4 0 R]>>",
            4: b"<</Names [%s 5 0 R (odd)]>>" % P.literal(r["url"].encode()), 5: b"<</Type /Filespec /EF <</F 6 0 R>>>>",
            6: P.stream(zlib.compress(r["html"].encode()), b"/Filter /FlateDecode"),
        }
        return P.Writer().classic(objects).out

    files = files_of(table(spark, sf_dir, "pages"), "page_id", write)
    return views.embedded_files(files).select(_doc(), "name", F.sha2("file_bytes", 256).alias("sha"))


@query(
    "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 0 AS depth, 'StructTreeRoot' AS role, CAST(NULL AS VARCHAR) AS mapped_role, 1 AS n FROM region "
    "UNION ALL SELECT n_regionkey, 1, 'Nation', 'Sect', count(*) FROM nation GROUP BY n_regionkey "
    "UNION ALL SELECT n_regionkey, 2, 'P', NULL, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey"
)
def q31_structure_tree(spark, sf_dir):
    """Structure trees: regions, nations, suppliers, with a role map."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers")), "n_nationkey", "left"
    )
    rows = nations.groupBy("n_regionkey").agg(F.collect_list(F.coalesce("suppliers", F.lit(0))).alias("suppliers"))
    rows = table(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "suppliers")

    def write(r):
        free, kids = 10, []
        objects = {1: b"<</Type /Catalog /Pages 2 0 R /StructTreeRoot 3 0 R>>", 2: _BASE[2]}
        for count in r["suppliers"] if r["suppliers"] is not None else []:
            own, free = free, free + 1
            kids.append(b"%d 0 R" % own)
            objects[own] = b"<</S /Nation /K [%s 7]>>" % b" ".join(b"<</S /P /K 0>>" for _ in range(count))
        objects[3] = b"<</Type /StructTreeRoot /RoleMap <</Nation /Sect>> /K 4 0 R>>"
        objects[4] = b"[%s]" % b" ".join([*kids, *kids])
        return P.Writer().classic(objects).out

    tree = views.structure(files_of(rows, "r_regionkey", write))
    return tree.groupBy(_doc(), "depth", "role", "mapped_role").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, n_name AS title, '1.7' AS version, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def q32_dump(spark, sf_dir):
    """Snapshots, taken apart again by JSON functions."""
    write = lambda r: _info_file(P.literal(r["n_name"].encode()), more=b" /Region %d" % r["n_regionkey"])
    dumps = scan(files_of(table(spark, sf_dir, "nation"), "n_nationkey", write), "dumps")
    part = lambda path: F.get_json_object("json", "$.objects['3 0'].dict." + path)
    return dumps.select(_doc(), part("Title.text").alias("title"), F.get_json_object("json", "$.version").alias("version"), part("Region.int").cast("long").alias("region"))


@query("SELECT l_orderkey AS doc_id, CAST(2 + 2 * count(*) AS BIGINT) AS n_objects, count(*) AS n_streams FROM lineitem GROUP BY l_orderkey")
def q33_object_counts(spark, sf_dir):
    """Live objects and streams of each file."""
    files = _lines_files(spark, sf_dir, ["l_linenumber"], lambda r: P.page_file([(b"", [b"q Q"]) for _ in r["lines"]]))
    counts = scan(files, "objects", columns=["kind", "error"]).where("error is null").groupBy("doc_id")
    return counts.agg(F.count("*").alias("n_objects"), F.count_if(F.col("kind") == "stream").alias("n_streams")).select(_doc(), "n_objects", "n_streams")


@query("SELECT p_partkey AS doc_id, CAST(3 AS BIGINT) AS num, 'changed' AS change FROM part WHERE p_size % 5 = 0")
def q34_diff(spark, sf_dir):
    """Objects that differ between two versions of a file."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = files_of(parts, "p_partkey", lambda r: _info_file(P.literal(r["p_name"].encode())))
    new = files_of(parts, "p_partkey", lambda r: _info_file(P.literal(r["p_name"].encode() + b"!" * (r["p_size"] % 5 == 0))))
    return views.diff(scan(old, "objects"), scan(new, "objects")).select(_doc(), "num", "change")


_SECRET_SQL = "SELECT p_partkey AS doc_id, octet_length(encode(p_name)) AS n_bytes, sha256(p_name) AS sha FROM part"


def _secret(spark, sf_dir, method: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    files = files_of(rows, "p_partkey", write_all=lambda records: P.encrypted_files([(r["p_name"].encode(), method, b"%d" % r["p_partkey"]) for r in records]))
    return _digests(scan(files, "streams"))


@query(_SECRET_SQL)
def q35_rc4_version2(spark, sf_dir):
    """Streams under RC4, version 2."""
    return _secret(spark, sf_dir, "V2")


@query(_SECRET_SQL)
def q36_rc4_version4(spark, sf_dir):
    """Streams under RC4 by a crypt filter."""
    return _secret(spark, sf_dir, "V2F")


@query(_SECRET_SQL)
def q37_aes128(spark, sf_dir):
    """Streams under AES with 128 bits."""
    return _secret(spark, sf_dir, "AESV2")


@query(_SECRET_SQL)
def q38_aes256(spark, sf_dir):
    """Streams under AES with 256 bits."""
    return _secret(spark, sf_dir, "AESV3")


@query(_TEXT_SQL)
def q39_streaming(spark, sf_dir):
    """Files that arrive as a stream give the same rows."""
    files = _text_files(spark, sf_dir, lambda t: P.stream(zlib.compress(t), b"/Filter /FlateDecode"))
    landed = stage_rows(files, "landing")
    source = landed.inputFiles()[0].rsplit("/", 1)[0]
    target = f"{shared_folder(spark)}/streamed-{spark.sparkContext.applicationId}-{abs(hash(source))}"
    ingest_rows = stream_rows(spark, source)
    ingest(ingest_rows, "streams", target, target + "-state")
    return _digests(spark.read.parquet(target))


@query("SELECT c_custkey AS doc_id, c_custkey % 7 = 0 AS dangling FROM customer")
def q40_dangling(spark, sf_dir):
    """References to objects that are not there."""
    write = lambda r: P.Writer().classic({**_BASE, 5: b"<</Next %d 0 R>>" % (99 if r["c_custkey"] % 7 == 0 else 2)}).out
    nodes = stage_rows(scan(files_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", write), "nodes"), "nodes")
    return views.references(nodes).where("key = 'Next'").select(_doc(), "dangling")


@query("SELECT c_custkey AS doc_id, CAST(6 AS BIGINT) AS num FROM customer WHERE c_custkey % 5 = 0")
def q41_unreferenced(spark, sf_dir):
    """Objects that nothing names."""

    def write(r):
        more = {6: b"(lost)"} if r["c_custkey"] % 5 == 0 else {}
        return P.Writer().classic({**_BASE, **more}).out

    files = stage_rows(files_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", write), "files")
    return views.unreferenced(stage_rows(scan(files, "nodes"), "nodes"), scan(files, "trailers")).select(_doc(), "num")


@query("SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'classical' ELSE 'stream' END AS xref_format FROM part")
def q42_xref_formats(spark, sf_dir):
    """Files by the form of their index.

    A hybrid file's trailer takes over the keys of its stream's dictionary, its
    /Type among them, and so counts as a stream.
    """

    def write(r):
        if r["p_size"] % 3 == 1:
            return P.Writer().packed(_BASE, {}).out
        w = P.Writer()
        if r["p_size"] % 3 == 0:
            return w.classic(_BASE).out
        w.packed(_BASE, {7: b"(packed)"})
        at, w.last = w.last, None
        return w.classic({5: b"null", **_BASE}, b"/Root 1 0 R /XRefStm %d" % at).out

    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", write)
    return scan(files, "documents", columns=["xref_format"]).select(_doc(), "xref_format")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN '1.7' ELSE '2.0' END AS effective_version FROM part")
def q43_versions(spark, sf_dir):
    """The later of header's and catalog's version."""
    write = lambda r: P.Writer("1.7").classic({1: b"<</Type /Catalog /Pages 2 0 R /Version /%s>>" % (b"2.0" if r["p_size"] % 2 else b"1.3"), 2: _BASE[2]}).out
    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", write)
    return views.effective_version(scan(files, "documents", columns=["header_version", "catalog_version"])).select(_doc(), "effective_version")


@query("SELECT c_custkey AS doc_id, c_acctbal AS amount, c_name AS label FROM customer")
def q44_typed_values(spark, sf_dir):
    """Typed dictionary values, directly and through references."""

    def write(r):
        return P.Writer().classic({**_BASE, 5: b"<</Amount %s /Label 6 0 R>>" % repr(r["c_acctbal"]).encode(), 6: P.literal(r["c_name"].encode())}).out

    nodes = stage_rows(scan(files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name"), "c_custkey", write), "nodes"), "nodes")
    values = views.dict_values(nodes).where("num = 5")
    number = F.coalesce(F.col("real_val"), F.col("int_val").cast("double"))
    pick = lambda key, v: F.max(F.when(F.col("key") == key, v))
    return values.groupBy("doc_id").agg(pick("Amount", number).alias("amount"), pick("Label", T.decode_text(F.col("bytes_val"))).alias("label")).select(_doc(), "amount", "label")


@query("SELECT c_custkey AS doc_id, c_custkey % 3 <> 0 AS opened FROM customer")
def q45_hostile_files(spark, sf_dir):
    """Broken files give error rows and never end a job."""

    def write(r):
        whole = _info_file(b"(x)")
        return whole if r["c_custkey"] % 3 else [b"", b"%PDF-1.7", whole[:40], b"<<" * 3000][r["c_custkey"] // 3 % 4]

    files = files_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", write)
    return scan(files, "documents", columns=["error"]).select(_doc(), F.col("error").isNull().alias("opened"))


@query("SELECT c_custkey AS doc_id, c_custkey % 5 <> 0 AS failed FROM customer")
def q46_hostile_objects(spark, sf_dir):
    """Objects that cannot be read give rows with an error beside those that can."""
    bad = [b"(well)", b"[5 99999999999999999999 R]", b"{", b"99999999999999999999", b"<</A 1 2>>"]
    write = lambda r: P.Writer().classic({**_BASE, 3: bad[r["c_custkey"] % 5]}).out
    files = files_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", write)
    return scan(files, "objects", columns=["num", "error"]).where("num = 3").select(_doc(), F.col("error").isNotNull().alias("failed"))


@query("SELECT c_custkey AS doc_id, c_name AS keywords, c_mktsegment AS segment, make_timestamp(2020 + c_custkey % 5, 3, 4, 5, 6, 7.0) AS modified FROM customer")
def q47_custom_info(spark, sf_dir):
    """Information entries of other names, keywords and the date of the last change."""

    def write(r):
        date = b"(D:%d0304050607Z)" % (2020 + r["c_custkey"] % 5)
        return _info_file(b"()", more=b" /Keywords " + P.literal(r["c_name"].encode()) + b" /Segment " + P.literal(r["c_mktsegment"].encode()) + b" /ModDate " + date)

    info = views.document_info(files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", write))
    return info.select(_doc(), "keywords", F.col("custom")["Segment"].alias("segment"), F.col("mod_date").cast("timestamp_ntz").alias("modified"))


@query(
    "SELECT c_custkey AS doc_id, CAST(c_custkey % 7 AS DOUBLE) AS bleed_llx, CAST(c_custkey % 7 + 100 AS DOUBLE) AS bleed_urx, "
    "CASE WHEN c_custkey % 2 = 0 THEN 5.0::DOUBLE END AS trim_lly, 20.5::DOUBLE AS art_ury FROM customer"
)
def q48_page_boxes(spark, sf_dir):
    """Boxes that pages do not inherit, corners in any order."""

    def write(r):
        k = r["c_custkey"] % 7
        trim = b" /TrimBox [1 30 9 5]" if r["c_custkey"] % 2 == 0 else b""
        return P.page_file([(b"/BleedBox [%d 0 %d 50] /ArtBox [0 20.5 10 1]" % (k + 100, k) + trim, [])], b"/TrimBox [0 0 1 1]")

    pages = views.pages(files_of(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", write), contents=False)
    return pages.select(_doc(), F.col("bleed_box.llx").alias("bleed_llx"), F.col("bleed_box.urx").alias("bleed_urx"), F.col("trim_box.lly").alias("trim_lly"), F.col("art_box.ury").alias("art_ury"))


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS sha FROM documents")
def q49_raw_bytes(spark, sf_dir):
    """Raw bytes of streams, before any filter."""
    rows = scan(_text_files(spark, sf_dir, lambda t: P.stream(t)), "streams", columns=["num", "raw"])
    return rows.where("num = 3").select(_doc(), F.sha2("raw", 256).alias("sha"))


def _library(files: DataFrame, name: str) -> str:
    """A folder of the shared one with a file for each row (doc_id, content); gone when the session ends."""
    spark = files.sparkSession
    register(spark)
    path = temporary_path(spark, name)
    _write_spread(files.withColumn("doc_id", F.concat("doc_id", F.lit(".pdf"))), path)
    return path


#: Folders that written files are spread over.
FOLDERS = 1024


def _write_spread(rows: DataFrame, path: str, suffix: str = "") -> None:
    """A file for each row (doc_id, content or json), each folder written by one task."""
    place = folder_of(F.concat("doc_id", F.lit(suffix)), FOLDERS)
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, place)
    rows.write.format("pagequarry").option("suffix", suffix).option("folders", FOLDERS).mode("append").save(path)


def _number_of_file(column: str = "doc_id"):
    return F.regexp_extract(column, r"(\d+)\.pdf", 1).cast("long").alias("doc_id")


@query("SELECT c_custkey AS doc_id, c_name AS title, c_custkey % 4 = 0 AS has_stream FROM customer WHERE c_custkey % 10 <> 7")
def q50_file_source(spark, sf_dir):
    """Files in a folder through the data source, with declared columns and pushed conditions on files and objects."""

    def write(r):
        more = {4: P.stream(zlib.compress(bytes(2_000)), b"/Filter /FlateDecode")} if r["c_custkey"] % 4 == 0 else {}
        return P.Writer().classic({**_BASE, 3: b"<</Title %s>>" % P.literal(r["c_name"].encode()), **more}).out

    folder = _library(files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", write), "customers")
    source = lambda name, schema: spark.read.format("pagequarry").option("table", name).option("folders", "true").schema("doc_id string, " + schema).load(folder).where("not endswith(doc_id, '7.pdf')")
    titles = source("nodes", "num bigint, key string, bytes_val binary").where("num = 3 and key = 'Title'")
    streams = source("objects", "kind string").where("kind = 'stream'").withColumn("has", F.lit(True))
    return titles.join(streams, "doc_id", "left").select(_number_of_file(), T.decode_text(F.col("bytes_val")).alias("title"), F.coalesce("has", F.lit(False)).alias("has_stream"))


@query("SELECT p_partkey AS doc_id, p_name AS title FROM part")
def q51_dump_files(spark, sf_dir):
    """Snapshots written as one file per document under its name, and read again."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    dumps = scan(files_of(parts, "p_partkey", lambda r: _info_file(P.literal(r["p_name"].encode()))), "dumps")
    register(spark)
    target = temporary_path(spark, "snapshots")
    _write_spread(dumps.where("error is null").select(F.concat("doc_id", F.lit(".pdf")).alias("doc_id"), "json"), target, ".json")
    found = read_spread(spark, target, FOLDERS, "*.pdf.json").select("path", F.decode("content", "UTF-8").alias("json"))
    return found.select(_number_of_file("path"), F.get_json_object("json", "$.objects['3 0'].dict.Title.text").alias("title"))


# --- trees, merges and values as joins ---


def _graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``trailer_nodes`` of files, made and opened once and stored, so that joins read them and parse nothing."""
    graph = stage_rows(scan(files, "graph"), "graph")
    return graph.where("trailer_ord is null").drop("section_ord", "trailer_ord"), graph.where("trailer_ord is not null").drop("num", "gen")


@query(_LINES + "SELECT l_orderkey AS doc_id, page_index, CAST(l_linenumber AS BIGINT) AS line FROM l")
def q52_page_graph(spark, sf_dir):
    """Pages in order from the object graph: kids in nested nodes and arrays of their own, one kid named twice."""

    def write(r):
        objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 3: b"[]"}
        leaves = {100 + k: b"<</Type /Page /Line %d>>" % x["l_linenumber"] for k, x in enumerate(r["lines"])}
        names = [b"%d 0 R" % k for k in leaves]
        groups = [names[k : k + 2] for k in range(0, len(names), 2)]
        objects |= {10 + k: b"<</Type /Pages /Kids [%s %s]>>" % (b" ".join(own), own[0]) for k, own in enumerate(groups)}
        objects[3] = b"[%s 2 0 R]" % b" ".join(b"%d 0 R" % (10 + k) for k in range(len(groups)))
        return P.Writer().classic({**objects, 2: b"<</Type /Pages /Kids 3 0 R>>", **leaves}).out

    graph = scan(_lines_files(spark, sf_dir, ["l_linenumber"], write), "graph", columns=trees.GRAPH_COLUMNS)
    return trees.page_tree_of(graph, carried=("Line",), together=True).select(_doc(), "page_index", F.col("Line").alias("line"))


@query(
    "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, s_suppkey) - 1 AS INTEGER) AS ord, "
    "s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey"
)
def q53_name_graph(spark, sf_dir):
    """Names in tree order from the object graph: a tree of suppliers by nation."""
    own = F.struct("n_nationkey", "s_suppkey", "s_name")
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(own)).alias("own"))

    def write(r):
        nations = {}
        for x in r["own"]:
            nations.setdefault(x["n_nationkey"], []).append(x["s_name"].encode())
        kids = {10 + k: b"<</Names [%s]>>" % b" ".join(P.literal(n) + b" 5 0 R" for n in names) for k, names in enumerate(nations.values())}
        root = b"<</Kids [%s]>>" % b" ".join(b"%d 0 R %d 0 R" % (k, k) for k in kids)
        return P.Writer().classic({1: b"<</Type /Catalog /Pages 2 0 R /Names <</EmbeddedFiles 3 0 R>>>>", 2: _BASE[2], 3: root, 5: b"<</Type /Filespec>>", **kids}).out

    nodes, trailers = _graph(files_of(rows, "n_regionkey", write))
    return trees.name_tree(nodes, trailers).select(_doc(), "ord", T.decode_text(F.col("name_bytes")).alias("name"))


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), "
    "e AS (SELECT o_custkey AS doc_id, k, 0 AS line, 1 AS depth, 'Order' AS role FROM o "
    "UNION ALL SELECT o_custkey, k, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber), 2, CASE WHEN l_linenumber % 2 = 0 THEN 'Line' ELSE 'Odd' END FROM o JOIN lineitem ON l_orderkey = o_orderkey "
    "UNION ALL SELECT DISTINCT o_custkey, 0, 0, 0, 'StructTreeRoot' FROM o) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, line) - 1 AS INTEGER) AS ord, depth, role, CASE role WHEN 'Order' THEN 'Sect' WHEN 'Line' THEN 'P' END AS mapped_role FROM e"
)
def q54_structure_graph(spark, sf_dir):
    """Structure elements in reading order from the object graph: customers, orders, lines, with a role map."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.coalesce("lines", F.array().cast("array<int>")).alias("lines")))).alias("orders"))

    def write(r):
        objects = {1: b"<</Type /Catalog /Pages 2 0 R /StructTreeRoot 3 0 R>>", 2: _BASE[2], 4: b"<</Order /Sect /Line /P>>"}
        for k, x in enumerate(r["orders"]):
            objects[10 + k] = b"<</S /Order /K [7 %s]>>" % b" ".join(b"<</S /%s /K 3>>" % (b"Odd" if n % 2 else b"Line") for n in x["lines"])
        kids = b" ".join(b"%d 0 R" % n for n in range(10, 10 + len(r["orders"])))
        return P.Writer().classic({**objects, 3: b"<</Type /StructTreeRoot /RoleMap 4 0 R /K 5 0 R>>", 5: b"[%s %s]" % (kids, kids)}).out

    graph = scan(files_of(rows, "o_custkey", write), "graph", columns=trees.GRAPH_COLUMNS)
    return trees.structure_tree_of(graph, together=True).select(_doc(), "ord", "depth", "role", "mapped_role")


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), "
    "r AS (SELECT user_id, k, event_id FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 WHERE r.event_id % 7 <> 0) "
    "SELECT user_id AS doc_id, event_id AS value FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND r.k = e.k)"
)
def q55_unreachable(spark, sf_dir):
    """Objects that the trailer does not lead to: a user's events name the next one up to a break, those behind it also the one before."""

    def write(r):
        events = [int(x) for x in r["ids"]]
        objects = {1: b"<</Type /Catalog /First 10 0 R>>"}
        for k, x in enumerate(events):
            after = b" /Next %d 0 R" % (11 + k) if k + 1 < len(events) and x % 7 else b""
            objects[10 + k] = b"<</Value %d%s%s>>" % (x, after, b" /Last %d 0 R" % (9 + k) if k else b"")
        return P.Writer().classic(objects).out

    nodes, trailers = _graph(files_of(_events_by_user(spark, sf_dir), "user_id", write))
    values = nodes.where("key = 'Value'").select("doc_id", "num", "gen", F.col("int_val").alias("value"))
    return trees.unreachable(nodes, trailers).join(values, ["doc_id", "num", "gen"]).select(_doc(), "value")


@query(
    "WITH e AS (SELECT user_id, event_id, 'K' || (event_id % 5) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS section FROM events) "
    "SELECT user_id AS doc_id, key, max(event_id) AS value, CAST(arg_max(section, event_id) AS INTEGER) AS section_ord FROM e GROUP BY user_id, key"
)
def q56_merged_trailers(spark, sf_dir):
    """Trailers merged as tables: of each key the newest section's entry, and which section that is."""

    def write(r):
        w = P.Writer()
        for k, x in enumerate(r["ids"]):
            w.classic(_BASE if k == 0 else {}, b"/Root 1 0 R /K%d %d" % (x % 5, x), size=3)
        return w.out

    merged = trees.merged_trailer(scan(files_of(_events_by_user(spark, sf_dir), "user_id", write), "trailer_nodes"))
    return merged.where("key rlike '^K[0-9]'").select(_doc(), "key", F.col("int_val").alias("value"), "section_ord")


@query("SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'classical' ELSE 'stream' END AS xref_format FROM part")
def q57_formats_from_trailers(spark, sf_dir):
    """The form of a file's index from the keys of its merged trailers."""

    def write(r):
        if r["p_size"] % 3 == 1:
            return P.Writer().packed(_BASE, {}).out
        w = P.Writer()
        if r["p_size"] % 3 == 0:
            return w.classic(_BASE).out
        w.packed(_BASE, {7: b"(packed)"})
        at, w.last = w.last, None
        return w.classic({5: b"null", **_BASE}, b"/Root 1 0 R /XRefStm %d" % at).out

    files = files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", write)
    return trees.xref_format(scan(files, "trailer_nodes")).select(_doc(), "xref_format")


@query(
    "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(9 + row_number() OVER w AS BIGINT) AS num, CAST(row_number() OVER w - 1 AS BIGINT) AS stm_idx, c_name AS title, c_acctbal AS amount "
    "FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)"
)
def q58_packed_objects(spark, sf_dir):
    """Objects of object streams by a join of index entries with cut-up containers: a nation's customers in one stream."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("own"))

    def write(r):
        inside = {10 + k: b"<</Title %s /Amount %s>>" % (P.literal(x["c_name"].encode()), repr(x["c_acctbal"]).encode()) for k, x in enumerate(r["own"])}
        return P.Writer("1.5").packed(_BASE, inside).out

    files = stage_rows(files_of(rows, "c_nationkey", write), "files")
    plain = stage_rows(scan(files, "nodes", ScanOptions(packed=False)), "nodes")
    found = stage_rows(packed.packed_objects(scan(files, "xref_entries"), plain, scan(files, "streams", ScanOptions(packed=False))), "packed")
    values = packed.parse_bodies(found.withColumn("gen", F.lit(0))).where("depth = 1")
    pick = lambda key, column: F.max(F.when(F.col("key") == key, column))
    number = F.coalesce(F.col("real_val"), F.col("int_val").cast("double"))
    shown = values.groupBy("doc_id", "num").agg(pick("Title", T.decode_text(F.col("bytes_val"))).alias("title"), pick("Amount", number).alias("amount"))
    return found.where("error is null").join(shown, ["doc_id", "num"]).select(_doc(), "num", "stm_idx", "title", "amount")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AHx' WHEN 1 THEN 'RL' WHEN 2 THEN 'AHx,RL' ELSE 'AHx,Fl' END AS chain, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha FROM documents")
def q59_native_codecs(spark, sf_dir):
    """Document texts through chains of expressions; only where a chain holds Flate it goes on in a worker."""

    def body(r):
        text, kind = r["text"].encode(), r["doc_id"] % 4
        coded = [lambda: text.hex().encode() + b">", lambda: P.run_length(text), lambda: P.run_length(text).hex().encode() + b">", lambda: zlib.compress(text).hex().encode() + b">"][kind]()
        return P.one_stream(P.stream(coded, b"/Filter [%s]" % [b"/AHx", b"/RL", b"/AHx /RL", b"/AHx /Fl"][kind]))

    files = files_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", body)
    streams = stage_rows(scan(files, "streams", columns=["num", "raw", "filters", "params"]).where("num = 3"), "streams")
    done = codecs.decode_streams(streams)
    return done.select(_doc(), F.array_join("filters", ",").alias("chain"), F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("sha"))


@query("SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'aes128' WHEN 1 THEN 'aes256' ELSE 'rc4' END AS cipher, octet_length(encode(p_name)) AS n_bytes, sha256(p_name) AS sha FROM part")
def q60_decryption(spark, sf_dir):
    """Streams decrypted by expressions from raw bytes and file keys, RC4 alone in workers."""
    write = lambda records: P.encrypted_files([(r["p_name"].encode(), ["AESV2", "AESV3", "V2"][r["p_size"] % 3], b"%d" % r["p_partkey"]) for r in records])
    files = stage_rows(files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey", write_all=write), "files")
    keys = stage_rows(scan(files, "security"), "keys")
    plain = codecs.decrypt_streams(scan(files, "streams", columns=["num", "gen", "raw"]).where("num = 3"), keys)
    return plain.join(keys.select("doc_id", "cipher"), "doc_id").select(_doc(), "cipher", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"))


@query("SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'Tc' ELSE 'Tw' END AS operator, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def q61_lateral_operations(spark, sf_dir):
    """Content operations of bytes that SQL makes, by a table function in SQL."""
    tables.register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("pagequarry_lines")
    return spark.sql("""
        WITH c AS (SELECT l_orderkey, encode(concat_ws(' ', collect_list(concat(cast(l_quantity AS string), if(l_linenumber % 2 = 0, ' Tc', ' Tw')))), 'UTF-8') AS content FROM pagequarry_lines GROUP BY l_orderkey)
        SELECT l_orderkey AS doc_id, o.operator, count(*) AS n, max(o.operands[0].number) AS most FROM c, LATERAL content_operations(c.content) o GROUP BY l_orderkey, o.operator
    """)


@query(
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS nation, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'int expected, found text' END AS nation_error, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS label, "
    "CASE WHEN c_custkey % 2 = 1 THEN 'no such entry' END AS label_error, CAST(c_nationkey + 1 AS BIGINT) AS inner_value FROM customer"
)
def q62_strict_values(spark, sf_dir):
    """Values as VARIANT: strict readings with what is wrong, lenient ones that miss, through references."""

    def write(r):
        nation = P.literal(b"none") if r["c_custkey"] % 3 == 0 else b"%d" % r["c_nationkey"]
        label = b" /Label 7 0 R" if r["c_custkey"] % 2 == 0 else b""
        more = {6: nation, 7: P.literal(r["c_name"].encode()), 8: P.stream(b"x", b"/Inner %d" % (r["c_nationkey"] + 1))}
        return P.Writer().classic({**_BASE, 5: b"<</Nation 6 0 R /Deep 8 0 R%s>>" % label, **more}).out

    files = files_of(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_custkey", write)
    held = stage_rows(values.as_variant(scan(files, "objects", columns=["num", "gen", "tagged_json", "error"])), "variants")
    strict = lambda key, kind: values.resolved(held, key).where("num = 5").select("doc_id", values.strict(F.col("found"), kind).alias(key))
    inner = values.resolved(held, "Deep").where("num = 5").select("doc_id", F.try_variant_get(values.lenient(F.col("found"), "dict"), "$.Inner.int", "bigint").alias("inner_value"))
    rows = strict("Nation", "int").join(strict("Label", "text"), "doc_id").join(inner, "doc_id")
    return rows.select(_doc(), F.col("Nation.value").cast("double").alias("nation"), F.col("Nation.error").alias("nation_error"), F.col("Label.value").alias("label"), F.col("Label.error").alias("label_error"), "inner_value")


@query("SELECT p_partkey AS doc_id, CAST(CASE WHEN p_size % 5 = 0 THEN 5 ELSE 0 END AS BIGINT) AS changed, (SELECT count(*) FROM part q WHERE q.p_name = part.p_name) AS same_titles FROM part")
def q63_content_digests(spark, sf_dir):
    """Versions that differ in object numbers alone are equal; a changed leaf changes what leads to it; equal subtrees are found across files."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")

    def version(r, shift, name):
        at = lambda k: b"%d 0 R" % (k + shift)
        bodies = {1: b"<</Type /Catalog /Pages %s /Info %s /Own %d>>" % (at(2), at(3), r["p_partkey"]), 2: b"<</Kids [%s] /Up %s>>" % (at(3), at(1)), 3: b"<</Title %s /Back %s>>" % (at(4), at(5)), 4: P.literal(name), 5: b"[%s]" % at(4)}
        return P.Writer().classic({k + shift: v for k, v in bodies.items()}, b"/Root " + at(1)).out

    old = stage_rows(scan(files_of(parts, "p_partkey", lambda r: version(r, 0, r["p_name"].encode())), "nodes"), "old")
    new = stage_rows(scan(files_of(parts, "p_partkey", lambda r: version(r, 7 + r["p_partkey"] % 3, r["p_name"].encode() + b"!" * (r["p_size"] % 5 == 0))), "nodes"), "new")
    versions = values.settled_versions(old, new)
    before = versions.where("side = '<'").select("doc_id", "num", "gen", "digest")
    changed = values.diff_of(versions).where("change = 'added'").groupBy("doc_id").agg(F.count("*").alias("changed"))
    classes = values.copies(before)
    titles = before.where("num = 3").join(classes.select("digest", "n"), "digest", "left").select("doc_id", F.coalesce("n", F.lit(1)).alias("same_titles"))
    return titles.join(changed, "doc_id", "left").select(_doc(), F.coalesce("changed", F.lit(0)).cast("long").alias("changed"), "same_titles")
