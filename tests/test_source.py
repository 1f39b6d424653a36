"""Data source, sink, command line, expression codecs, packed objects, values and digests."""

import io
import json
import os
import random
import zlib
from contextlib import redirect_stderr, redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequarry import dump
from pagequarry.functions import codecs, tables
from pagequarry.operators import packed, values, views
from pagequarry.sources import codecs as kernel
from pagequarry.sources import datasource, scan
from pagequarry.sources.document import Document
from pagequarry.sources.scan import Only, ScanOptions, rows_of
from pagequarry.sources.syntax import PdfError
from pagequarry.streaming.ingest import ingest, stream_files
from pagequarry.testing import pdfwriter as P
from pagequarry.workspace import stage

BASE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 4 0 R] /Count 2>>"}
PAGES = {3: b"<</Type /Page /Contents 5 0 R>>", 4: b"<</Type /Page /Contents [6 0 R]>>", 5: P.stream(zlib.compress(b"q Q"), b"/Filter /Fl"), 6: P.stream(zlib.compress(b"BT ET"), b"/Filter /Fl")}
WHOLE = bytes(P.Writer().classic({**BASE, **PAGES, 7: b"<</Title (seven)>>"}, b"/Root 1 0 R /Info 7 0 R").out)


@pytest.fixture
def decoded(monkeypatch):
    """Counts decoded streams."""
    done = []
    whole = Document._decode
    monkeypatch.setattr(Document, "_decode", lambda self, stream, encrypted: done.append(stream.num) or whole(self, stream, encrypted))
    return done


@pytest.mark.parametrize(
    ("table", "columns", "only", "expected"),
    [
        ("documents", ("page_count",), (), []), ("documents", ("xref_format",), (), []), ("documents", ("n_objects", "header_version"), (), []), ("documents", ("trailer_json",), (), []),
        ("streams", ("num", "raw"), (), []), ("streams", ("num", "filters"), (), []), ("streams", ("decoded",), (Only("num", "=", 6),), [6]), ("streams", None, (), [5, 6]),
        ("objects", ("kind",), (), []), ("objects", None, (Only("kind", "=", "dict"),), []), ("objects", None, (Only("num", "in", (5, 7)),), [5]),
        ("page_spine", ("page_index", "attributes"), (), []), ("page_spine", None, (Only("page_index", "=", 1),), [6]), ("content_ops", None, (Only("page_index", "<", 1),), [5]),
        ("nodes", None, (), []), ("trailer_nodes", None, (), []),
    ],
)
def test_only_what_is_wanted_is_decoded(decoded, table, columns, only, expected):
    rows = list(rows_of(table, WHOLE, ScanOptions(columns=columns, only=only)))
    assert rows and all(r[-1] is None for r in rows)
    assert sorted(set(decoded)) == expected


def test_unwanted_objects_are_not_parsed(monkeypatch):
    seen = []
    whole = Document._object_at
    monkeypatch.setattr(Document, "_object_at", lambda self, at, ref: seen.append(ref.num) or whole(self, at, ref))
    assert [r[0] for r in rows_of("objects", WHOLE, ScanOptions(only=(Only("num", "=", 7),)))] == [7] and seen == [7]


@pytest.fixture
def library(tmp_path):
    for k in range(9):
        (tmp_path / f"doc{k}.pdf").write_bytes(bytes(P.Writer().classic({**BASE, **PAGES, 7: b"<</Title (t%d)>>" % k}, b"/Root 1 0 R /Info 7 0 R").out))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "broken.pdf").write_bytes(b"%PDF-1.7 nothing")
    (tmp_path / "note.txt").write_text("no")
    return tmp_path


def test_source_reads_tables_by_column_and_condition(spark, library):
    datasource.register(spark)
    source = lambda: spark.read.format("pagequarry")
    docs = source().load(str(library)).collect()
    assert len(docs) == 10 and [os.path.basename(r["doc_id"]) for r in docs if r["error"]] == ["broken.pdf"]
    assert {r["doc_id"] for r in docs} == {r["doc_id"] for r in scan.read_files(spark, str(library)).select("doc_id").collect()}
    narrow = source().schema("page_count int, doc_id string").load(str(library)).where("doc_id like '%3.pdf'")
    assert [(r["page_count"], os.path.basename(r["doc_id"])) for r in narrow.collect()] == [(2, "doc3.pdf")]
    nodes = source().option("table", "nodes").load(str(library)).where("num = 7 and key = 'Title'")
    assert sorted(bytes(r["bytes_val"]) for r in nodes.select("bytes_val").collect()) == [b"t%d" % k for k in range(9)]
    streams = source().option("table", "streams").option("maxStreamSize", 4).load(str(library)).where("num in (5, 6)")
    assert {(r["num"], r["error"] is None) for r in streams.select("num", "error").collect()} == {(5, True), (6, False)}
    one = spark.read.format("pagequarry").load(str(library / "doc1.pdf")).collect()
    assert len(one) == 1 and one[0]["page_count"] == 2


def reader(options, filters=(), schema=None):
    own = datasource.PdfReader(options, schema or scan.schema_of(options.get("table", "documents")))
    return own, list(own.pushFilters(list(filters)))


def test_conditions_drop_files_and_objects_before_they_are_read(spark, library):
    from pyspark.sql import datasource as D

    own, rest = reader({"path": str(library), "table": "objects"}, [D.EqualTo(("num",), 7), D.In(("kind",), ("dict",)), D.EqualTo(("error",), "x"), D.StringEndsWith(("doc_id",), "4.pdf")])
    assert [f.attribute for f in rest] == [("error",)]
    (part,) = own.partitions()
    assert [os.path.basename(path) for _, path in part.names] == ["doc4.pdf"]
    rows = [r for batch in own.read(part) for r in batch.to_pylist()]
    assert [(r["num"], r["kind"]) for r in rows] == [(7, "dict")]


def test_partitions_are_planned_by_bytes(spark, library):
    own, _ = reader({"path": str(library), "partitionBytes": str(3 * datasource.OPEN_BYTES + 3 * len(WHOLE) + 99)})
    assert [len(p.names) for p in own.partitions()] == [3, 3, 3, 1]
    assert [len(p.names) for p in reader({"path": str(library), "glob": "nothing"})[0].partitions()] == [0]


def test_a_limit_ends_early(spark, library, monkeypatch):
    """Within a partition files are opened as rows are asked for; partitions behind the first are not started."""
    opened = []
    real = datasource.file_system

    def watched(path):
        system, root, before = real(path)

        class Watched:
            def __getattr__(self, name):
                return getattr(system, name)

            def open_input_stream(self, path):
                opened.append(path)
                return system.open_input_stream(path)

        return Watched(), root, before

    own, _ = reader({"path": str(library), "table": "objects"})
    (part,) = own.partitions()
    monkeypatch.setattr(datasource, "file_system", watched)
    monkeypatch.setattr(scan, "FIRST_ROWS", 1)
    next(iter(own.read(part)))
    assert len(opened) == 1
    monkeypatch.undo()
    datasource.register(spark)
    for k in range(1, 9):
        (library / f"doc{k}.pdf").unlink()
        (library / f"doc{k}.pdf").mkdir()  # what is listed no more, and cannot be opened
    first = spark.read.format("pagequarry").option("partitionBytes", 1).load(str(library)).limit(1).collect()
    assert len(first) == 1 and first[0]["page_count"] == 2


# --- sink and command line ---


def write(rows, path, mode="append", suffix=""):
    datasource.register(rows.sparkSession)
    rows.write.format("pagequarry").option("suffix", suffix).mode(mode).save(str(path))


def test_sink_writes_a_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"s3://x/y/f{k}.pdf", f"text é {k}") for k in range(20)], "doc_id string, json string").repartition(4)
    write(rows, tmp_path / "out", suffix=".json")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"f{k}.pdf.json": f"text é {k}" for k in range(20)}
    with pytest.raises(Exception, match="two documents"):
        write(rows.limit(1), tmp_path / "out", suffix=".json")
    assert len(list((tmp_path / "out").iterdir())) == 20
    write(rows.limit(2), tmp_path / "out", mode="overwrite")
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("json"))
    with pytest.raises(Exception, match="lost"):
        write(rows, tmp_path / "out")
    assert list((tmp_path / "out").iterdir()) == []


def test_a_repeated_task_leaves_no_double(tmp_path):
    schema = StructType.fromJson(json.loads('{"type":"struct","fields":[{"name":"doc_id","type":"string","nullable":true,"metadata":{}},{"name":"json","type":"string","nullable":true,"metadata":{}}]}'))
    own = datasource.FileWriter({"path": str(tmp_path)}, schema, False)
    lost = own.write(iter([("a", "half")]))  # an attempt whose message never arrives
    own.commit([own.write(iter([("a", "1"), ("b", "2")])), None])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "1", "b": "2"} and not os.path.exists(lost.folder)
    with pytest.raises(ValueError, match="name of its own"):
        datasource.FileWriter({"path": str(tmp_path)}, schema, False).write(iter([("..", "x")]))


def run(*argv):
    out, err = io.StringIO(), io.StringIO()
    with redirect_stdout(out), redirect_stderr(err):
        code = dump.main(list(argv))
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, library, tmp_path):
    code, out, err = run(str(library / "doc1.pdf"))
    shown = json.loads(out)
    assert code == 0 and shown["objects"]["7 0"]["dict"]["Title"]["text"] == "t1" and shown["objects"]["5 0"]["stream"]["decoded"]["preview_utf8"] == "q Q"
    code, out, _ = run("--no-preview", "--stream-content", str(library / "doc1.pdf"))
    body = json.loads(out)["objects"]["5 0"]["stream"]["decoded"]
    assert code == 0 and body["hex"] == b"q Q".hex() and "preview_utf8" not in body
    code, out, err = run("--out", str(tmp_path / "dumps"), str(library))
    assert code == 1 and "broken.pdf" in err and out == ""
    assert sorted(p.name for p in (tmp_path / "dumps").iterdir()) == [f"doc{k}.pdf.json" for k in range(9)]
    with pytest.raises(SystemExit):
        run()
    code, out, err = run(str(library / "sub" / "broken.pdf"))
    assert code == 1 and out == "" and "broken.pdf" in err


def test_files_that_arrive(spark, library, tmp_path):
    for _ in range(2):
        ingest(stream_files(spark, str(library)), "documents", str(tmp_path / "table"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10
    (library / "late.pdf").write_bytes(WHOLE)
    ingest(stream_files(spark, str(library)), "documents", str(tmp_path / "table"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "table")).where("page_count = 2").count() == 10


# --- expressions ---


def kernel_result(name, data, most=1 << 24):
    try:
        return kernel.decode(name, data, kernel.Params(), most)
    except PdfError:
        return None


def test_expression_codecs_equal_the_scan(spark):
    draw = random.Random(4)
    cases = [b"", b">", b"4>", b"41 4 2\n\r\t\x0c>junk", b"4G>", b"41\x0042", b"\x80", b"\x80junk", b"\x00A\x80", b"\x02ABC\xff\x0a\x80", b"\x05AB", b"\xfe", b"\x81\n\x80", b"\x03\x80\xff\x00\x41"]
    cases += [P.run_length(bytes(draw.choices(range(4), k=draw.randint(0, 600)))) for _ in range(30)] + [bytes(draw.choices(range(256), k=draw.randint(0, 40))) for _ in range(120)]
    cases += [P.run_length(bytes(draw.choices(range(256), k=draw.randint(0, 600)))) for _ in range(10)] + [b"\x7f" + bytes(range(128)) + b"\x81z\x80"]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, raw binary")
    for name, expression in (("ASCIIHexDecode", codecs.ascii_hex), ("RunLengthDecode", codecs.run_length)):
        got = {r["k"]: None if r["d"] is None else bytes(r["d"]) for r in rows.select("k", expression(F.col("raw")).alias("d")).collect()}
        assert got == {k: kernel_result(name, c) for k, c in enumerate(cases)}


def test_chains_mix_expressions_and_codecs(spark):
    text = b"some text " * 50
    chains = [([], text), (["AHx"], text.hex().encode()), (["AHx", "RL"], P.run_length(text).hex().encode()), (["AHx", "Fl", "RL"], zlib.compress(P.run_length(text)).hex().encode()), (["Fl", "AHx"], zlib.compress(text.hex().encode())), (["AHx"], b"xyz"), (["RL", "Fl"], b"\x05a"), (["AHx", "Fl"], b"00"), (["DCT"], b"x"), (["AHx", "DCT"], b"41"), (["RL"], P.run_length(text * 30))]
    files = spark.createDataFrame([(str(k), P.one_stream(P.stream(data, b"/Filter [%s]" % b" ".join(b"/" + f.encode() for f in chain)))) for k, (chain, data) in enumerate(chains)], "doc_id string, content binary")
    options = ScanOptions(max_stream=9_000)
    want = {r["doc_id"]: r["decoded"] for r in scan.scan(files, "streams", options).where("num = 3").collect()}
    raw = scan.scan(files, "streams", options, columns=["num", "raw", "filters", "params"]).where("num = 3")
    got = {r["doc_id"]: (r["decoded"], r["error"]) for r in codecs.decode_streams(raw, 9_000).collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert all((v is None) == (e is not None) for v, e in got.values())


def test_native_chains_need_no_worker(spark):
    rows = spark.createDataFrame([(1, bytearray(b"41>"), ["AHx"])], "num int, raw binary, filters array<string>")
    plan = rows.select(codecs.native_chain(F.col("raw"), F.col("filters")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_decryption_equals_the_scan(spark):
    from pagequarry.sources import security

    draw = random.Random(2)
    rows, want = [], {}
    keys = [("a", "aes128", bytes(range(16))), ("b", "aes256", bytes(range(32))), ("c", "rc4", bytes(range(5))), ("d", "identity", b"")]
    for doc, cipher, key in keys:
        for num in range(12):
            body = bytes(draw.choices(range(256), k=[0, 5, 15, 16, 32, 48, 33][num % 7]))
            if cipher.startswith("aes") and num % 2:
                own = key if cipher == "aes256" else security.object_key(key, num + 70_000, 3, True)
                pad = 16 - len(body) % 16
                body = bytes(16) + security.cbc_encrypt(own, bytes(16), body + bytes([pad]) * pad)
            rows.append((doc, num + 70_000, 3, bytearray(body)))
            handler = security.Handler.__new__(security.Handler)
            handler.cipher, handler.key = cipher, key
            try:
                want[doc, num + 70_000] = handler.decrypt(body, num + 70_000, 3)
            except PdfError:
                want[doc, num + 70_000] = None
    streams = spark.createDataFrame([*rows, ("plain", 1, 0, bytearray(b"open"))], "doc_id string, num long, gen long, raw binary")
    table = spark.createDataFrame([(d, c, bytearray(k)) for d, c, k in keys], "doc_id string, cipher string, file_key binary")
    got = {(r["doc_id"], r["num"]): None if r["raw"] is None else bytes(r["raw"]) for r in codecs.decrypt_streams(streams, table).collect()}
    assert got == {**want, ("plain", 1): b"open"}


# --- packed objects, values, digests, table function ---


def test_packed_objects_equal_the_scan(spark):
    good = P.Writer("1.5").packed({1: b"<</Type /Catalog>>"}, {10: b"<</A [1 2 (x)]>>", 11: b"(text)", 12: b"[1 0 R]"}).out
    bad = []
    for head, extra, n in ((b"10 0 11 500 ", b"", 2), (b"99 0 11 3 ", b"", 2), (b"10 x ", b"", 2), (b"10 0 11 3 ", b"/First 9999", 2), (b"10 0 ", b"", 2)):
        body = P.stream(head + b"1 (b)", b"/Type /ObjStm /N %d %s" % (n, extra or b"/First %d" % len(head)))
        start = b"%PDF-1.7\n1 0 obj <</Type /Catalog>> endobj\n"
        at = len(start)
        start += b"5 0 obj " + body + b" endobj\n"
        index = P.stream(b"".join(bytes([2, 5, k]) for k in (0, 1)) + bytes([1, at, 0]) + bytes([1, 9, 0]), b"/Type /XRef /W [1 1 1] /Size 20 /Root 1 0 R /Index [10 2 5 1 1 1]")
        bad.append(start + b"7 0 obj " + index + b" endobj\nstartxref\n%d\n%%%%EOF" % len(start))
    files = stage(spark.createDataFrame([(str(k), bytearray(f)) for k, f in enumerate([good, *bad])], "doc_id string, content binary"), "f")
    plain = ScanOptions(packed=False)
    found = stage(packed.packed_objects(scan.scan(files, "xref_entries"), scan.scan(files, "nodes", plain), scan.scan(files, "streams", plain)), "p")
    got = packed.parse_bodies(found.withColumn("gen", F.lit(0)))
    columns = ["doc_id", "num", "node_id", "parent_id", "pos", "key", "kind", "int_val", "bytes_val", "ref_num"]
    kept = lambda rows: sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.where("num in (10, 11, 12) and error is null").select(*columns).collect()), key=str)
    assert kept(got) == kept(scan.scan(files, "nodes"))
    # what cannot be found and what cannot be parsed
    failed = {(r["doc_id"], r["num"]) for rows in (found, got) for r in rows.where("error is not null").collect()}
    assert failed == {(r["doc_id"], r["num"]) for r in scan.scan(files, "objects").where("num in (10, 11) and error is not null").collect()}
    assert failed and found.where("doc_id = '0' and error is not null").isEmpty()


def test_strict_and_lenient_values(spark):
    body = {**BASE, **PAGES, 8: b"<</I 5 /R 1.5 /T (x) /N /Name /B true /Z null /D <</K 1>> /A [1] /Far 9 0 R /Gone 99 0 R /S 5 0 R>>", 9: b"7"}
    files = spark.createDataFrame([("d", bytearray(P.Writer().classic(body).out))], "doc_id string, content binary")
    held = stage(values.as_variant(scan.scan(files, "objects")), "v")

    def read(key, kind):
        (row,) = values.resolved(held, key).where("num = 8").select(values.strict(F.col("found"), kind).alias("s"), values.lenient(F.col("found"), kind).alias("l")).select("s.error", F.to_json(F.struct("l")).alias("l")).collect()
        return row["error"], json.loads(row["l"]).get("l")

    assert read("I", "int") == (None, 5) and read("R", "real") == (None, 1.5) and read("T", "text") == (None, "x") and read("N", "name") == (None, "Name") and read("B", "bool") == (None, True)
    assert read("Far", "int") == (None, 7) and read("A", "array") == (None, [{"int": 1}]) and read("D", "dict") == (None, {"K": {"int": 1}})
    assert read("S", "dict")[0] is None and "Length" in read("S", "dict")[1]
    assert read("I", "bool") == ("bool expected, found int", None) and read("Gone", "int") == ("int expected, found null", None) and read("None", "int") == ("no such entry", None)


def test_renumbered_copies_have_no_difference(spark):
    def file(shift, title=b"(t)"):
        at = lambda k: b"%d 0 R" % (k + shift)
        bodies = {1: b"<</Type /Catalog /Pages %s>>" % at(2), 2: b"<</Kids [%s %s]>>" % (at(3), at(4)), 3: b"<</Parent %s /Font %s>>" % (at(2), at(5)), 4: b"<</Parent %s /Font %s /T %s>>" % (at(2), at(5), title), 5: P.stream(b"font"), 6: b"<</Free 99 0 R>>"}
        return bytearray(P.Writer().classic({k + shift: v for k, v in bodies.items()}, b"/Root " + at(1)).out)

    def tables_of(content):
        files = spark.createDataFrame([("d", content), ("e", content)], "doc_id string, content binary")
        return stage(scan.scan(files, "nodes"), "n"), scan.scan(files, "streams", columns=["num", "gen", "raw"])

    (nodes, streams), (moved, moved_streams), (changed, changed_streams) = tables_of(file(0)), tables_of(file(20)), tables_of(file(20, b"(u)"))
    assert values.diff_by_content(nodes, moved, streams, moved_streams).count() == 0
    found = values.diff_by_content(nodes, changed, streams, changed_streams).where("doc_id = 'd'").collect()
    assert {(r["change"], r["num"]) for r in found} == {(c, k + s) for c, s in (("removed", 0), ("added", 20)) for k in (1, 2, 3, 4)}
    assert {r["n"] for r in values.copies(values.settled_digests(nodes, streams)).collect()} == {2}


def test_boxes_as_one_value(spark):
    file = P.page_file([(b"/BleedBox [9 8 1 2] /TrimBox 5", []), (b"", [])], b"/MediaBox [0 0 10 20]")
    rows = views.pages(spark.createDataFrame([("d", bytearray(file))], "doc_id string, content binary"), contents=False).orderBy("page_index").select("boxes").collect()
    assert [{k: tuple(v) for k, v in r["boxes"].items()} for r in rows] == [{"MediaBox": (0, 0, 10, 20), "BleedBox": (1, 2, 9, 8)}, {"MediaBox": (0, 0, 10, 20)}]


def test_operations_in_sql(spark):
    tables.register(spark)
    spark.createDataFrame([(1, bytearray(b"1 2 m (a) Tj")), (2, None), (3, bytearray(b"1 l ]"))], "id int, content binary").createOrReplaceTempView("t_bytes")
    rows = spark.sql("SELECT id, o.op_index, o.operator, size(o.operands) AS n, o.error IS NOT NULL AS bad FROM t_bytes, LATERAL content_operations(content) o ORDER BY id, op_index").collect()
    assert [tuple(r)[:3] + (r["bad"],) for r in rows] == [(1, 0, "m", False), (1, 1, "Tj", False), (3, 0, "l", False), (3, 1, None, True)]
    assert [r["n"] for r in rows if not r["bad"]] == [2, 1, 1]
