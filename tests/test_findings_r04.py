"""Findings of round 4: each test fails on the code before its change."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import decontaminate as D
from pagequarry.operators import trees, views
from pagequarry.plans import queries
from pagequarry.sources import content, syntax
from pagequarry.sources.document import Document
from pagequarry.sources.scan import ScanOptions, operation_rows, rows_of, scan
from pagequarry.testing import pdfwriter as P
from pagequarry.workspace import stage
from tests.test_trees import chain, random_file


def _shingles(words):
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def _similarity(a, b):
    shared = sum(min(a.count(s), b.count(s)) for s in set(a) & set(b))
    return shared / (len(a) + len(b) - shared)


def _items(spark, texts):
    """Items as ``contaminated`` hashes them."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item long, own string")
    hashed = rows.withColumn("word_hashes", F.transform(F.split("own", " "), lambda w: F.xxhash64(w))).withColumn("length", F.size("word_hashes"))
    return hashed.withColumn("item_hashes", D.shingle_hashes(F.col("word_hashes"), F.col("length"), [1, 2, 3, 4]))


def test_f1_a_phrase_of_many_items_is_no_anchor(spark):
    phrase = "all of these rights are reserved here"
    own = [f"{phrase} " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(50)]
    keys = D.anchor_keys(_items(spark, own)).collect()
    common = {r["h"] for r in _items(spark, [phrase]).select(F.explode("item_hashes").alias("h")).collect()}
    assert not common & {r["h"] for r in keys}
    # 33 shingles, of which a window at the threshold holds 27
    assert len(keys) == 50 * 7


def test_f1_every_window_at_the_threshold_holds_an_anchor(spark):
    rng = random.Random(4)
    own = []
    for _ in range(40):
        # few different words, so shingles repeat within an item and among items
        own.append([rng.choice("abc") for _ in range(rng.randint(1, 14))] if rng.random() < 0.5 else [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(5, 40))])
    items = _items(spark, [" ".join(w) for w in own])
    anchors = {}
    for r in D.anchor_keys(items).collect():
        anchors.setdefault(r["item"], set()).add(r["h"])
    windows = []
    for item, words in enumerate(own):
        for _ in range(30):
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = rng.choice("abcd")
            windows.append((item, changed[: max(1, len(changed) - rng.choice([0, 0, 1]))]))
    found = _items(spark, [" ".join(w) for _, w in windows]).select("item", "item_hashes").collect()
    hashes = {r["item"]: r["item_hashes"] for r in found}
    listed = lambda w: _shingles(w) or [" ".join(w)]
    near = [k for k, (item, w) in enumerate(windows) if _similarity(listed(w), listed(own[item])) >= D.THRESHOLD]
    assert len(near) > 300
    assert all(anchors[windows[k][0]] & set(hashes[k]) for k in near)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_f1_both_ways_of_anchors_agree_where_items_share_a_phrase(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    phrase = "all of these rights are reserved here"
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    items = spark.createDataFrame([(k, f"{phrase} {body(k)}") for k in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so {phrase} {body(k)} end" if k < 3 else f"so {phrase} and {k}") for k in range(9)], "doc_id long, text string")
    found = D.contaminated(docs, items).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["similarity"]) for r in found] == [(k, k, 1, 1.0) for k in range(3)]


# --- PDF queries -------------------------------------------------------------


def _random_dictionary(rng):
    """Bytes of a dictionary, plain ones and ones that the general way alone may read."""
    gap = lambda: rng.choice([b" ", b"\n", b"\r\n", b"  ", b""])
    plain = [b"5 0 R", b"-7", b"007", b"1.50", b"-0.5", b"/Name.x-1", b"[]", b"[ 1 -2.5 3 ]", b"[4 0 R\n5 1 R ]", b"[1]", b"0"]
    other = [b"true", b"null", b"(text)", b"<4142>", b"[/A 1]", b"[1 0 R 5]", b"<</In 1>>", b"+5", b"5.", b".5", b"/A#42", b"5 0", b"5 0 Rx", b"1 2 R", b"[1.5.2]", b"%c\n5", b"", b"x", b"1234567890123456789", b"[5 0R]", b"/A!b"]
    pairs = [b"/" + rng.choice([b"A", b"B", b"Kids", b"A.b", b"C+1"]) + gap() + rng.choice(plain if rng.random() < 0.93 else other) for _ in range(rng.randint(0, 5))]
    return b"<<" + gap() + gap().join(pairs) + rng.choice([b"", b" "]) + b">>"


def test_f4_flat_dictionaries_are_read_as_the_general_way_reads_them(monkeypatch):
    rng = random.Random(5)
    flat = re.compile(syntax.FLAT)
    general = re.compile(rb"(?!)")
    seen = 0
    for _ in range(4_000):
        body = _random_dictionary(rng)
        with monkeypatch.context() as m:
            m.setattr(syntax, "_FLAT", general)
            try:
                tokens = syntax.Tokens(body)
                want = (repr(syntax.parse_value(tokens)), tokens.pos)
            except syntax.PdfError:
                want = None
        found = flat.match(body)
        if found:
            seen += 1
            assert want == (repr(dict(syntax.flat_value(found[0]))), found.end()), body
    assert seen > 1_500


def test_f4_boxes_are_made_of_the_columns_asked_for(spark):
    files = spark.createDataFrame([("a", bytearray(P.page_file([(b"/MediaBox [9 8 1 2]", [b"q"]), (b"/Rotate 90", [])], b"/MediaBox [0 0 5 5]")))], "doc_id string, content binary")
    found = views.pages(files, contents=False, columns=("page_index", "media_box", "rotation"))
    assert found.columns == ["doc_id", "page_index", "media_box", "rotation"]
    assert "parents" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["page_index"], tuple(r["media_box"]), r["rotation"]) for r in found.collect()] == [(0, (1.0, 2.0, 9.0, 8.0), 0), (1, (0.0, 0.0, 5.0, 5.0), 90)]
    whole = views.pages(files, contents=False).select("page_index", "media_box", "rotation")
    assert whole.collect() == found.drop("doc_id").collect()


def test_f4_equal_dictionaries_of_a_chain_are_told_apart_and_cycles_end():
    loop = P.Writer().classic({1: b"<</Pages 2 0 R>>", 2: b"<</Kids [5 0 R 6 0 R]>>", 5: b"<</Parent 7 0 R>>", 7: b"<</Parent 7 0 R>>", 6: b"<</Parent 6 0 R>>"}).out
    rows = list(rows_of("page_spine", bytes(loop), ScanOptions()))
    assert [[tuple(p) for p in r[3]] for r in rows] == [[(7, 0), (7, 0)], [(6, 0)]]


def test_f4_shared_dictionaries_stay_as_they_are():
    trailer = P.Writer().classic({1: b"<</Pages 2 0 R>>", 2: b"<</Kids []>>"}).classic({4: b"null"}, b"/More 1", size=5).out
    before = [(s, dict(t)) for s, t in Document(bytes(trailer)).trailers]
    for _ in range(2):
        again = Document(bytes(trailer))
        assert [(s, dict(t)) for s, t in again.trailers] == before
        assert again.trailer == {**before[1][1], **before[0][1]}


def test_f4_what_a_parser_returns_is_its_callers_own():
    body = b"<</Root 1 0 R /In <</A 1>>>>"
    for text in (body, b"<</Root 1 0 R>>"):
        first = syntax.parse_value(syntax.Tokens(text))
        first["More"] = 1
        assert "More" not in syntax.parse_value(syntax.Tokens(text))
    # a rebuilt index takes its trailer from the parser, and adds to it
    lost = b"%PDF-1.4\n1 0 obj\n<</Type /Catalog>>\nendobj\ntrailer\n<</Root 1 0 R>>\nstartxref\n99999\n%%EOF"
    assert Document(lost).trailer == Document(lost).trailer == {"Root": syntax.Ref(1, 0)}


@pytest.mark.parametrize("name, columns", [("page_tree_of", ["page_index", "num", "gen", "node", "depth"]), ("structure_tree_of", ["ord", "depth", "role", "mapped_role"])])
def test_f2_f3_trees_of_a_scan_move_nothing(spark, name, columns):
    draw = random.Random(23)
    rows = [(f"r{k}", bytearray(random_file(draw))) for k in range(80)] + [("deep", bytearray(chain(200)))]
    files = spark.createDataFrame(rows, "doc_id string, content binary").repartition(3)
    straight = getattr(trees, name)(scan(files, "graph", columns=trees.GRAPH_COLUMNS), together=True)
    plan = straight._jdf.queryExecution().executedPlan().toString()
    # that of the files, which were dealt before the scan
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Sort " not in plan
    nodes, trailers = stage(scan(files, "nodes"), "t4-nodes"), stage(scan(files, "trailer_nodes"), "t4-trailers")
    dealt = getattr(trees, name.removesuffix("_of"))(nodes, trailers)
    got, want = (sorted(map(tuple, d.select("doc_id", *columns).collect()), key=str) for d in (straight, dealt))
    assert got == want and len(got) > 100


def test_f3_pages_carry_numbers_of_their_own(spark):
    page = P.Writer().classic({1: b"<</Pages 2 0 R>>", 2: b"<</Kids [5 0 R 6 0 R <</Line 3>>]>>", 5: b"<</Line 7>>", 6: b"<</Line /No>>"}).out
    files = spark.createDataFrame([("a", bytearray(page))], "doc_id string, content binary")
    found = trees.page_tree_of(scan(files, "graph", columns=trees.GRAPH_COLUMNS), carried=("Line",), together=True)
    assert [(r["page_index"], r["num"], r["Line"]) for r in found.orderBy("page_index").collect()] == [(0, 5, 7), (1, 6, None), (2, None, 3)]


def test_f5_f6_rows_of_a_key_make_one_file_across_batches(spark, monkeypatch):
    rows = spark.range(3_000).select((F.col("id") % 41).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("m"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        files = queries.grouped_files(rows, "k", ["n"], ["n", "m"], "own", lambda r: repr((r["k"], [(x["n"], x["m"]) for x in r["own"]])).encode())
        plan = files._jdf.queryExecution().executedPlan().toString()
        found = sorted((int(r["doc_id"]), bytes(r["content"]).decode()) for r in files.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == [(k, repr((k, [(n, n if n % 7 else None) for n in range(k, 3_000, 41)]))) for k in range(41)]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_f7_plain_tokens_of_content_are_read_as_the_general_way_reads_them(monkeypatch):
    rng = random.Random(7)
    tokens = [b"/P", b"/A#42", b"12", b"-1.5", b"+.5", b"1.2.3", b"--4", b"12abc", b"BT", b"T*", b"'", b'"', b"true", b"null", b"<</MCID 3>>", b"<< /A 1 /B /C >>", b"<</A [1]>>", b"<</A 1 0 R>>", b"<</A (x)>>", b"<</A +5>>", b"[1 (a) 2]", b"(s)", b"<41>", b"%c\n", b"<</A 1", b"]", b"EMC", b"BDC", b"BI /W 1 ID xx EI", b"/"]
    for _ in range(3_000):
        body = b"".join(rng.choice(tokens) + rng.choice([b" ", b"\n", b"", b" "]) for _ in range(rng.randint(1, 9)))
        got = list(operation_rows(body))
        with monkeypatch.context() as m:
            m.setattr(content, "_COMMON", re.compile(rb"(?!)"))
            want = list(operation_rows(body))
        assert got == want, body
