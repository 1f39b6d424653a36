"""Trees as joins against walks by hand: shared kids, cycles, arrays of their own, deep nesting, long chains."""

import random

import pytest

from pagequarry.operators import trees, views
from pagequarry.sources.scan import scan
from pagequarry.testing import pdfwriter as P
from pagequarry.workspace import stage


def random_file(draw: random.Random) -> bytes:
    """A catalog with a page tree, a name tree and a structure tree over few objects, so that kids are shared and cycles occur."""
    n = draw.randint(3, 9)
    refs = [b"%d 0 R" % k for k in range(10, 10 + n)]

    def value(depth: int, key: bytes) -> bytes:
        kind = draw.random()
        if kind < 0.6 or depth > 2:
            return draw.choice([*refs, *refs, b"7 0 R", b"99 0 R", b"5"])
        return dictionary(depth + 1, key)

    def array(depth: int, key: bytes) -> bytes:
        return b"[" + b" ".join(value(depth, key) for _ in range(draw.randint(0, 4))) + b"]"

    def dictionary(depth: int, key: bytes) -> bytes:
        out = b"<<"
        if draw.random() < 0.6:
            out += b"/" + key + b" " + draw.choice([array(depth, key), array(depth, key), b"30 0 R", b"31 0 R", draw.choice(refs), dictionary(depth + 1, key) if depth < 2 else b"3"])
        if draw.random() < 0.2:
            out += b" /Count 2"
        if draw.random() < 0.5:
            out += draw.choice([b" /Type /Pages", b" /Type /Page", b" /Type 32 0 R", b" /S /P", b" /S /Mapped"])
        if draw.random() < 0.5:
            out += b" /Names [(a) %s /x %s (b) %s (odd)]" % (draw.choice(refs), draw.choice(refs), draw.choice(refs))
        return out + b">>"

    key = draw.choice([b"Kids", b"K"])
    objects = {10 + k: dictionary(0, key) if draw.random() < 0.9 else P.stream(b"x", b"/Kids [11 0 R]") for k in range(n)}
    # kids arrays of their own are no kids themselves
    refs = refs[:-1] + refs[:1]
    objects |= {30: array(0, key), 31: array(1, key), 32: b"/Pages", 33: b"<</Mapped /Sect /P /Q>>"}
    objects[2], objects[3], objects[4] = dictionary(0, b"Kids"), dictionary(0, b"Kids"), b"<</Type /StructTreeRoot /RoleMap %s /K %s>>" % (draw.choice([b"33 0 R", b"<</P /Div>>"]), array(0, b"K"))
    if draw.random() < 0.3:
        objects[2] = b"<</Kids [10 0 R 2 0 R 11 0 R]>>"
        objects[3] = b"<</Kids [10 0 R 3 0 R 11 0 R]>>"
    objects[7] = b"<</Kids [2 0 R 10 0 R] /K [4 0 R 3 0 R]>>"
    objects[1] = b"<</Type /Catalog /Pages 2 0 R /Names <</EmbeddedFiles 3 0 R>> /StructTreeRoot 4 0 R>>"
    return bytes(P.Writer().classic(objects).out)


def chain(n: int) -> bytes:
    """Page nodes nested n deep, with a page beside each."""
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>"}
    for k in range(n):
        objects[2 + 2 * k] = b"<</Type /Pages /Kids [%d 0 R %d 0 R]>>" % (4 + 2 * k, 3 + 2 * k)
        objects[3 + 2 * k] = b"<</Type /Page>>"
    objects[2 + 2 * n] = b"<</Type /Page>>"
    return bytes(P.Writer().classic(objects).out)


def entangled(n: int) -> bytes:
    """Kids whose first edges all change, one after the other."""
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [%s]>>" % b" ".join(b"%d 0 R" % k for k in range(10 + n, 9, -1))}
    for k in range(10, 11 + n):
        objects[k] = b"<</Kids [%s %d 0 R]>>" % (b" ".join(b"%d 0 R" % j for j in range(max(10, k - 2), k)), 100 + k)
        objects[100 + k] = b"<</Type /Page>>"
    return bytes(P.Writer().classic(objects).out)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(11)
    rows = [(f"r{k}", random_file(draw)) for k in range(60)] + [("deep", chain(300)), ("entangled", entangled(12)), ("none", b""), ("flat", chain(1))]
    files = spark.createDataFrame(rows, "doc_id string, content binary").repartition(4)
    return files, stage(scan(files, "nodes"), "t-nodes"), stage(scan(files, "trailer_nodes"), "t-trailers")


def by_doc(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out


def test_pages_equal_the_walk(corpus):
    files, nodes, trailers = corpus
    want = by_doc(scan(files, "page_spine", columns=["page_index", "num", "gen"]).orderBy("doc_id", "page_index").collect(), "page_index", "num", "gen")
    got = by_doc(trees.page_tree(nodes, trailers).orderBy("doc_id", "page_index").collect(), "page_index", "num", "gen")
    assert got["deep"][0] == (0, 2 + 2 * 300, 0) and len(got["deep"]) == 301
    different = {d for d in set(want) | set(got) if want.get(d) != got.get(d)}
    assert not different, [(d, want.get(d), got.get(d)) for d in sorted(different)[:2]]


def test_structure_equals_the_walk(corpus):
    files, nodes, trailers = corpus
    columns = ("ord", "depth", "role", "mapped_role")
    want = by_doc(scan(files, "struct_elems").orderBy("doc_id", "ord").collect(), *columns)
    got = by_doc(trees.structure_tree(nodes, trailers).orderBy("doc_id", "ord").collect(), *columns)
    different = {d for d in set(want) | set(got) if want.get(d) != got.get(d)}
    assert not different, [(d, want.get(d), got.get(d)) for d in sorted(different)[:2]]


def test_names_equal_the_walk(corpus):
    files, nodes, trailers = corpus
    columns = ("ord", "name_bytes", "spec_num", "spec_gen")
    want = by_doc(views.embedded_files(files).orderBy("doc_id", "ord").collect(), *columns)
    got = by_doc(trees.attachments(nodes, trailers, scan(files, "streams")).orderBy("doc_id", "ord").collect(), *columns)
    # a dictionary that holds itself by way of an array is followed to another depth
    different = {d for d in set(want) | set(got) if want.get(d) != got.get(d) and len(want.get(d, ())) < 1_000}
    assert not different, [(d, want.get(d), got.get(d)) for d in sorted(different)[:2]]


def test_formats_equal_the_scan(corpus):
    files, _, trailers = corpus
    want = {r["doc_id"]: r["xref_format"] for r in scan(files, "documents", columns=["xref_format", "error"]).where("error is null").collect()}
    assert {r["doc_id"]: r["xref_format"] for r in trees.xref_format(trailers).collect()} == want


@pytest.mark.parametrize("rounds", [10, 2])
def test_dead_objects_that_name_each_other(spark, monkeypatch, rounds):
    monkeypatch.setattr(trees, "REACH_ROUNDS", rounds)
    base = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Kids [3 0 R]>>", 3: b"<</Next 4 0 R>>", 4: b"[5 0 R [6 0 R <</X 77 0 R>>]]", 5: b"1", 6: b"<</Back 1 0 R>>"}
    dead = {8: b"<</Other 9 0 R>>", 9: b"<</Other 8 0 R /Up 1 0 R>>", 10: b"(alone)"}
    rows = [("a", bytes(P.Writer().classic({**base, **dead, 12: b"<</Title (t) /Far 13 0 R>>", 13: b"1"}, b"/Root 1 0 R /Info 12 0 R /Deep [<</R [14 0 R]>>]").out)), ("b", bytes(P.Writer().classic(base).out))]
    files = spark.createDataFrame(rows, "doc_id string, content binary")
    nodes, trailers = stage(scan(files, "nodes"), "n"), stage(scan(files, "trailer_nodes"), "t")
    assert sorted((r["doc_id"], r["num"]) for r in trees.unreachable(nodes, trailers).collect()) == [("a", 8), ("a", 9), ("a", 10)]


def test_newer_trailers_win(spark):
    w = P.Writer().classic({1: b"<</Type /Catalog>>", 3: b"1"}, b"/Root 1 0 R /A 1 /B 1")
    w.classic({4: b"2"}, b"/Root 1 0 R /B 2 /C 2")
    w.classic({4: b"3"}, b"/Root 1 0 R /A 3")
    files = spark.createDataFrame([("d", bytes(w.out))], "doc_id string, content binary")
    rows = trees.merged_trailer(scan(files, "trailer_nodes")).where("key in ('A', 'B', 'C')").orderBy("pos").collect()
    assert [(r["key"], r["int_val"], r["section_ord"]) for r in rows] == [("A", 3, 0), ("B", 2, 1), ("C", 2, 1)]
