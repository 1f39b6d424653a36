"""Trees and graphs of a corpus as joins over ``nodes`` and ``trailer_nodes``.

A vertex is a dictionary (or a stream's, or a kids array that is an object of its own):
``struct<num, gen, node>``.  An edge leads from a vertex to a kid at a place.  A depth-first
walk that enters every vertex once visits it by the smallest of its paths, as arrays of
places are ordered.  No edge leaves a document: trees of the table ``graph`` are followed from
a document's rows in one task, dealt once unless they come straight from a scan; those of
``nodes`` take edges from joins, and ``walk`` follows these.  Order is the order of paths, so positions
are ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.sources.syntax import MAX_DEPTH
from pagequarry.workspace import ship, sorted_join, stage_rows

VALUES = ["kind", "bool_val", "int_val", "real_val", "name_val", "bytes_val", "ref_num", "ref_gen"]
_OBJECT = "struct<num:bigint,gen:bigint>"
#: Rows after which what documents lead to is handed on, and steps of paths in a batch of them.
_BATCH_ROWS, _BATCH_STEPS = 10_000, 100_000
#: Place of a node's own names, after all its kids.
_LAST = (1 << 31) - 1


def vertex(num, gen, node) -> Column:
    return F.struct(F.col(num).cast("bigint").alias("num"), F.col(gen).cast("bigint").alias("gen"), (node if isinstance(node, Column) else F.col(node)).cast("int").alias("node"))


# --- trailers ---------------------------------------------------------------


def merged_trailer(trailer_nodes: DataFrame) -> DataFrame:
    """A document's trailer: of each key the entry of the newest trailer that has it, in order of first mention."""
    entry = F.struct("trailer_ord", "pos", "section_ord", "node_id", *VALUES)
    first = trailer_nodes.where("depth = 1").groupBy("doc_id", "key").agg(F.min_by(entry, "trailer_ord").alias("e"))
    order = W.partitionBy("doc_id").orderBy("trailer_ord", "pos")
    return sorted_join(first.select("doc_id", "key", "e.*").withColumn("pos", F.row_number().over(order) - 1))


def xref_format(trailer_nodes: DataFrame) -> DataFrame:
    """How each document is indexed, from the keys of its merged trailer."""
    is_stream = F.bool_or((F.col("key") == "Type") & (F.col("kind") == "name") & (F.col("name_val") == "XRef"))
    form = F.when(is_stream, "stream").when(F.bool_or(F.col("key") == "XRefStm"), "hybrid").otherwise("classical")
    return merged_trailer(trailer_nodes).groupBy("doc_id").agg(form.alias("xref_format"))


def entry_of(nodes: DataFrame, holders: DataFrame, key: str) -> DataFrame:
    """What the dictionaries ``holders`` (doc_id, v) have under a key: v, the node's place and its values."""
    own = nodes.where(F.col("key") == key).select("doc_id", vertex("num", "gen", "parent_id").alias("v"), vertex("num", "gen", "node_id").alias("at"), *VALUES)
    return sorted_join(own.join(holders.select("doc_id", "v"), ["doc_id", "v"]))


def led_to(nodes: DataFrame, entries: DataFrame, kinds: tuple[str, ...] = ("dict",)) -> DataFrame:
    """Entries with ``to``, the vertex that their value is or refers to, where that is of one of some kinds."""
    direct = entries.where(F.col("kind").isin(*kinds)).withColumn("to", F.col("at"))
    tops = nodes.where((F.col("node_id") == 0) & F.col("kind").isin(*kinds)).select("doc_id", F.col("num").alias("ref_num"), F.col("gen").alias("ref_gen"))
    through = entries.where("kind = 'ref'").join(tops, ["doc_id", "ref_num", "ref_gen"]).withColumn("to", vertex("ref_num", "ref_gen", F.lit(0)))
    return sorted_join(direct.unionByName(through.select(direct.columns)))


def catalogs(trailer_nodes: DataFrame) -> DataFrame:
    """The vertex (doc_id, v) that each document's trailer refers to as its catalog; it has entries only if there is one."""
    return merged_trailer(trailer_nodes).where("key = 'Root' and kind = 'ref'").select("doc_id", vertex("ref_num", "ref_gen", F.lit(0)).alias("v"))


# --- the walk ---------------------------------------------------------------


def _elements(nodes: DataFrame, arrays: DataFrame) -> DataFrame:
    """Elements of arrays (doc_id, p, array): p, place, vertex of the element if it is or refers to a dictionary."""
    own = nodes.where("key is null and node_id > 0").select("doc_id", vertex("num", "gen", "parent_id").alias("array"), "pos", vertex("num", "gen", "node_id").alias("at"), *VALUES)
    found = led_to(nodes, own.join(arrays, ["doc_id", "array"]), ("dict", "stream"))
    return found.select("doc_id", "p", "pos", F.col("to").alias("v"), F.lit(1).alias("step"), (F.col("kind") == "ref").alias("by_ref"))


def kid_edges(nodes: DataFrame, key: str = "Kids") -> DataFrame:
    """Edges from dictionaries to the elements of their array under a key, itself direct or referred to."""
    own = nodes.where((F.col("key") == key) & F.col("kind").isin("array", "ref"))
    array = F.when(F.col("kind") == "array", vertex("num", "gen", "node_id")).otherwise(vertex("ref_num", "ref_gen", F.lit(0)))
    return _elements(nodes, own.select("doc_id", vertex("num", "gen", "parent_id").alias("p"), array.alias("array")))


def walk(edges: DataFrame, roots: DataFrame, root_is_seen: bool) -> DataFrame:
    """doc_id, v, path and depth of every vertex that a walk from the roots enters, the root first.

    ``root_is_seen``: edges back to the root are not followed; else the root's object
    may be entered once more, as a kid, so what was entered as root, and as a dictionary
    inside its object from there, does not count as entered.
    """
    parts = lambda v, start="": [F.col(f"{v}.{c}").alias(start + c) for c in ("num", "gen", "node")]
    rows = edges.select("doc_id", F.lit(False).alias("is_root"), *parts("p", "p_"), "pos", *parts("v"), "step", "by_ref")
    # a root is its own parent here, so no number is missing
    rows = rows.unionByName(roots.select("doc_id", F.lit(True).alias("is_root"), *parts("v", "p_"), F.lit(0).alias("pos"), *parts("v"), F.lit(0).alias("step"), F.lit(False).alias("by_ref")))
    ship(edges.sparkSession)
    # a document's rows stand together, the next document's after them
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    found = dealt.mapInArrow(partial(_walk_documents, root_is_seen=root_is_seen), "doc_id string, num bigint, gen bigint, node int, path array<int>, depth int")
    return sorted_join(found.select("doc_id", vertex("num", "gen", "node").alias("v"), "path", "depth"))


def _walk_documents(batches: Iterator[pa.RecordBatch], root_is_seen: bool) -> Iterator[pa.RecordBatch]:
    """What the walks of one document after the other enter."""
    rows = (row for batch in batches for row in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True))
    types = {"doc_id": pa.string(), "num": pa.int64(), "gen": pa.int64(), "node": pa.int32(), "path": pa.list_(pa.int32()), "depth": pa.int32()}
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))
    held: list[tuple] = []
    steps = 0
    for doc_id, own in groupby(rows, key=itemgetter(0)):
        kids: dict[tuple, list] = {}
        roots = []
        for _, is_root, p_num, p_gen, p_node, pos, num, gen, node, step, by_ref in own:
            if is_root:
                roots.append((num, gen, node))
            else:
                kids.setdefault((p_num, p_gen, p_node), []).append((pos, (num, gen, node), step, by_ref))
        for edges in kids.values():
            if len(edges) > 1:
                edges.sort(reverse=True)
        for root in roots:
            for v, path, depth in _entered(kids, root, root_is_seen):
                held.append((doc_id, *v, path, depth))
                steps += len(path)
                if len(held) >= _BATCH_ROWS or steps >= _BATCH_STEPS:
                    yield packed()
                    held, steps = [], 0
    if held:
        yield packed()


def _entered(kids: dict[tuple, list], root: tuple, root_is_seen: bool) -> Iterator[tuple]:
    """Vertex, path and depth of all that a walk from a root enters; ``kids``: edges by vertex, the last one first."""
    seen = {root} if root_is_seen else set()
    # whether a vertex is the root, or inside its object and entered from there without a reference
    stack: list[tuple] = [(root, not root_is_seen, (), 0)]
    while stack:
        own, as_root, path, depth = stack.pop()
        if path:
            if (own, True) in seen if as_root else own in seen:
                continue
            seen.add((own, True) if as_root else own)
            if depth > MAX_DEPTH:
                continue
        yield own, path, depth
        for pos, v, step, by_ref in kids.get(own, ()):
            stack.append((v, as_root and not by_ref and v[:2] == root[:2], (*path, pos), depth + step))


#: Levels of dictionaries inside each other, in arrays that several nodes share.
_LEVELS = 32


def _with_copies(entered: DataFrame, edges: DataFrame) -> DataFrame:
    """What ``walk`` found, but kids that are no objects of their own as often as a node that was entered holds them.

    A kids array that is an object may be shared, and only references are entered once.
    A dictionary that holds itself by way of such an array is followed ``_LEVELS`` deep.
    """
    inner = edges.where("not by_ref").select("doc_id", "p", "pos", "v")
    if inner.isEmpty():
        return entered
    kids = inner.select("doc_id", "v").distinct()
    out = level = entered.join(kids, ["doc_id", "v"], "left_anti")
    for _ in range(_LEVELS):
        above = level.select("doc_id", F.col("v").alias("p"), "path", "depth")
        level = inner.join(above, ["doc_id", "p"]).select("doc_id", "v", F.concat("path", F.array("pos")).alias("path"), (F.col("depth") + 1).alias("depth"))
        level = stage_rows(level.where(F.col("depth") <= MAX_DEPTH), "tree-copies")
        if level.isEmpty():
            break
        out = sorted_join(out.unionByName(level))
    return out


def _ranked(rows: DataFrame, name: str, *order: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1)


# --- page, name and structure trees ------------------------------------------

#: Columns of the graph that a document's trees are followed by, and what stands for a missing number: which ones are missing is told by kind and node_id.
GRAPH_COLUMNS = ["trailer_ord", "num", "gen", "node_id", "parent_id", "pos", "key", "kind", "int_val", "name_val", "ref_num", "ref_gen"]
_NO_NUMBER = -1


class _Objects:
    """The objects of one document, from its rows: vertices are (num, gen, node), entries and elements (vertex, kind, name, reference, number)."""

    __slots__ = ("tops", "entries", "elements", "root")

    def __init__(self, rows: Iterator[tuple]):
        self.tops: dict[tuple, tuple] = {}
        self.entries: dict[tuple, dict] = {}
        self.elements: dict[tuple, list] = {}
        roots = []
        for _, trailer, num, gen, node, parent, pos, key, kind, number, name, ref_num, ref_gen in rows:
            ref = (ref_num, ref_gen) if kind == "ref" else None
            if trailer != _NO_NUMBER:
                roots.append((trailer, kind, ref))
            elif node == 0:
                self.tops[num, gen] = (kind, name)
            elif key is None:
                self.elements.setdefault((num, gen, parent), []).append((pos, (num, gen, node), kind, ref))
            else:
                own = self.entries.get((num, gen, parent))
                if own is None:
                    own = self.entries[num, gen, parent] = {}
                own[key] = ((num, gen, node), kind, name, ref, number)
        # of the newest trailer that has one
        self.root = min(roots)[2] if roots else None

    def led_to(self, at: tuple, kind: str, ref: tuple | None, kinds: tuple[str, ...]) -> tuple | None:
        """The vertex that a value is or refers to, if that is of one of some kinds."""
        if kind == "ref":
            return (*ref, 0) if self.tops.get(ref, _NOTHING)[0] in kinds else None
        return at if kind in kinds else None

    def entry(self, v: tuple, key: str, kinds: tuple[str, ...]) -> tuple | None:
        found = self.entries.get(v, _EMPTY).get(key)
        return self.led_to(found[0], found[1], found[3], kinds) if found else None

    def name(self, v: tuple, key: str) -> str | None:
        """An entry that is or refers to a name."""
        found = self.entries.get(v, _EMPTY).get(key)
        if found is None:
            return None
        kind, name = self.tops.get(found[3], _NOTHING) if found[1] == "ref" else found[1:3]
        return name if kind == "name" else None

    def from_catalog(self, key: str, kinds: tuple[str, ...]) -> tuple | None:
        return self.entry((*self.root, 0), key, kinds) if self.root else None

    def edges(self, array: tuple) -> list[tuple]:
        """Edges to the dictionaries among an array's elements, the last one first."""
        found = ((pos, self.led_to(at, kind, ref, ("dict", "stream")), 1, kind == "ref") for pos, at, kind, ref in self.elements.get(array, ()))
        return sorted((e for e in found if e[1]), reverse=True)


_NOTHING, _EMPTY = (None, None), {}


class _PageEdges:
    """Edges of /Kids, made where a walk asks for them."""

    def __init__(self, objects: _Objects):
        self.objects = objects

    def get(self, v: tuple, default=()) -> list[tuple]:
        found = self.objects.entries.get(v, _EMPTY).get("Kids")
        if found is None or found[1] not in ("array", "ref"):
            return default
        return self.objects.edges((*found[3], 0) if found[1] == "ref" else found[0])


class _StructureEdges(_PageEdges):
    """Edges of /K: an array or a single dictionary; an array that is an object of its own is a vertex, entered once."""

    def get(self, v: tuple, default=()) -> list[tuple]:
        o = self.objects
        found = o.entries.get(v, _EMPTY).get("K")
        if found is None:
            return o.edges(v) if o.tops.get(v[:2], _NOTHING)[0] == "array" and not v[2] else default
        at, kind, _, ref, _ = found
        if kind == "array":
            return o.edges(at)
        to = o.led_to(at, kind, ref, ("dict", "array"))
        return [(0, to, 0 if o.tops.get(ref, _NOTHING)[0] == "array" else 1, kind == "ref")] if to else default


def _pages_of(o: _Objects, carried: tuple[str, ...]) -> Iterator[tuple]:
    """page_index, num, gen, node, depth and carried numbers of a document's pages."""
    root = o.from_catalog("Pages", ("dict", "stream"))
    if root is None:
        return
    edges = _PageEdges(o)
    # kids that are no objects of their own count as often as a node that was entered holds them, see _with_copies
    level = [e for e in _entered(edges, root, True) if not e[0][2] or e[0] == root]
    found = list(level)
    for _ in range(_LEVELS):
        level = [(w, (*path, pos), depth + 1) for v, path, depth in level if depth < MAX_DEPTH for pos, w, _, by_ref in edges.get(v) if not by_ref and w != root]
        if not level:
            break
        found += level
    found.sort(key=itemgetter(1))
    index = 0
    for v, _, depth in found:
        own = o.entries.get(v, _EMPTY)
        if "Kids" in own or "Count" in own or o.name(v, "Type") == "Pages":
            continue
        numbers = (own[k][4] if k in own and own[k][1] == "int" else None for k in carried)
        yield (index, *((None, None) if v[2] else v[:2]), v[2], depth, *numbers)
        index += 1


def _structure_of(o: _Objects) -> Iterator[tuple]:
    """ord, depth, role and mapped_role of a document's structure elements."""
    root = o.from_catalog("StructTreeRoot", ("dict",))
    if root is None:
        return
    roles = o.entry(root, "RoleMap", ("dict",))
    mapped = {k: e[2] for k, e in o.entries.get(roles, _EMPTY).items() if e[1] == "name"}
    order = 0
    for v, _, depth in _entered(_StructureEdges(o), root, False):
        # kids arrays are vertices, but no elements
        if not v[2] and o.tops.get(v[:2], _NOTHING)[0] == "array":
            continue
        role = o.name(v, "S") or o.name(v, "Type") or ""
        yield order, depth, role, mapped.get(role)
        order += 1


def _by_document(batches: Iterator[pa.RecordBatch], rows_of: Callable[[_Objects], Iterator[tuple]], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of one document after the other; the rows of each stand together."""

    def column(c: pa.Array) -> list:
        return (c.fill_null(_NO_NUMBER) if pa.types.is_integer(c.type) else c).to_numpy(zero_copy_only=False).tolist()

    rows = (row for batch in batches for row in zip(*map(column, batch.columns), strict=True))
    types = {"doc_id": pa.string(), **types}
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types.values(), strict=True)], names=list(types))
    held: list[tuple] = []
    for doc_id, own in groupby(rows, key=itemgetter(0)):
        for row in rows_of(_Objects(own)):
            held.append((doc_id, *row))
            if len(held) >= _BATCH_ROWS:
                yield packed()
                held = []
    if held:
        yield packed()


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _followed(graph: DataFrame, wanted: Column, rows_of: Callable[[_Objects], Iterator[tuple]], columns: dict[str, str], together: bool) -> DataFrame:
    """What a document's own rows of the graph lead to; the wanted ones are dealt by document unless they stand ``together``."""
    ship(graph.sparkSession)
    root = "trailer_ord is not null and parent_id = 0 and key = 'Root'"
    rows = graph.where(F.col("node_id").isNotNull() & (F.expr(root) | (F.col("trailer_ord").isNull() & wanted))).select("doc_id", *GRAPH_COLUMNS)
    if not together:
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    run = partial(_by_document, rows_of=rows_of, types={k: _ARROW[v] for k, v in columns.items()})
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in {"doc_id": "string", **columns}.items()))


def whole_graph(nodes: DataFrame, trailer_nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` and ``trailer_nodes`` as those of ``graph``."""
    own = [c for c in GRAPH_COLUMNS if c != "trailer_ord"]
    missing = lambda *names: [F.lit(None).cast("bigint").alias(c) for c in names]
    ends = trailer_nodes.select("doc_id", "trailer_ord", *missing("num", "gen"), *[c for c in own if c not in ("num", "gen")])
    return ends.unionByName(nodes.select("doc_id", F.lit(None).cast("int").alias("trailer_ord"), *own))


def page_tree(nodes: DataFrame, trailer_nodes: DataFrame) -> DataFrame:
    """Pages in order: doc_id, page_index, num and gen (null for a page inside another object), node, depth.

    By joins over all documents; ``page_tree_of`` follows each document in one task.
    ``nodes`` is read several times: hand a stored table, or one of ``stage``.
    """
    roots = led_to(nodes, entry_of(nodes, catalogs(trailer_nodes), "Pages"), ("dict", "stream")).select("doc_id", F.col("to").alias("v"), F.col("kind").alias("how"))
    roots = stage_rows(roots, "page-roots")
    edges = stage_rows(kid_edges(nodes), "page-edges")
    seen = stage_rows(walk(edges, roots, root_is_seen=True), "page-nodes")
    seen = _with_copies(seen, edges.join(roots.select("doc_id", "v"), ["doc_id", "v"], "left_anti"))
    inner = nodes.where("key in ('Kids', 'Count')").select("doc_id", vertex("num", "gen", "parent_id").alias("v"))
    types = nodes.where("key = 'Type'").select("doc_id", vertex("num", "gen", "parent_id").alias("v"), *VALUES)
    names = nodes.where("node_id = 0 and kind = 'name' and name_val = 'Pages'").select("doc_id", F.col("num").alias("ref_num"), F.col("gen").alias("ref_gen"))
    typed = types.where("kind = 'name' and name_val = 'Pages'").select("doc_id", "v").unionByName(types.where("kind = 'ref'").join(names, ["doc_id", "ref_num", "ref_gen"]).select("doc_id", "v"))
    leaves = seen.join(sorted_join(inner.unionByName(typed)), ["doc_id", "v"], "left_anti")
    own = F.col("v.node") == 0
    return _ranked(leaves, "page_index", "path").select(
        "doc_id", "page_index", F.when(own, F.col("v.num")).alias("num"), F.when(own, F.col("v.gen")).alias("gen"), F.col("v.node").alias("node"), "depth"
    )


def page_tree_of(graph: DataFrame, carried: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """:func:`page_tree` from the table ``graph``, with pages' own entries that are integers, by ``carried`` keys.

    ``together``: the rows of a document stand together, as those of a scan do, so that nothing moves between tasks.
    """
    columns = {"page_index": "int", "num": "bigint", "gen": "bigint", "node": "int", "depth": "int", **{k: "bigint" for k in carried}}
    wanted = F.col("key").isNull() | F.col("key").isin("Pages", "Kids", "Count", "Type", *carried)
    return _followed(graph, wanted, partial(_pages_of, carried=carried), columns, together)


def name_tree(nodes: DataFrame, trailer_nodes: DataFrame, key: str = "EmbeddedFiles") -> DataFrame:
    """Entries of one of the catalog's name trees in order: doc_id, ord, name_bytes, spec (the vertex of its dictionary)."""
    names = led_to(nodes, entry_of(nodes, catalogs(trailer_nodes), "Names")).select("doc_id", F.col("to").alias("v"))
    roots = stage_rows(led_to(nodes, entry_of(nodes, names, key)).select("doc_id", F.col("to").alias("v")), "name-roots")
    edges = stage_rows(kid_edges(nodes), "name-edges")
    holders = _with_copies(stage_rows(walk(edges, roots, root_is_seen=False), "name-nodes"), edges)
    arrays = led_to(nodes, entry_of(nodes, holders.select("doc_id", "v").distinct(), "Names"), ("array",)).select("doc_id", "v", F.col("to").alias("array"))
    own = nodes.where("key is null and node_id > 0").select("doc_id", vertex("num", "gen", "parent_id").alias("array"), "pos", vertex("num", "gen", "node_id").alias("at"), *VALUES)
    items = own.join(arrays, ["doc_id", "array"])
    labels = items.where("pos % 2 = 0 and kind = 'string'").select("doc_id", "v", (F.col("pos") / 2).cast("int").alias("pair"), F.col("bytes_val").alias("name_bytes"))
    specs = led_to(nodes, items.where("pos % 2 = 1"), ("dict", "stream")).select("doc_id", "v", ((F.col("pos") - 1) / 2).cast("int").alias("pair"), F.col("to").alias("spec"))
    found = labels.join(specs, ["doc_id", "v", "pair"]).join(holders, ["doc_id", "v"])
    # a node's names come after all its kids
    return _ranked(found.withColumn("place", F.concat("path", F.array(F.lit(_LAST), F.col("pair")))), "ord", "place").select("doc_id", "ord", "name_bytes", "spec")


def attachments(nodes: DataFrame, trailer_nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """Attached files in tree order: names and the decoded streams that their specifications lead to."""
    specs = stage_rows(name_tree(nodes, trailer_nodes).withColumnRenamed("spec", "v"), "attachment-specs")
    holders = specs.select("doc_id", "v").distinct()
    files = led_to(nodes, entry_of(nodes, holders, "EF")).select("doc_id", F.col("v").alias("outer"), F.col("to").alias("v"))
    held = entry_of(nodes, files.select("doc_id", "v").distinct(), "F").where("kind = 'ref'").select("doc_id", "v", F.col("ref_num").alias("num"), F.col("ref_gen").alias("gen"))
    data = files.join(held, ["doc_id", "v"]).join(streams.select("doc_id", "num", "gen", "decoded", "error"), ["doc_id", "num", "gen"]).select("doc_id", F.col("outer").alias("v"), F.col("decoded").alias("file_bytes"), "error")
    own = F.col("v.node") == 0
    return specs.join(sorted_join(data), ["doc_id", "v"], "left").select("doc_id", "ord", "name_bytes", F.when(own, F.col("v.num")).alias("spec_num"), F.when(own, F.col("v.gen")).alias("spec_gen"), "file_bytes", "error")


def structure_tree(nodes: DataFrame, trailer_nodes: DataFrame) -> DataFrame:
    """Structure elements in reading order: doc_id, ord, depth, role, mapped_role.

    A kids array that is an object is entered by the first /K that names it; that it
    may also stand, without effect, among the kids of an element does not count.
    """
    return structure_tree_of(whole_graph(nodes, trailer_nodes))


def structure_tree_of(graph: DataFrame, together: bool = False) -> DataFrame:
    """:func:`structure_tree` of the table ``graph``; ``together`` as for :func:`page_tree_of`."""
    wanted = F.col("kind").isin("dict", "stream", "array", "ref", "name")
    return _followed(graph, wanted, _structure_of, {"ord": "int", "depth": "int", "role": "string", "mapped_role": "string"}, together)


# --- reachability -----------------------------------------------------------

#: Rounds of joins, each of which reads all edges; documents with longer chains are finished one at a time, in tasks.
REACH_ROUNDS = 3


def reference_edges(nodes: DataFrame) -> DataFrame:
    """Each pair of objects of which the first names the second."""
    return nodes.where("kind = 'ref'").select("doc_id", F.struct("num", "gen").alias("p"), F.struct(F.col("ref_num").alias("num"), F.col("ref_gen").alias("gen")).alias("v")).distinct()


def reachable(nodes: DataFrame, trailer_nodes: DataFrame) -> DataFrame:
    """Objects (doc_id, num, gen) that the trailer leads to, over any number of references.

    Rounds of joins over what the last round found; what was found before is left out
    by an anti join, so a reference is followed once.
    """
    merged = merged_trailer(trailer_nodes).select("doc_id", "trailer_ord", F.col("node_id").alias("top"))
    under = _under(trailer_nodes).join(merged, ["doc_id", "trailer_ord", "top"], "left_semi")
    edges = stage_rows(reference_edges(nodes), "reference-edges")
    tops = nodes.where("node_id = 0").select("doc_id", F.struct("num", "gen").alias("v"))
    start = under.select("doc_id", F.struct(F.col("ref_num").alias("num"), F.col("ref_gen").alias("gen")).alias("v")).distinct()
    delta = seen = stage_rows(start.join(tops, ["doc_id", "v"], "left_semi"), "reached")
    for _ in range(REACH_ROUNDS):
        found = delta.select("doc_id", F.col("v").alias("p")).join(edges, ["doc_id", "p"]).select("doc_id", "v").distinct()
        delta = stage_rows(found.join(seen, ["doc_id", "v"], "left_anti").join(tops, ["doc_id", "v"], "left_semi"), "reached")
        if delta.isEmpty():
            break
        seen = sorted_join(seen.unionByName(delta))
    else:
        open_docs = delta.select("doc_id").distinct()
        mine = seen.join(open_docs, "doc_id", "left_semi").select("doc_id", F.lit(None).cast(_OBJECT).alias("p"), "v")
        rest = edges.join(open_docs, "doc_id", "left_semi").join(tops, ["doc_id", "v"], "left_semi").select("doc_id", "p", "v").unionByName(mine)
        flat = rest.select("doc_id", F.col("p.num").alias("p_num"), F.col("p.gen").alias("p_gen"), F.col("v.num").alias("num"), F.col("v.gen").alias("gen"))
        # a document's rows stand together, the next document's after them; a pandas frame for each would take most of the time
        flat = flat.repartition("doc_id").sortWithinPartitions("doc_id")
        done = flat.mapInArrow(_reach_documents, "doc_id string, num bigint, gen bigint").select("doc_id", F.struct("num", "gen").alias("v"))
        seen = seen.join(open_docs, "doc_id", "left_anti").unionByName(done)
    return sorted_join(seen.select("doc_id", "v.*"))


def _under(trailer_nodes: DataFrame) -> DataFrame:
    """References of trailers with the entry (node number) that they stand under; trailers are few and flat."""
    parents = F.map_from_entries(F.collect_list(F.struct("node_id", "parent_id")))
    trees = trailer_nodes.where("node_id is not null").groupBy("doc_id", "trailer_ord").agg(parents.alias("up"), F.collect_list(F.when(F.col("kind") == "ref", F.struct("node_id", "depth", "ref_num", "ref_gen"))).alias("refs"))
    climbed = lambda r: F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH)), r["node_id"], lambda at, _: F.when(F.col("up")[at] == 0, at).otherwise(F.coalesce(F.col("up")[at], at)))
    shallow = lambda r: F.when(r["depth"] == 1, r["node_id"]).when(r["depth"] == 2, F.col("up")[r["node_id"]]).otherwise(climbed(r))
    return trees.select("doc_id", "trailer_ord", "up", F.explode("refs").alias("r")).select("doc_id", "trailer_ord", shallow(F.col("r")).alias("top"), "r.ref_num", "r.ref_gen")


def _reach_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the objects without ``p_num`` lead to, of one document after the other."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list[tuple[str, int, int]] = []
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "num", "gen"])
    for doc_id, own in groupby(rows, key=itemgetter(0)):
        kids: dict[tuple, list] = {}
        stack = []
        for _, p_num, p_gen, num, gen in own:
            if p_num is None:
                stack.append((num, gen))
            else:
                kids.setdefault((p_num, p_gen), []).append((num, gen))
        seen = set(stack)
        while stack:
            for v in kids.get(stack.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    stack.append(v)
        held += [(doc_id, *v) for v in seen]
        if len(held) >= _BATCH_ROWS:
            yield packed()
            held = []
    if held:
        yield packed()


def unreachable(nodes: DataFrame, trailer_nodes: DataFrame) -> DataFrame:
    """Objects that the trailer does not lead to, dead ones that name each other among them."""
    objects = nodes.where("node_id = 0").select("doc_id", "num", "gen")
    return objects.join(reachable(nodes, trailer_nodes), ["doc_id", "num", "gen"], "left_anti")
