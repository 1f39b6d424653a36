"""Objects as VARIANT: lenient getters that miss, strict ones that say why; digests that settle over references."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.workspace import ship, stage_rows

#: Kinds of values, how the tagged form names them, and their type here.
KINDS = {"bool": ("bool", "boolean"), "int": ("int", "bigint"), "real": ("real", "double"), "name": ("name", "string"), "text": ("text", "string"), "array": ("array", "variant"), "dict": ("dict", "variant")}


def as_variant(objects: DataFrame) -> DataFrame:
    """Objects that can be read, as one VARIANT each: doc_id, num, gen, value."""
    return objects.where("error is null").select("doc_id", "num", "gen", F.parse_json("tagged_json").alias("value"))


def resolved(values: DataFrame, key: str) -> DataFrame:
    """Every object with ``found``: what its dictionary has under a key, references followed one step; SQL null if it has none.

    A stream counts as its dictionary.  A missing object is a null value.
    """
    own = F.coalesce(F.try_variant_get("value", f"$.dict['{key}']", "variant"), F.try_variant_get("value", f"$.stream.dict['{key}']", "variant"))
    held = values.select("doc_id", "num", "gen", own.alias("own"))
    ref = F.split(F.try_variant_get("own", "$.ref", "string"), " ")
    held = held.withColumn("to_num", F.get(ref, 0).cast("bigint")).withColumn("to_gen", F.get(ref, 1).cast("bigint"))
    far = values.select("doc_id", F.col("num").alias("to_num"), F.col("gen").alias("to_gen"), F.col("value").alias("far"))
    joined = held.join(far, ["doc_id", "to_num", "to_gen"], "left")
    found = F.when(F.col("to_num").isNull(), F.col("own")).otherwise(F.coalesce("far", F.parse_json(F.lit('{"null":null}'))))
    return joined.select("doc_id", "num", "gen", found.alias("found"))


def lenient(found: Column, kind: str) -> Column:
    """The value if it is of a kind, else null."""
    tag, form = KINDS[kind]
    plain = F.try_variant_get(found, f"$.{tag}", form)
    return F.coalesce(plain, F.try_variant_get(found, "$.stream.dict", form)) if kind == "dict" else plain


def strict(found: Column, kind: str) -> Column:
    """struct(value, error): the value of a kind, or what is there instead."""
    tag = F.get(F.json_object_keys(F.to_json(found)), 0)
    value = lenient(found, kind)
    error = F.when(found.isNull(), "no such entry").when(value.isNull(), F.concat(F.lit(f"{kind} expected, found "), F.coalesce(tag, F.lit("nothing"))))
    return F.struct(value.alias("value"), error.alias("error"))


# --- digests ----------------------------------------------------------------

#: Rounds after which digests are first asked whether they have settled; twice as many each time they have not.
FIRST_ROUNDS = 4
#: Rows after which digests are handed on.
_BATCH_ROWS = 10_000


def settled_digests(nodes: DataFrame, streams: DataFrame | None = None, rounds: int = 64) -> DataFrame:
    """A digest of each object and of all it leads to, whatever the numbers of objects: doc_id, num, gen, digest.

    Digests start from objects with their references left out (and from the raw bytes
    of streams, if given), and take in those of the objects they refer to, again and
    again, until they tell no more objects apart than before; cycles settle as well.
    A chain of more than ``rounds`` objects that differ at its end alone counts as equal
    from there on.  References stay inside a document, so all rounds of a document are
    made where its objects are; only whether they have settled is asked of all together.
    """
    value = F.concat_ws(
        "\x1f", "node_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("")), F.coalesce("key", F.lit("")), "kind",
        F.coalesce(F.col("bool_val").cast("string"), F.lit("")), F.coalesce(F.col("int_val").cast("string"), F.lit("")),
        F.coalesce(F.col("real_val").cast("string"), F.lit("")), F.coalesce("name_val", F.lit("")), F.coalesce(F.hex("bytes_val"), F.lit("")),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", value.alias("v")))), lambda x: x["v"]), "\x1e")
    refs = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "ref", F.struct("node_id", "ref_num", "ref_gen")))), lambda x: F.struct(x["ref_num"].alias("num"), x["ref_gen"].alias("gen")))
    own = nodes.where("node_id is not null").groupBy("doc_id", "num", "gen").agg(text.alias("text"), refs.alias("refs"))
    body = F.lit("")
    if streams is not None:
        own = own.join(streams.select("doc_id", "num", "gen", F.sha2("raw", 256).alias("raw_sha")), ["doc_id", "num", "gen"], "left")
        body = F.coalesce("raw_sha", F.lit(""))
    ship(nodes.sparkSession)
    objects = own.select("doc_id", "num", "gen", F.unhex(F.sha2(F.concat_ws("\x1d", "text", body), 256)).alias("base"), "refs")
    objects = stage_rows(objects, "digest-objects")
    most = min(FIRST_ROUNDS, rounds)
    while True:
        # a document's rows stand together, the next document's after them
        dealt = objects.repartition("doc_id").sortWithinPartitions("doc_id")
        digests = stage_rows(dealt.mapInArrow(partial(_digest_rounds, rounds=most), "doc_id string, num bigint, gen bigint, before binary, digest binary"), "digests")
        if most >= rounds or digests.groupBy("before").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").isEmpty():
            return digests.select("doc_id", "num", "gen", "digest")
        most = min(2 * most, rounds)


def _digest_rounds(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    """Digests of a document's objects after ``rounds`` rounds, and after one round less."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "num", "gen", "before", "digest"])

    for doc_id, found in groupby(rows, key=itemgetter(0)):
        now, leading = {}, []
        for _, num, gen, base, refs in found:
            now[num, gen] = base
            if refs:
                leading.append(((num, gen), base, [(r["num"], r["gen"]) for r in refs]))
        before = now
        for _ in range(rounds if leading else 0):
            before, now = now, now.copy()
            for key, base, refs in leading:
                now[key] = sha256(b"\x1d".join((base, *(before.get(r, b"null") for r in refs)))).digest()
        held += [(doc_id, *key, before[key], digest) for key, digest in now.items()]
        if len(held) >= _BATCH_ROWS:
            yield packed()
            held = []
    if held:
        yield packed()


def settled_versions(left: DataFrame, right: DataFrame, left_streams: DataFrame | None = None, right_streams: DataFrame | None = None) -> DataFrame:
    """Digests of two versions of documents (tables ``nodes``), ``side`` < and >.

    Digests of both settle together, as only then equal ones mean equal objects; among the
    objects of one side they tell apart what they would if that side settled alone.
    """
    side = lambda rows, mark: rows.withColumn("doc_id", F.concat(F.lit(mark), "doc_id"))
    streams = None if left_streams is None else side(left_streams, "<").unionByName(side(right_streams, ">"))
    both = settled_digests(side(left, "<").unionByName(side(right, ">")), streams)
    return both.select(F.substring("doc_id", 1, 1).alias("side"), F.expr("substring(doc_id, 2)").alias("doc_id"), "num", "gen", "digest")


def diff_of(versions: DataFrame) -> DataFrame:
    """Objects of ``settled_versions`` that the other side lacks: doc_id, num, gen, change (removed or added)."""
    once = versions.groupBy("doc_id", "digest").agg(F.count_distinct("side").alias("n")).where("n = 1")
    change = F.when(F.col("side") == "<", "removed").otherwise("added")
    return versions.join(once, ["doc_id", "digest"], "left_semi").select("doc_id", "num", "gen", change.alias("change"))


def diff_by_content(left: DataFrame, right: DataFrame, left_streams: DataFrame | None = None, right_streams: DataFrame | None = None) -> DataFrame:
    """Objects of two versions of documents that the other one lacks, see ``settled_versions`` and ``diff_of``."""
    return diff_of(settled_versions(left, right, left_streams, right_streams))


def copies(digests: DataFrame) -> DataFrame:
    """Classes of objects that are equal with all they lead to, across documents: digest, n, and the first of each."""
    return digests.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "num", "gen")).alias("first")).where("n > 1").select("digest", "n", "first.*")
