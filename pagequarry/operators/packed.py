"""Objects that are packed in streams, as a join of index entries with cut-up containers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.functions import codecs
from pagequarry.operators import views
from pagequarry.sources.scan import SCHEMAS, node_rows
from pagequarry.sources.syntax import PdfError, Tokens, parse_value
from pagequarry.workspace import ship, sorted_join, stage_rows


def containers(nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """Object streams with their decoded content, /N and /First; ``why`` they cannot be read, else null."""
    values = views.dict_values(nodes.where("depth <= 1")).where("key in ('Type', 'N', 'First')").groupBy("doc_id", "num", "gen")
    pick = lambda key, kind, column: F.max(F.when((F.col("key") == key) & (F.col("kind") == kind), F.col(column)))
    found = values.agg(pick("Type", "name", "name_val").alias("type"), pick("N", "int", "int_val").alias("n"), pick("First", "int", "int_val").alias("first")).where("gen = 0")
    held = found.join(streams.select("doc_id", "num", "gen", "decoded", "error"), ["doc_id", "num", "gen"])
    size = F.octet_length("decoded")
    why = (
        F.when(F.coalesce(F.col("type") != "ObjStm", F.lit(True)), "no object stream")
        .when(F.col("n").isNull() | F.col("first").isNull(), "object stream without /N or /First")
        .when(F.col("decoded").isNull(), F.coalesce("error", F.lit("no content")))
        .when(~F.col("first").between(0, size) | ~F.col("n").between(0, size), "object stream with implausible /N or /First")
    )
    return held.select("doc_id", F.col("num").alias("stm_num"), "n", "first", "decoded", why.alias("why"))


def packed_objects(entries: DataFrame, nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """Every live object of kind 2 with the bytes that hold it: doc_id, num, stm_num, stm_idx, body, error.

    A container is cut once, by the pairs of numbers at its head; an object's bytes
    end where the next one starts.  Only bodies are joined, never whole containers.
    """
    live = views.live_entries(entries).where("kind = 2").select("doc_id", "num", "stm_num", "stm_idx")
    head = F.decode(F.substr("decoded", F.lit(1), F.col("first").cast("int")), "ISO-8859-1")
    numbers = F.transform(F.regexp_extract_all(head, F.lit(r"(?<![^\x00\t\n\f\r ])[+-]?\d+(?![^\x00\t\n\f\r ])"), F.lit(0)), lambda t: t.try_cast("bigint"))
    cut = containers(nodes, streams)
    starts = lambda ns: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get(ns, (2 * k + 1).cast("int")))
    pairs = codecs.let(F.when(F.col("why").isNull(), numbers), lambda ns: F.struct(ns.alias("numbers"), starts(ns).alias("starts")))
    cut = cut.withColumn("pairs", pairs).select("*", "pairs.*").drop("pairs")
    short = F.size("numbers") < 2 * F.col("n")
    cut = cut.withColumn("why", F.coalesce("why", F.when(short, "bad object stream header"))).where("n > 0")
    cut = cut.withColumn("edges", F.array_sort(F.array_distinct(F.concat("starts", F.array(F.octet_length("decoded").cast("bigint") - F.col("first"))))))

    # stored: an array that is only defined would be made again for each of its elements
    cut = stage_rows(cut, "cut-containers")
    held = cut.where("why is null")
    size = F.octet_length("decoded")
    inside = (F.col("at") >= 0) & (F.col("at") + F.col("first") < F.col("size"))
    members = held.select("doc_id", "stm_num", "first", size.alias("size"), "numbers", F.posexplode("starts").alias("k", "at"))
    members = members.select("doc_id", "stm_num", F.col("k").cast("bigint").alias("stm_idx"), F.get("numbers", 2 * F.col("k")).alias("held"), "at", inside.alias("inside"))
    # each start once, with the bytes up to the next one; a member finds its own by a join, not by a search in the array
    piece = F.substr("decoded", (F.col("first") + F.col("at") + 1).cast("int"), (F.get("edges", F.col("i") + 1) - F.col("at")).cast("int"))
    edge = held.select("doc_id", "stm_num", "first", "decoded", "edges", F.posexplode("edges").alias("i", "at"))
    edge = edge.where((F.col("at") >= 0) & (F.col("at") + F.col("first") < size))
    bodies = edge.select("doc_id", "stm_num", "at", F.coalesce(piece, F.lit(b"")).alias("piece"))
    mine = members.join(bodies, ["doc_id", "stm_num", "at"], "left").select(
        "doc_id", "stm_num", "stm_idx", "held", F.when(F.col("inside"), F.col("piece")).alias("body"), F.when(~F.col("inside"), "object offset out of range").alias("error")
    )
    bad = cut.where("why is not null").select("doc_id", "stm_num", "why")
    joined = live.join(sorted_join(mine), ["doc_id", "stm_num", "stm_idx"], "left").join(bad, ["doc_id", "stm_num"], "left")
    fits = F.coalesce(F.col("held") == F.col("num"), F.lit(False))
    missing = F.when(~fits, F.concat_ws(" ", F.lit("object stream"), "stm_num", F.lit("does not hold"), "num", F.lit("at"), "stm_idx"))
    return joined.select("doc_id", "num", "stm_num", "stm_idx", F.when(fits, F.col("body")).alias("body"), F.coalesce("why", missing, "error").alias("error"))


_NODES = SCHEMAS["nodes"]


def parse_bodies(rows: DataFrame) -> DataFrame:
    """``nodes`` of objects given as bytes (doc_id, num, gen, body); bytes that are no object give a row with an error."""
    ship(rows.sparkSession)
    schema = StructType.fromDDL(f"doc_id string, {_NODES}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, num, gen, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(doc_id, num, gen, *r, None) for r in node_rows(parse_value(Tokens(body)))]
                except PdfError as e:
                    out.append((doc_id, num, gen, *[None] * 13, str(e)))
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select("doc_id", F.col("num").cast("bigint").alias("num"), F.col("gen").cast("bigint").alias("gen"), "body").where("body is not null").mapInArrow(run, schema)
