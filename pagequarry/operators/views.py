"""Relational views over scanned tables: precedence, resolution, inheritance, assembly.

What joins ``nodes`` with itself reads it twice: hand a stored table, so that files are parsed once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import text as T
from pagequarry.sources.scan import INFO_KEYS, ScanOptions, scan, schema_of


def live_entries(entries: DataFrame) -> DataFrame:
    """The entry in force of each object: the first one in section order; free ones never count."""
    first = W.partitionBy("doc_id", "num", "gen").orderBy("section_ord", "entry_ord")
    return entries.where(F.col("kind").isin(1, 2)).withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def effective_version(documents: DataFrame) -> DataFrame:
    """Documents with the later of header's and catalog's version, compared as text."""
    later = F.col("catalog_version") > F.col("header_version")
    return documents.withColumn("effective_version", F.when(later, F.col("catalog_version")).otherwise(F.col("header_version")))


def references(nodes: DataFrame) -> DataFrame:
    """Every reference with what it leads to: kind null where the object is missing."""
    target = nodes.where("node_id = 0").select("doc_id", F.col("num").alias("ref_num"), F.col("gen").alias("ref_gen"), F.col("kind").alias("target_kind"))
    held = nodes.where("kind = 'ref'").select("doc_id", "num", "gen", "node_id", "parent_id", "key", "ref_num", "ref_gen")
    return held.join(target, ["doc_id", "ref_num", "ref_gen"], "left").withColumn("dangling", F.col("target_kind").isNull()).withColumn("target_kind", F.coalesce("target_kind", F.lit("null")))


def unreferenced(nodes: DataFrame, trailers: DataFrame) -> DataFrame:
    """Objects that no other object and no trailer names."""
    objects = nodes.where("node_id = 0").select("doc_id", "num", "gen")
    held = nodes.where("kind = 'ref'").select("doc_id", F.col("ref_num").alias("num"), F.col("ref_gen").alias("gen"))
    pairs = F.regexp_extract_all(F.col("json"), F.lit(r'\{"ref":"(\d+ \d+)"\}'), F.lit(1))
    ends = trailers.select("doc_id", F.explode(pairs).alias("r")).select("doc_id", F.split_part("r", F.lit(" "), F.lit(1)).cast("long").alias("num"), F.split_part("r", F.lit(" "), F.lit(2)).cast("long").alias("gen"))
    return objects.join(held.unionByName(ends), ["doc_id", "num", "gen"], "left_anti")


def dict_values(nodes: DataFrame) -> DataFrame:
    """Values of top-level dictionaries by key, references followed one step."""
    own = nodes.where("depth = 1 and key is not null").select("doc_id", "num", "gen", "key", "pos", *_VALUES)
    top = nodes.where("node_id = 0").select("doc_id", F.col("num").alias("ref_num"), F.col("gen").alias("ref_gen"), *[F.col(c).alias(f"t_{c}") for c in _VALUES if not c.startswith("ref")])
    joined = own.join(top, ["doc_id", "ref_num", "ref_gen"], "left")
    is_ref = F.col("kind") == "ref"
    out = [F.when(is_ref, F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) for c in _VALUES if not c.startswith("ref") and c != "kind"]
    return joined.select("doc_id", "num", "gen", "key", "pos", F.when(is_ref, F.coalesce("t_kind", F.lit("null"))).otherwise(F.col("kind")).alias("kind"), *out)


_VALUES = ["kind", "bool_val", "int_val", "real_val", "name_val", "bytes_val", "ref_num", "ref_gen"]


def inherited(key: str, levels: Column | None = None) -> Column:
    """A page's attribute: of its chain, from itself upwards, the first that has the key."""
    attributes = levels if levels is not None else F.col("attributes")
    # the scan lists a page's own attributes before its parents'
    return F.get(F.filter(attributes, lambda a: a["key"] == key), 0)


def joined_content(parts: Column) -> Column:
    """Content streams of a page as one, parted by line feeds; none is empty."""
    whole = F.aggregate(parts, F.lit(None).cast("binary"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, F.lit(b"\n"), x)))
    return F.when(parts.isNotNull(), F.coalesce(whole, F.lit(b"")))


#: Boxes of a page (fixed values).
BOXES = {"MediaBox": "media_box", "CropBox": "crop_box", "BleedBox": "bleed_box", "TrimBox": "trim_box", "ArtBox": "art_box"}


def pages(files: DataFrame, options: ScanOptions | None = None, contents: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Pages with boxes, rotation, resource names and (unless told not to decode it) content; no shuffle is needed.

    Of ``columns`` only these, beside doc_id, and the scan makes only what they need.
    """
    if columns is not None:
        needed = dict.fromkeys("contents" if c == "content" else c if c in _SPINE else "attributes" for c in columns)
        spine = scan(files, "page_spine", replace(options or ScanOptions(), contents=contents), columns=tuple(needed))
        missing = [c for c in ("page_index", "num", "gen", "parents", "attributes", "contents", "content_error") if c not in needed]
        # columns that are not asked for are named below, and left out of the plan
        whole = spine.select("*", *[F.lit(None).cast(schema_of("page_spine")[c].dataType).alias(c) for c in missing])
        return _pages(whole).select("doc_id", *columns)
    return _pages(scan(files, "page_spine", replace(options or ScanOptions(), contents=contents)))


#: Columns of pages that the scan itself has.
_SPINE = {"page_index", "num", "gen", "parents", "content_error"}


def _pages(spine: DataFrame) -> DataFrame:
    box = lambda key: F.when(inherited(key)["kind"] == "array", T.normal_rect(inherited(key)["numbers"]))
    rotate = inherited("Rotate")
    return spine.select(
        "doc_id", "page_index", "num", "gen", "parents", *[box(k).alias(v) for k, v in BOXES.items()],
        F.map_filter(F.create_map(*[c for k in BOXES for c in (F.lit(k), box(k))]), lambda _, rect: rect.isNotNull()).alias("boxes"),
        F.coalesce(T.normal_rotation(rotate["kind"], rotate["int_val"]), F.lit(0)).alias("rotation"),
        F.array_sort(inherited("Resources")["keys"]).alias("resource_keys"), joined_content(F.col("contents")).alias("content"), "content_error",
    )


DATES = {"creation_date": "creation_tz_s", "mod_date": "mod_tz_s"}


def document_info(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """One row per file that opens: standard entries as text and instants, all others as a map; no shuffle is needed."""
    raw = scan(files, "info", options)
    texts = [k for k in INFO_KEYS.values() if k not in DATES]
    shown = raw.select("doc_id", *[T.decode_text(F.col(k)).alias(k) for k in texts], *[T.decode_text(F.col(k)).alias(k) for k in DATES], "custom")
    dates = [c for k, offset in DATES.items() for c in (T.parse_date(F.col(k)).alias(k), T.date_offset(F.col(k)).alias(offset))]
    custom = F.map_from_entries(F.transform("custom", lambda e: F.struct(e["key"].alias("key"), T.decode_text(e["value"]).alias("value"))))
    return shown.select("doc_id", *texts, *dates, custom.alias("custom"))


def embedded_files(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Attachments in tree order, names as bytes and decoded."""
    return scan(files, "attachments", options).withColumn("name", T.decode_text(F.col("name_bytes")))


def structure(files: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Structure elements in reading order with their roles, mapped where a map says so."""
    return scan(files, "struct_elems", options)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Objects that two scans of ``objects`` do not share: added, removed or changed."""
    key = ["doc_id", "num", "gen"]
    a = left.where("error is null").select(*key, F.xxhash64("tagged_json").alias("h1"), F.col("tagged_json").alias("before"))
    b = right.where("error is null").select(*key, F.xxhash64("tagged_json").alias("h2"), F.col("tagged_json").alias("after"))
    state = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed")
    return a.join(b, key, "full").withColumn("change", state).where("change is not null").drop("h1", "h2")
