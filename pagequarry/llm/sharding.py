"""Sharding by minimax contiguous partition.

Documents with equal text form one atomic group.  Groups are ordered by the
64-bit hash of their text; a shard is a contiguous run of that order.  The
smallest capacity for which a greedy pass needs no more than ``n_shards``
shards is found by binary search, and the runs are cut where that pass cuts.

The driver never sees the groups.  It sees sums over ranges of the order, and
asks for finer sums only of the ranges in which a cut may still fall, so the
answer is exact while the driver holds some thousands of numbers at any input
size.  All work on rows is DataFrame code.

Defined results: a null text counts as the empty text; repeated rows each get a
slot; an empty table gives an empty result; columns other than the id and the
text are never looked at, so their names may clash freely.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.workspace import stage

FIRST_BITS = 12
MORE_BITS = 8
#: Bytes of one part of a shard that is written.
PART_BYTES = 256 << 20
ROW_OVERHEAD = 8
#: Rows of one shard are numbered in this many independent parts.
CELLS = 1024


@dataclass(frozen=True)
class Span:
    """A range of the hash order: its depth in bits, index at that depth, sums."""

    depth: int
    index: int
    total: int
    groups: int
    largest: int

    @property
    def start(self) -> int:
        return self.index << (64 - self.depth)


def _starts(spans: list[Span]) -> list[int]:
    out = [0]
    for s in spans:
        out.append(out[-1] + s.total)
    return out


def _strict_cut(edges: list[int], at: int, capacity: int) -> int:
    """Greedy end of a shard that begins at ``at`` and may end only between spans."""
    return edges[bisect_right(edges, at + capacity) - 1]


def _relaxed_cut(spans: list[Span], edges: list[int], at: int, capacity: int) -> int:
    """The same, when spans of several groups may be cut anywhere."""
    end = min(at + capacity, edges[-1])
    k = bisect_right(edges, end) - 1
    return edges[k] if k < len(spans) and spans[k].groups == 1 else end


def _feasible(cut, total: int, capacity: int, n_shards: int) -> bool:
    at = 0
    for _ in range(n_shards):
        end = cut(at, capacity)
        if end >= total:
            return True
        if end <= at:
            return False
        at = end
    return False


def _least(cut, low: int, total: int, n_shards: int) -> int:
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if _feasible(cut, total, mid, n_shards):
            high = mid
        else:
            low = mid + 1
    return low


def _open_spans(spans: list[Span], n_shards: int) -> tuple[int, list[int]]:
    """The least capacity for cuts between spans, and the spans that may hold a better cut."""
    edges = _starts(spans)
    total = edges[-1]
    strict = lambda at, c: _strict_cut(edges, at, c)
    relaxed = lambda at, c: _relaxed_cut(spans, edges, at, c)
    floor = max([-(-total // n_shards), *(s.largest for s in spans)])
    low = _least(relaxed, floor, total, n_shards)
    high = _least(strict, low, total, n_shards)
    if low == high:
        return high, []
    wanted, first, last = set(), 0, 0
    for _ in range(n_shards):
        first, last = strict(first, low), relaxed(last, high)
        k = max(0, bisect_right(edges, first) - 1)
        while k < len(spans) and edges[k] < last:
            if spans[k].groups > 1:
                wanted.add(k)
            k += 1
    return high, sorted(wanted)


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """Capacity and the hashes at which shards after the first begin.

    ``groups`` has one row per atomic group: ``h`` (its place) and ``bytes``.
    """

    def sums(df: DataFrame, depth: int) -> list[Span]:
        rows = (
            df.groupBy(F.shiftright("h", 64 - depth).alias("k") if depth < 64 else F.col("h").alias("k"))
            .agg(F.sum("bytes"), F.count("*"), F.max("bytes"))
            .collect()
        )
        return [Span(depth, *r) for r in rows]

    depth = FIRST_BITS
    spans = sorted(sums(groups, depth), key=lambda s: s.start)
    if not spans:
        return 0, []
    while True:
        capacity, wanted = _open_spans(spans, n_shards)
        if not wanted:
            break
        # spans that were not divided earlier never need it later: all wanted ones have the same depth
        keys = [spans[k].index for k in wanted]
        finer = min(64, depth + MORE_BITS)
        spark = groups.sparkSession
        keyed = groups.withColumn("k0", F.shiftright("h", 64 - depth))
        picked = keyed.join(F.broadcast(spark.createDataFrame([(k,) for k in keys], "k0 long")), "k0", "left_semi")
        divided = set(wanted)
        spans = sorted([s for k, s in enumerate(spans) if k not in divided] + sums(picked, finer), key=lambda s: s.start)
        depth = finer
    edges = _starts(spans)
    at, cuts = 0, []
    while (at := _strict_cut(edges, at, capacity)) < edges[-1]:
        cuts.append(spans[edges.index(at)].start)
    return capacity, cuts


def _shard_of(cuts: list[int]):
    """Shard number of a hash: how many cuts lie at or before it."""
    return sum((F.when(F.col("h") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every document: id, size, text_crc32, h, shard and slot.

    Shard sizes are as near to equal as the order of groups allows: no other cut
    of that order into ``n_shards`` runs has a smaller largest shard.  Slots
    count the rows of a shard from 0 without gaps.  They are numbered in
    ``CELLS`` independent parts dealt by a hash of the id, so a group of copies,
    however large, never meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stage(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-rows",
    )
    groups = stage(base.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    placed = base.select("*", _shard_of(cuts).alias("shard"), F.pmod(F.xxhash64("id", "h"), F.lit(CELLS)).alias("cell"))
    # n_shards * CELLS rows at most, whatever the input: safe to broadcast
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = cells.select(
        "shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before")
    )
    part = W.partitionBy("shard", "cell").orderBy("id", "h", "size")
    return (
        placed.withColumn("in_cell", F.row_number().over(part).cast("long") - 1)
        .join(F.broadcast(before), ["shard", "cell"])
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", "h", "shard", (F.col("before") + F.col("in_cell")).alias("slot")
        )
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Write whole documents as one folder per shard; returns the cuts.

    The shard is a function of the text alone once the cuts are known, so the
    texts move once, straight to their folder, in parts of about ``PART_BYTES``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = stage(
        docs.select(F.xxhash64(text).alias("h"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("b"))
        .groupBy("h")
        .agg(F.sum("b").alias("bytes")),
        "shard-groups",
    )
    _, cuts = minimax_cuts(groups, n_shards)
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (n_shards * PART_BYTES)))
    (
        docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h"))
        .select("row", "h", _shard_of(cuts).alias("shard"))
        .select("row.*", F.col("shard").alias("shard_no"))
        .repartition(n_shards * parts, "shard_no", F.pmod(F.xxhash64(id_col), F.lit(parts)))
        .write.partitionBy("shard_no")
        .parquet(path)
    )
    return cuts
