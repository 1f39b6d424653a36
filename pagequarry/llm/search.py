"""Ranked lexical search by Block-Max MaxScore over an inverted index in segments.

Terms are the maximal runs of ASCII letters and digits and of all characters
beyond ASCII, with only A to Z lower-cased.  ``N`` documents have a term, ``L`` is the
number of all terms, ``n`` that of one document, ``df`` the number of documents with a
term and ``tf`` its occurrences in a document.  With ``w = floor(1000 * ln((2N + 2) /
(2df + 1)))`` and ``m = 10 + (90 * n * N) div L`` a document's score is the sum over an
item's distinct terms of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``.

Index.  One pass over all whole texts writes each document's length and terms; counts
over that table give ``N``, ``L`` and ``df``.  A task then cuts its documents into segments
of at most ``SEGMENT_POSTINGS``, with an inverted list for each term: blocks of
``BLOCK`` postings, compressed one by one, each with its first and last document and
its largest second factor (a posting's *part*), and the largest part of the list.  No
text and no posting is shuffled.  Where the items' terms are at most ``MAX_TERMS``, lists
of other terms are not written; lengths and counts are over all terms in any case.

Search.  Items are taken in blocks of about ``ITEM_BLOCK`` against all segments.  For an
item in a segment, terms are ordered by their bound, weight times the list's largest
part.  Terms whose bounds together stay below the tenth best score so far are not
essential: a document with none but them cannot enter.  The essential lists are
decoded and added up, a stretch of documents at a time.  A candidate goes on if its
score and the bounds of the other lists might reach the tenth best; then lists are
taken by falling bound, and of each the blocks' largest parts decide first: a block
is decompressed only if a candidate in it can still reach.  A task keeps one heap for
each item over all its segments; the heaps are merged by a window over at most ten
rows an item and task.  Whatever equals the tenth best is kept until ids decide, so
ties are exact.

Defined results: null texts, and texts without a term, have none and no rank; null
ids come after all others among equal scores; repeated rows are documents of their
own and take ranks of their own; rows of items with one id are one item with all
their terms; an item without a term, or whose terms no document has, gives no row;
empty tables give an empty result; other columns are not read, whatever their names.
Ids are whole numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.workspace import stage

TOP = 10
BLOCK = 128
#: Documents and postings of a segment; a document with more postings is one of its own.
SEGMENT_DOCS, SEGMENT_POSTINGS = 32_768, 2_000_000
#: Documents whose scores are added up at a time.
STRETCH = 8_192
#: Up to so many terms are sent to tasks (some 100 bytes each), else every term is indexed.
MAX_TERMS = 200_000
ITEM_BLOCK = 500
_NO_ID = (1 << 63) - 1
_INT = 1 << 63

#: Every byte that is no part of a term becomes a blank, A to Z become small.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Bytes of a text that are taken apart at a time.
_PIECE = 4 << 20

_LIST = "struct<term:binary,top:bigint,firsts:array<int>,lasts:array<int>,tops:array<bigint>,payloads:array<binary>>"
SEGMENT = f"ids binary, ms binary, lists array<{_LIST}>"


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """A whole text's terms in order, as lists for stretches of it."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            # never inside a term
            cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        yield raw[at:end].split()
        at = end


def forward_table(docs: DataFrame, wanted: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """id, n, terms and tfs of every document; of other terms than the wanted ones only the number."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column(1):
                n, own = 0, Counter()
                for part in terms_of(text.as_py()):
                    n += len(part)
                    own.update(part if keep is None else filter(keep.__contains__, part))
                ns.append(n)
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"]
            )

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {id_type}, n long, terms array<binary>, tfs array<long>")


def parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The factor of a posting that its term's weight is multiplied with."""
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def lengths_to_m(n: np.ndarray, total: int, mean_of: int) -> np.ndarray:
    """m of documents with ``n`` terms, of ``total`` documents with ``mean_of`` terms together."""
    if len(n) and int(n.max()) * 90 * total >= _INT:
        n = n.astype(object)
    return (10 + 90 * n * total // mean_of).astype(np.int64)


def pack_block(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Number of postings, then places of documents as differences and their counts, in as few bytes each as hold them."""
    gaps = np.diff(docs, prepend=docs[0])
    width = lambda values: next(k for k in (1, 2, 4, 8) if int(values.max()) < 1 << 8 * k)
    a, b = width(gaps), width(tf)
    return zlib.compress(bytes([len(docs), a, b]) + gaps.astype(f"<u{a}").tobytes() + tf.astype(f"<u{b}").tobytes(), 1)


def open_block(payload: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a block whose first place is known."""
    raw = zlib.decompress(payload)
    count, a, b = raw[:3]
    gaps, tf = np.frombuffer(raw, f"<u{a}", count, 3), np.frombuffer(raw, f"<u{b}", count, 3 + a * count)
    return first + np.cumsum(gaps.astype(np.int64)), tf.astype(np.int64)


def segment_of(ids: np.ndarray, n: np.ndarray, terms: pa.Array, owner: np.ndarray, tf: np.ndarray, total: int, all_terms: int) -> dict:
    """A segment of some documents; ``owner`` is the document of each posting."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    m = lengths_to_m(n[order], total, all_terms)
    coded = terms.dictionary_encode()
    term, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), place[owner]
    by = np.lexsort((doc, term))
    term, doc, tf = term[by], doc[by], tf[by]
    score = parts(tf, m[doc])
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-2))
    words, lists = coded.dictionary.to_pylist(), []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        starts = range(a, b, BLOCK)
        lists.append({
            "term": words[term[a]], "top": int(score[a:b].max()), "firsts": [int(doc[k]) for k in starts], "lasts": [int(doc[min(k + BLOCK, b) - 1]) for k in starts],
            "tops": [int(score[k : min(k + BLOCK, b)].max()) for k in starts], "payloads": [pack_block(doc[k : min(k + BLOCK, b)], tf[k : min(k + BLOCK, b)]) for k in starts],
        })
    return {"ids": ids[order].astype("<i8").tobytes(), "ms": m.astype("<i8").tobytes(), "lists": lists}


def segments(forward: DataFrame, total: int, all_terms: int) -> DataFrame:
    """The inverted index of a forward table, a row for each segment."""
    kind = pa.list_(pa.struct([("term", pa.binary()), ("top", pa.int64()), ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64())), ("payloads", pa.list_(pa.binary()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: table.column(name).chunk(0)
            sizes = pc.list_value_length(column("terms")).to_numpy()
            own = segment_of(
                column("id").fill_null(_NO_ID).to_numpy(), column("n").to_numpy(), column("terms").flatten(), np.repeat(np.arange(len(sizes)), sizes),
                column("tfs").flatten().to_numpy(), total, all_terms,
            )
            return pa.RecordBatch.from_arrays([pa.array([own["ids"]], pa.binary()), pa.array([own["ms"]], pa.binary()), pa.array([own["lists"]], kind)], names=["ids", "ms", "lists"])

        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_pylist()
            start = 0
            for k, size in enumerate(sizes):
                if docs and (docs >= SEGMENT_DOCS or postings + size > SEGMENT_POSTINGS):
                    held.append(batch.slice(start, k - start))
                    yield packed()
                    held, docs, postings, start = [], 0, 0, k
                docs, postings = docs + 1, postings + size
            held.append(batch.slice(start))
        if docs:
            yield packed()

    return forward.where("n > 0").mapInArrow(run, SEGMENT)


@dataclass
class Postings:
    """One term's list in a segment; blocks are decompressed when they are asked for, once."""

    top: int
    firsts: np.ndarray
    lasts: np.ndarray
    tops: np.ndarray
    payloads: list[bytes]
    opened: dict[int, tuple[np.ndarray, np.ndarray]]

    def block(self, k: int, ms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and parts of a block's postings."""
        if k not in self.opened:
            docs, tf = open_block(self.payloads[k], int(self.firsts[k]))
            self.opened[k] = docs, parts(tf, ms[docs])
        return self.opened[k]

    def between(self, a: int, b: int) -> range:
        """Blocks that hold places from a up to b."""
        return range(int(np.searchsorted(self.lasts, a)), int(np.searchsorted(self.firsts, b)))


@dataclass
class Heap:
    """The best documents of an item so far: scores and ids."""

    k: int
    scores: np.ndarray
    ids: np.ndarray

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def search_segment(lists: list[tuple[int, Postings]], ids: np.ndarray, ms: np.ndarray, heap: Heap) -> None:
    """Offer a segment's documents to an item's heap; ``lists``: weights and lists of the item's terms."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    bounds = [w * own.top for w, own in lists]
    upto = np.cumsum(bounds).tolist()
    for a in range(0, len(ids), STRETCH):
        b, least = min(a + STRETCH, len(ids)), heap.least
        if not lists or upto[-1] < least:
            return
        essential = next(k for k, s in enumerate(upto) if s >= least)
        sums = np.zeros(b - a, dtype=np.int64)
        for w, own in lists[essential:]:
            for k in own.between(a, b):
                docs, part = own.block(k, ms)
                inside = slice(*np.searchsorted(docs, [a, b]))
                sums[docs[inside] - a] += w * part[inside]
        found = np.flatnonzero(sums)
        for j in range(essential - 1, -1, -1):
            # what this list and those below it may still add
            found = found[sums[found] + upto[j] >= least]
            below = upto[j - 1] if j else 0
            w, own = lists[j]
            for k in own.between(a, b) if len(found) else ():
                first, last = np.searchsorted(found, [own.firsts[k] - a, own.lasts[k] - a + 1])
                near = found[first:last]
                if not len(near) or int(sums[near].max()) + w * int(own.tops[k]) + below < least:
                    continue
                docs, part = own.block(k, ms)
                at = np.searchsorted(docs, near + a)
                hit = docs[np.minimum(at, len(docs) - 1)] == near + a
                sums[near[hit]] += w * part[at[hit]]
        found = found[sums[found] >= least]
        if len(found):
            heap.offer(sums[found], ids[a:b][found])


def weight(total: int, df: int) -> int:
    return floor(1000 * log((2 * total + 2) / (2 * df + 1)))


def search(index: DataFrame, items: dict[int, dict[bytes, int]], top: int = TOP) -> DataFrame:
    """number, rank, id and score of each item's best documents; ``items``: weights of terms by number."""
    shared = index.sparkSession.sparkContext.broadcast({n: {t: w for t, w in own.items() if w > 0} for n, own in items.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        heaps = {n: Heap(top, np.empty(0, np.int64), np.empty(0, np.int64)) for n in asked}
        wanted = pa.array(sorted({t for own in asked.values() for t in own}), pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                ids, ms = (np.frombuffer(batch.column(k)[row].as_py(), "<i8") for k in (0, 1))
                held = batch.column(2)[row].values
                held = held.filter(pc.is_in(held.field("term"), value_set=wanted))
                own = {x["term"]: Postings(x["top"], *(np.array(x[c], dtype=np.int64) for c in ("firsts", "lasts", "tops")), x["payloads"], {}) for x in held.to_pylist()}
                for number, weights in asked.items():
                    search_segment([(w, own[t]) for t, w in weights.items() if t in own], ids, ms, heaps[number])
        rows = [(n, int(i), int(s)) for n, h in heaps.items() for i, s in zip(h.ids, h.scores, strict=True)]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "id", "score"])

    best = W.partitionBy("number").orderBy(F.desc("score"), "id")
    found = index.mapInArrow(run, "number long, id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return found.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def top_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP
) -> DataFrame:
    """A row for each item and rank: item, rank, document and score."""
    asked = forward_table(items, None, item_col, item_text_col)
    asked = asked.select(F.col("id").alias("item"), F.explode("terms").alias("term")).groupBy("item").agg(F.collect_set("term").alias("terms"))
    asked = stage(asked.withColumn("number", F.monotonically_increasing_id()), "search-items")
    words = asked.select(F.explode("terms").alias("term")).distinct()
    few = words.count() <= MAX_TERMS
    wanted = frozenset(bytes(r["term"]) for r in words.collect()) if few else None
    forward = stage(forward_table(docs.withColumn(id_col, F.col(id_col).cast("long")), wanted, id_col, text_col), "search-forward")
    total, all_terms = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found_in = stage(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "search-df")
    index = stage(segments(forward, total, all_terms), "search-index")
    blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    out = None
    for k in range(blocks):
        # items are the stated query set and go by blocks
        block = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k)
        df = {bytes(r["term"]): r["df"] for r in found_in.join(F.broadcast(block.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi").collect()}
        numbers = {r["number"]: {bytes(t): weight(total, df[bytes(t)]) for t in r["terms"] if bytes(t) in df} for r in block.select("number", "terms").collect()}
        found = search(index, numbers, top).join(F.broadcast(block.select("number", "item")), "number")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
