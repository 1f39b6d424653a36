"""N-gram Jaccard self-join and its connected components, through a token-group matrix.

A document is the set of its word shingles, as 64-bit hashes.  Documents with
equal sets are one class; the join works on classes.

1.  Regions.  Classes that may be similar are brought together without losing a
    pair.  ``D`` being the number of shingles in which a set can differ from a
    similar one, the hash range is cut into more than ``D`` parts; a set with more
    than ``D`` parts that hold two tokens or more agrees with every similar set on one of
    its first ``D + 1``.  A class sends a signature for each of those.  Shingles that
    very many classes share are left out at first, so that a common passage brings
    nobody together; classes with too few filled parts send further signatures, from
    more parts, then from all their shingles (see ``Rule.signatures``).
    Equal signatures give links from the first class to the others, never all
    pairs, and the connected components of these links are the regions.  A run of
    documents sends each class once and, of the classes with one signature, the
    least for all, so a signature that a third of all rows share has a row for each
    run and not for each document.
2.  Token-group matrix.  Within a region the sets are dealt to groups of similar
    ones and each group's union of tokens is a column of the matrix.  A query
    looks up its tokens' rows; a group can hold a partner only if it shares
    as many tokens with the query as a partner must, and only such groups are opened and their
    members compared exactly.
3.  Regions beyond ``CHUNK_WEIGHT`` are cut into chunks.  Chunks meet the region's
    first chunk, and what that leaves outside the region's largest part meets all
    chunks, each in a task of its own, so memory stays bounded and no link between
    parts is lost (see :func:`region_links`).
4.  The links form a forest per task; components of all forests are found by
    label propagation in tables, never on the driver.

Similarity is decided in whole numbers: ``den * shared >= num * union``.

Classes are named by two 64-bit hashes of their sets and texts by two of their
bytes, never by document ids; ids come back in at the end.

Defined results: documents without words (or null) have an empty set and link
with nothing; fewer words than a shingle has make one shingle of them all;
repeated rows each get their row; of a repeated id each text links on its own; a
row without an id links as any other and gives its component no name, so a
component of such rows alone has a null name; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.workspace import drop_stage, stage, tidy

#: Sizes from one bound to the next share one cut of the hash range.
GROWTH = 1.7
#: Common shingles: at most so many, the most frequent ones, each in at least ``COMMON_LEAST`` classes.
COMMON_MOST = 100_000
COMMON_LEAST = 20
#: A shingle is counted where a run of documents, of some ``COUNTED_TOKENS``, has it this often.
COMMON_IN_BATCH = 3
COUNTED_TOKENS = 1_000_000
#: What a chunk of a region may weigh: a token is 1, a document ``DOCUMENT_WEIGHT`` more.
CHUNK_WEIGHT = 250_000
DOCUMENT_WEIGHT = 400
#: Texts in regions are looked up by a broadcast of so many hashes at most (16 bytes each), else by shuffle.
BROADCAST_IDS = 500_000
#: A run of documents remembers so many classes that it has sent.
CLASSES_KEPT = 50_000
GROUP_SIZE = 16
BLOCK_CHARS = 1_000_000
MAX_ROUNDS = 60
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _TURN
    x = (x ^ (x >> np.uint64(27))) * _STEP
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; A-Z in lower case, words parted by ASCII space."""
    split = [t.encode().translate(_LOWER).split() for t in texts]
    words = [w for own in split for w in own]
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, names = pd.factorize(np.array(words, dtype=object))
    hashes = pd.util.hash_array(np.array([w.decode() for w in names], dtype=object), categorize=False)[codes]
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams = mix(grams + _STEP) ^ hashes[k : k + len(grams)]
    grams = mix(grams)
    out, at = [], 0
    for own in split:
        size = len(own)
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:
            h = np.array([size], np.uint64)
            for k in range(size):
                h = mix(h + _STEP) ^ hashes[at + k]
            out.append(mix(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


class Rule:
    """Similarity of at least ``num / den``, and what follows from it for sizes."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * GROWTH)))

    def similar(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)

    def least_partner(self, size: int) -> int:
        """The smallest size a partner of a set of ``size`` can have."""
        return -(-self.num * size // self.den)

    def overlap_with(self, size: int, least: np.ndarray) -> np.ndarray:
        """What a partner of at least these sizes must share with a set of ``size``."""
        least = np.maximum(least, self.least_partner(size))
        return -(-self.num * (size + least) // (self.num + self.den))

    def differing(self, a: int, b: int) -> int:
        """In how many tokens similar sets of sizes ``a`` and ``b`` can differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def level(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def levels(self, size: int) -> list[int]:
        """Levels at which a set signs: that of its own size, and those up to its largest partner's."""
        return list(range(self.level(size), self.level(self.den * size // self.num) + 1))

    def schemes(self, level: int) -> list[tuple[bool, int, int]]:
        """Ways to cut, in the order they are tried: whether common shingles count, into how many parts, least tokens of a part.

        Parts of several tokens bring sets together that share all of these, so one
        shingle by chance, or a passage in two long texts, does hardly ever.
        """
        most = self.most_differing(level)
        few, many, least = most + 3 + 3 * most // 10, 2 * most + 3, max(1, int(0.45 * self.den / max(1, self.den - self.num)))
        return [(False, few, least), (False, many, 1), (True, few, least), (True, many, 1)]

    def most_differing(self, level: int) -> int:
        """In how many tokens similar sets can differ if the larger one is of this level."""
        top = self.bounds[level + 1] - 1
        return self.differing(top, top)

    def signatures(self, tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Hashes of filled parts of a sorted set, for each of its levels.

        ``most`` is the number of tokens in which this set can differ from a similar
        one of the level.  A part is filled if it holds as many tokens as the scheme asks
        for; parts that agree are filled in both sets or in none.  A set stops at the
        first scheme in which more than ``most`` parts are filled, and of any scheme sends
        the first ``most + 1`` filled parts.
        Take two similar sets and the scheme at which the first of them stops.  It has
        a filled part on which they agree; before the first such part each has only
        parts on which they differ, ``most`` at the utmost, so both send it.  If neither
        stops, both send the empty parts of the last scheme as well, of which there
        are more than can differ.
        """
        if not len(tokens):
            return np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
        rare = tokens[common[at] != tokens] if len(common) else tokens
        sums: dict[bool, np.ndarray] = {}
        out = []
        size = len(tokens)
        for level in self.levels(size):
            most = self.differing(size, min(self.bounds[level + 1] - 1, self.den * size // self.num))
            for number, (whole, n, least) in enumerate(self.schemes(level)):
                own = tokens if whole else rare
                if whole not in sums:
                    sums[whole] = self._sums(own)
                edges = np.arange(1, n, dtype=np.uint64) * np.uint64((1 << 64) // n)
                cuts = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
                parts = sums[whole][cuts[1:]] - sums[whole][cuts[:-1]]
                filled = np.flatnonzero(cuts[1:] - cuts[:-1] >= least)
                sent = filled[: most + 1] if len(filled) > most or number < 3 else np.arange(n)
                out.append(mix(mix(parts[sent]) + sent.astype(np.uint64) * _STEP + np.uint64(8 * level + number + 1)))
                if len(filled) > most:
                    break
        return np.concatenate(out)

    @staticmethod
    def _sums(tokens: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + _STEP), dtype=np.uint64)])


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    a = np.sum(mix(tokens), dtype=np.uint64) if len(tokens) else np.uint64(0)
    b = np.sum(mix(tokens ^ _TURN) * _STEP, dtype=np.uint64) if len(tokens) else np.uint64(0)
    return int(np.int64(np.uint64(a).view(np.int64))), int(np.uint64(b).view(np.int64))


def text_keys(text_col: str) -> list:
    """A text (null: empty) and two independent 64-bit hashes of it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def key_documents(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """For each document id, size, the set's keys k1 and k2 and the text's t1 and t2; besides, rows (shingle, n) for common shingles.

    A run of documents counts the shingles of its classes, copies once, and passes
    on those that it has several times.
    """

    def counted(seen: dict) -> pd.DataFrame:
        found, counts = np.unique(np.concatenate([*seen.values(), np.zeros(0, np.uint64)]), return_counts=True)
        often = counts >= COMMON_IN_BATCH
        none = dict.fromkeys(["id", "size", "k1", "k2", "t1", "t2"])
        return pd.DataFrame({**none, "shingle": found[often].view(np.int64), "n": counts[often].astype(np.int64)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts, BLOCK_CHARS):
                sets = shingle_sets(texts[part], n)
                keys = [set_key(s) for s in sets]
                seen |= dict(zip(keys, sets, strict=True))
                given = {c: frame[c].iloc[part].to_numpy() for c in ("id", "t1", "t2")}
                yield pd.DataFrame({**given, "size": [len(s) for s in sets], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "shingle": None, "n": None})
                if sum(map(len, seen.values())) > COUNTED_TOKENS:
                    yield counted(seen)
                    seen = {}
        if seen:
            yield counted(seen)

    own = docs.select(F.col(id_col).alias("id"), *text_keys(text_col))
    return own.mapInPandas(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, size long, k1 long, k2 long, t1 long, t2 long, shingle long, n long")


def common_shingles(keyed: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that the most classes share, ``COMMON_MOST`` at most.

    Which shingles these are decides how much work there is, and never the result.
    """
    sums = keyed.where("n is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    rows = sums.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def signature_rows(docs: DataFrame, rule: Rule, n: int, common: np.ndarray, text_col: str) -> DataFrame:
    """Rows (sig, k1), with what one batch can settle already settled."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[tuple[int, int]] = set()
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts, BLOCK_CHARS):
                own = {k: s for s in shingle_sets(texts[part], n) if len(s) and (k := set_key(s)) not in sent}
                if len(sent) < CLASSES_KEPT:
                    sent.update(own)
                if own:
                    yield pre_link([k1 for k1, _ in own], [rule.signatures(s, shared.value).view(np.int64) for s in own.values()])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(tidy(run), "sig long, k1 long")


def pre_link(classes: list[int], signatures: list[np.ndarray]) -> pd.DataFrame:
    """Of the classes of a block with the same signature only the least keeps it.

    The others get a signature shared with that least one alone.  Rows of a
    class stay together, which packs well.
    """
    sig = np.concatenate(signatures)
    own = np.repeat(np.array(classes, np.int64), [len(x) for x in signatures])
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    new = np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]])
    least = own[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
    links = pd.DataFrame({"a": least[~new], "b": own[~new]}).drop_duplicates()
    links = links[links["a"] != links["b"]]
    a, b = links["a"].to_numpy().view(np.uint64), links["b"].to_numpy().view(np.uint64)
    joint = mix(mix(a + _STEP) ^ b).view(np.int64)
    out = pd.DataFrame({"sig": np.concatenate([sig[new], joint, joint]), "k1": np.concatenate([own[new], links["a"], links["b"]])})
    return out.sort_values("k1", kind="stable")


def _run_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by signature: links from the first class of each to the others."""
    last_sig = last_first = None
    for frame in frames:
        sig, own = frame["sig"].to_numpy(), frame["k1"].to_numpy()
        if not len(sig):
            continue
        new = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
        first = np.where(new, own, 0)
        at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        first = np.where(at >= 0, own[np.maximum(at, 0)], last_first if last_first is not None else 0)
        keep = ~new & (first != own)
        last_sig, last_first = sig[-1], first[-1]
        yield pd.DataFrame({"a": first[keep], "b": own[keep]}).drop_duplicates()


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component), for links a-b.

    Alternates moving larger and smaller neighbours to the least one, so the
    number of rounds grows with the logarithm of a component's extent.  Each
    round is written to the shared folder.
    """
    edges = stage(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        # large star: every node's larger neighbours go to the least of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node and its smaller neighbours go to the least of these
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        after = stage(small, "links")
        # a star's leaves occur once; nothing is left to move when every node has one least neighbour and centres have none
        unsettled = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        drop_stage(edges)
        edges = after
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def matrix_links(sets: list[np.ndarray], rule: Rule, side: np.ndarray | None = None, inner: bool = True, settled: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs, found through a token-group matrix.

    Sets of side 0 are looked up among those of side 1 and, if ``inner``, among
    themselves; sets of side 1 are not compared with each other.  Sets with equal
    ``settled`` values are known to be connected.
    """
    if len(sets) < 2:
        return []
    side = np.zeros(len(sets), np.int64) if side is None else side
    tokens, codes = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    own = [codes[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    sizes = np.diff(edges)
    # similar sets share their least hashes, so sorting by side, size and those puts them side by side
    order = sorted(range(len(sets)), key=lambda k: (side[k], rule.level(int(sizes[k])), int(own[k][0])))
    groups = [order[k : k + GROUP_SIZE] for k in range(0, len(order), GROUP_SIZE)]
    groups = [g for part in groups for g in ([x for x in part if side[x] == 0], [x for x in part if side[x] == 1]) if g]
    matrix = np.zeros((len(tokens), len(groups)), bool)
    for g, members in enumerate(groups):
        for k in members:
            matrix[own[k], g] = True
    low = np.array([min(int(sizes[k]) for k in g) for g in groups])
    high = np.array([max(int(sizes[k]) for k in g) for g in groups])
    open_to = np.array([side[g[0]] == 1 or inner for g in groups])
    forest, links = Forest(len(sets)), []
    first: dict = {}
    for k, label in enumerate(settled or ()):
        forest.link(first.setdefault(label, k), k)
    present = np.zeros(len(tokens), bool)
    for q in np.flatnonzero(side == 0):
        size = int(sizes[q])
        bound = matrix[own[q]].sum(axis=0)
        # the partner's size bounds what must be shared from below: at least what the smallest fitting member asks for
        fits = open_to & (high >= rule.least_partner(size)) & (rule.num * low <= rule.den * size) & (bound >= rule.overlap_with(size, low))
        present[own[q]] = True
        for g in np.flatnonzero(fits):
            for k in groups[g]:
                if (side[k] == 0 and k <= q) or forest.find(k) == forest.find(q):
                    continue
                other = int(sizes[k])
                if rule.num * max(size, other) > rule.den * min(size, other):
                    continue
                if rule.similar(int(np.count_nonzero(present[own[k]])), size, other) and forest.link(q, k):
                    links.append((q, k))
        present[own[q]] = False
    return links


def pair(first: str, second: str, name: str) -> Column:
    """A class as one value."""
    return F.struct(F.col(first).alias("k1"), F.col(second).alias("k2")).alias(name)


def chunk_number(weight: Column) -> Column:
    """Into how many chunks a region of a weight is cut."""
    return F.ceil(weight / CHUNK_WEIGHT).cast("int")


def region_links(members: DataFrame, texts: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Links (a, b) between classes of a region that connect all that similar pairs connect.

    Small regions are one task.  Larger ones are taken apart by size: similar sets lie
    in one of two neighbouring bands, so a class goes to the region of its own band
    and the next and to that of its own and the one before.  Of what is still larger
    every chunk is compared in itself and with the first chunk.  That connects a
    group of copies but for a few classes, and what is outside the largest part then
    meets all other chunks.  So a text is sent some five times however many copies a
    region holds; only a region of different texts costs the square of its chunks.
    """
    total = lambda rows: rows.groupBy("region").agg(chunk_number(F.sum(F.col("size") + DOCUMENT_WEIGHT)).alias("chunks"))
    band = F.floor(F.log(F.col("size")) / (log(rule.den / rule.num) * (1 + 1e-9))).cast("int")
    bands = F.when(F.col("chunks") > 1, F.array(band - 1, band)).otherwise(F.array(F.lit(-9)))
    if rule.num < rule.den:
        apart = members.join(total(members), "region").select("k1", "k2", "t1", "t2", "size", "region", F.explode(bands).alias("band"))
        members = apart.withColumn("region", F.struct("region", "band")).drop("band")
    chunked = members.join(total(members), "region").withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))
    chunked = stage(chunked, "jaccard-chunks")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "k1", "k2"]).reset_index(drop=True)
        own = [s for part in blocks(frame["text"].tolist(), BLOCK_CHARS) for s in shingle_sets(frame["text"].iloc[part].tolist(), n)]
        labels = list(zip(frame["s1"], frame["s2"], strict=True))
        links = matrix_links(own, rule, frame["side"].to_numpy(np.int64), bool(frame["inner"].iloc[0]), labels)
        a, b = [x for x, _ in links], [y for _, y in links]
        k1, k2 = frame["k1"].to_numpy(), frame["k2"].to_numpy()
        return pd.DataFrame({"a1": k1[a], "a2": k2[a], "b1": k1[b], "b2": k2[b]})

    def solved(tasks: DataFrame) -> DataFrame:
        links = tasks.join(texts, ["t1", "t2"]).drop("t1", "t2").groupBy("region", "c", "d").applyInPandas(solve, "a1 long, a2 long, b1 long, b2 long")
        return stage(links.select(pair("a1", "a2", "a"), pair("b1", "b2", "b")), "jaccard-found")

    keys = ["k1", "k2", "t1", "t2", "region"]
    # side 0 is compared in itself, and with side 1: the first chunk, beside every other one
    homes = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    around = chunked.select(*keys, "chunk", F.explode(homes).alias("c"))
    around = around.select(*keys, F.col("k1").alias("s1"), F.col("k2").alias("s2"), "c", F.lit(0).alias("d"), (F.col("chunk") != F.col("c")).cast("int").alias("side"), F.lit(True).alias("inner"))
    found = solved(around)
    large = chunked.where("chunks > 1")
    if large.isEmpty():
        return found
    # the parts of large regions so far, and what is outside the largest of them
    parts = components(found.join(large.select(pair("k1", "k2", "a")), "a", "left_semi"))
    named = large.join(parts.select("node.k1", "node.k2", "label"), ["k1", "k2"], "left").withColumn("part", F.coalesce("label", pair("k1", "k2", "own"))).drop("label")
    sizes = named.groupBy("region", "part").agg(F.count("*").alias("n"), F.sum(F.col("size") + DOCUMENT_WEIGHT).alias("weight"))
    heads = sizes.groupBy("region").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("weight").alias("all"), F.max_by("weight", F.struct("n", "part")).alias("weight"))
    heads = heads.where(F.col("all") > F.col("weight")).select("region", F.col("most.part").alias("head"), chunk_number(F.col("all") - F.col("weight")).alias("rests"))
    # every class of a region with a rest; ``rest``: the number of its chunk of the rest, null in the largest part
    left = stage(
        named.join(heads, "region").withColumn("rest", F.when(F.col("part") != F.col("head"), F.pmod(F.xxhash64("k2", "k1"), F.col("rests")).cast("int"))).drop("head"), "jaccard-rest"
    )
    outside = left.where("rest is not null").select(*keys, "part", F.col("rest").alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"), F.lit(0).alias("side"))
    inside = left.select(*keys, "part", "rest", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("c"), F.col("chunk").alias("d"))
    inside = inside.where("rest is null or rest > c").select(*keys, "part", "c", "d", F.lit(1).alias("side"))
    across = outside.unionByName(inside).select(*keys, F.col("part.k1").alias("s1"), F.col("part.k2").alias("s2"), "c", "d", "side", (F.col("d") == 0).alias("inner"))
    return found.unionByName(solved(across))


def link_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (least id reachable by links) for each row."""
    rule = Rule(num, den)
    keyed = stage(key_documents(docs, n, id_col, text_col), "jaccard-keys")
    signed = keyed.where("n is null")
    filled = signed.where("size > 0")
    classes = stage(filled.groupBy("k1", "k2", "size").agg(F.min(F.struct("t1", "t2")).alias("rep"), F.min("id").alias("first_id")), "jaccard-classes")

    rows = signature_rows(docs, rule, n, common_shingles(keyed), text_col)
    near = rows.repartition("sig").sortWithinPartitions("sig", "k1").mapInPandas(tidy(_run_links), "a long, b long").distinct()
    regions = components(near).withColumnRenamed("node", "k1").withColumnRenamed("label", "region")

    members = stage(classes.join(regions, "k1").select("k1", "k2", "rep.t1", "rep.t2", "size", "region"), "jaccard-members")
    drop_stage(regions)
    wanted = members.select("t1", "t2")
    few = wanted.count() <= BROADCAST_IDS
    texts = (
        docs.select(*text_keys(text_col))
        .join(F.broadcast(wanted) if few else wanted, ["t1", "t2"], "left_semi")
        .groupBy("t1", "t2").agg(F.first("text").alias("text"))
    )

    labels = components(region_links(members, texts, rule, n))
    drop_stage(members)
    linked = classes.join(labels.select("node.k1", "node.k2", "label"), ["k1", "k2"])
    names = linked.groupBy("label").agg(F.min("first_id").alias("component"))
    named = classes.select("k1", "k2", "first_id").join(linked.join(names, "label").select("k1", "k2", "component"), ["k1", "k2"], "left")
    # a class with very many copies has many rows on one side here and one on the other, which adaptive joins split
    return (
        signed.select("id", "size", "k1", "k2")
        .join(named.select("k1", "k2", F.coalesce("component", "first_id").alias("component")), ["k1", "k2"], "left")
        .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
