"""Byte-level BPE: token counts, and encoding of long texts by tree concatenation.

The vocabulary is a tokenizer file whose path is a parameter; nothing is trained.
Texts go through a fast encoder made from the same vocabulary.  Texts that hold a
code point on which the libraries' Unicode tables differ (all unassigned until
lately) go through the file's own library, so results equal that library's.

Counting.  One pass over the corpus finds its distinct pre-tokens and how often
each occurs; pieces are counted once for each of them and written as a table.  A
second pass joins each document's pre-token frequencies to that table and sums,
without keeping ids: the commonest pre-tokens (``COMMON_MOST`` of at most
``COMMON_BYTES`` bytes each, so the broadcast is bounded) by a broadcast, the
remainder by a shuffle on the pre-token.  A remaining pre-token occurs less often
than a common one of its length, or is long, so none of the shuffle's keys is hot
but for a long text that very many documents repeat, which adaptive joins split.

Encoding.  A text longer than ``leaf_chars`` is halved until all parts are
shorter.  The parts of a block of documents are encoded in parallel threads.  Two
neighbours are joined by encoding a window around their border anew, and growing
it until it agrees with both sides: its first word with the left side, and the
words after some common word start, over more bytes than a special token has,
with the right side.  From a word start the splitter looks at nothing before it,
so both sides then hold for the joined text; at worst the window grows to the
whole.

Defined results: a null text is the empty text (0 tokens, the digest of nothing);
repeated rows repeat their result; an empty table gives an empty result; only the
id and the text column are read, so clashing names elsewhere do no harm.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.workspace import stage, tidy

TOKENIZER = "byte_bpe_50k.json"
LEAF_CHARS = 16_384
WINDOW = 64
BLOCK_CHARS = 4_000_000
#: A task passes its distinct pre-tokens on when it holds so many, or has read so many characters.
PIECES_HELD = 400_000
PIECE_CHARS = 64_000_000
#: Pre-tokens that are broadcast: at most so many, the commonest ones, of at most so many bytes each.
COMMON_MOST = 200_000
COMMON_BYTES = 48
#: Code points that Unicode tables of different ages class differently (fixed values), and rare planes as a whole.
UNSETTLED = re.compile(
    "[՘֋֌࢏౜೜₏₝-₟Ɤ-꟱꭬꭭\U00010780-\U0001efff\U0001fb00-\U0010ffff]"
)

_LOADED: dict[str, Bpe] = {}


def tokenizer_path(name: str) -> str:
    """A file's place: itself, or of that name among the public tokenizers."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bpe:
    """One vocabulary in both libraries."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        symbols = byte_symbols()
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): k for t, k in given["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.guard = max([16, *(2 * len(s.encode()) for s in special)])
        self.bytes_of = {k: t for t, k in ranks.items()} | {k: s.encode() for s, k in special.items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for k, t in self.bytes_of.items():
            self.lengths[k] = len(t)

    @property
    def slow(self):
        """The file's own library, loaded for the first text that needs it."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        if self.special is None:
            return [text], 0
        found = self.special.split(text)
        return found, len(found) - 1

    def ids(self, text: str) -> np.ndarray:
        if len(text) > 8 * LEAF_CHARS or UNSETTLED.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), np.uint32)

    def pieces(self, pre_token: str) -> int:
        """Tokens of one pre-token, which no splitter looks at again."""
        return len(self.fast._encode_single_piece(pre_token)) if pre_token else 0

    def word_starts(self, text: str) -> np.ndarray:
        """Byte places at which pre-tokens and special tokens start."""
        starts, at, cuts = [], 0, [(m.start(), m.end()) for m in self.special.finditer(text)] if self.special else []
        for a, b in [*cuts, (len(text), len(text))]:
            piece = text[at:a]
            if UNSETTLED.search(piece):
                starts += [at + o[0] for _, o in self.slow.pre_tokenizer.pre_tokenize_str(piece)]
            else:
                starts += [at + m.start() for m in self.words.finditer(piece)]
            if b > a:
                starts.append(a)
            at = b
        places = np.array(starts, np.int64)
        if text.isascii():
            return places
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return np.concatenate([[0], np.cumsum(width)])[places]


def load(name: str) -> Bpe:
    path = tokenizer_path(name)
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[slice]:
    """Runs of texts with about ``most`` characters; a longer text is a run of its own."""
    first, chars = 0, 0
    for k, t in enumerate(texts):
        if k > first and chars + len(t) > most:
            yield slice(first, k)
            first, chars = k, 0
        chars += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


# --- counting ---------------------------------------------------------------


def pre_tokens(bpe: Bpe, text: str, onto: Counter | None = None) -> tuple[Counter, int]:
    """How often each pre-token occurs in a text (on top of ``onto``), and the number of special tokens."""
    parts, specials = bpe.parts(text)
    own = Counter() if onto is None else onto
    for part in parts:
        if UNSETTLED.search(part):
            own.update(part[a:b] for _, (a, b) in bpe.slow.pre_tokenizer.pre_tokenize_str(part))
        else:
            own.update(bpe.words.findall(part))
    own.pop("", None)
    return own, specials


def distinct_pre_tokens(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    """Each pre-token of the corpus, how often it occurs, and its pieces, counted once."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, held, chars = load(tokenizer), Counter(), 0
        table = lambda: pd.DataFrame({"piece": list(held), "n": list(held.values())})
        for frame in frames:
            for text in frame["text"]:
                pre_tokens(bpe, text, held)
                chars += len(text)
                if len(held) > PIECES_HELD or chars > PIECE_CHARS:
                    yield table()
                    held, chars = Counter(), 0
        if held:
            yield table()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer)
        for frame in frames:
            own = frame["piece"].tolist()
            yield pd.DataFrame({"piece": own, "n": frame["n"].to_numpy(), "pieces": [bpe.pieces(t) for t in own]})

    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    found = texts.mapInPandas(tidy(find), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return found.mapInPandas(tidy(count), "piece string, n long, pieces long")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """id, n_bytes and n_tokens of each whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    table = stage(distinct_pre_tokens(docs, text_col, tokenizer), "bpe-pre-tokens")
    short = table.where(F.octet_length("piece") <= COMMON_BYTES)
    common = short.orderBy(F.desc("n"), "piece").limit(COMMON_MOST).select("piece", "pieces").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(common["piece"], common["pieces"].tolist(), strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, known = load(tokenizer), shared.value
        for frame in frames:
            sums, rests, times = [], [], []
            for text in frame["text"]:
                own, total = pre_tokens(bpe, text)
                rest = []
                for piece, n in own.items():
                    if (pieces := known.get(piece)) is None:
                        rest.append((piece, n))
                    else:
                        total += n * pieces
                sums.append(total)
                rests.append([t for t, _ in rest])
                times.append([n for _, n in rest])
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "n_bytes": frame["n_bytes"].to_numpy(), "known": sums, "piece": rests, "n": times})

    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = own.mapInPandas(tidy(run), f"id {id_type}, n_bytes long, known long, piece array<string>, n array<long>")
    if len(common) < COMMON_MOST and short.count() == table.count():
        return counted.select(F.col("id").alias(id_col), "n_bytes", F.col("known").alias("n_tokens"))
    # rows get a number that stays the same once they are written
    held = stage(counted.withColumn("row", F.monotonically_increasing_id()), "bpe-counted")
    rest = held.where(F.size("piece") > 0).select("row", F.explode(F.arrays_zip("piece", "n")).alias("r")).select("row", "r.piece", "r.n")
    sums = rest.join(table.select("piece", "pieces"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    return held.join(sums, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


# --- encoding ---------------------------------------------------------------


class Node:
    """A stretch of a text, its exact ids, and where its tokens and words start (in its bytes)."""

    __slots__ = ("raw", "ids", "starts", "words")

    def __init__(self, raw: bytes, ids: np.ndarray, starts: np.ndarray, words: np.ndarray):
        self.raw, self.ids, self.starts, self.words = raw, ids, starts, words


def leaf(bpe: Bpe, text: str) -> Node:
    ids = bpe.ids(text)
    ends = np.cumsum(bpe.lengths[ids])
    return Node(text.encode(), ids, ends - bpe.lengths[ids], bpe.word_starts(text))


def halves(text: str, most: int) -> list[str]:
    """The text halved until no part has more than ``most`` characters; a power of two of parts."""
    parts = [text]
    while len(parts[0]) > most:
        parts = [h for p in parts for h in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return parts


def _between(node: Node, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their starts and word starts of a node between two token starts, counted from the first."""
    a, b = np.searchsorted(node.starts, [first, last])
    c, d = np.searchsorted(node.words, [first, last])
    return node.ids[a:b], node.starts[a:b] - first, node.words[c:d] - first


def _same(x: tuple, y: tuple) -> bool:
    return all(np.array_equal(a, b) for a, b in zip(x, y, strict=True))


def join(bpe: Bpe, left: Node, right: Node, window: int = WINDOW) -> Node:
    """The exact encoding of two neighbours' joined text."""
    border, total = len(left.raw), len(left.raw) + len(right.raw)
    raw = left.raw + right.raw
    while True:
        # a word of the left side that starts a window's length before the border, and one of the right that starts as far behind it
        k = int(np.searchsorted(left.words, border - window, "right")) - 1
        begin = int(left.words[k]) if k >= 0 else 0
        k = int(np.searchsorted(right.words, window))
        end = border + int(right.words[k]) if k < len(right.words) else total
        middle = leaf(bpe, raw[begin:end].decode())
        keep = None
        left_ok = begin == 0
        if not left_ok and len(middle.words) > 1:
            # its first word must end, in both, before the border and leave room for a special token
            word_end = begin + int(middle.words[1])
            k = int(np.searchsorted(left.words, begin, "right"))
            left_ok = (
                k < len(left.words)
                and int(left.words[k]) == word_end
                and border - word_end >= bpe.guard
                and _same(_between(left, begin, word_end), _between(middle, 0, word_end - begin))
            )
        if left_ok and end < total:
            shared = np.intersect1d(middle.words + begin, right.words + border)
            shared = shared[(shared >= border) & (shared <= end - bpe.guard)]
            if len(shared):
                p = int(shared[-1])
                if _same(_between(right, p - border, end - border), _between(middle, p - begin, end - begin)):
                    keep = p
        elif left_ok:
            keep = total
        if keep is not None:
            head, tail = _between(left, 0, begin), _between(right, keep - border, len(right.raw) + 1)
            mid = _between(middle, 0, keep - begin) if keep < total else (middle.ids, middle.starts, middle.words)
            if keep == total:
                tail = tuple(x[:0] for x in tail)
            return Node(
                raw,
                np.concatenate([head[0], mid[0], tail[0]]),
                np.concatenate([head[1], mid[1] + begin, tail[1] + keep]),
                np.concatenate([head[2], mid[2] + begin, tail[2] + keep]),
            )
        if begin == 0 and end == total:
            return leaf(bpe, raw.decode())
        window *= 2


def encode_block(bpe: Bpe, texts: list[str], pool: ThreadPoolExecutor, leaf_chars: int = LEAF_CHARS) -> list[np.ndarray]:
    """Ids of each text; parts of long texts are encoded in parallel and joined up the tree."""
    out: list[np.ndarray | None] = [None] * len(texts)
    long = [k for k, t in enumerate(texts) if len(t) > leaf_chars]
    long_set = set(long)
    for k, t in enumerate(texts):
        if k not in long_set:
            out[k] = bpe.ids(t)
    for k in long:
        level = list(pool.map(lambda p: leaf(bpe, p), halves(texts[k], leaf_chars)))
        while len(level) > 1:
            level = list(pool.map(lambda pair: join(bpe, *pair), zip(level[::2], level[1::2], strict=True)))
        out[k] = level[0].ids
    return out


def decode(bpe: Bpe, ids: np.ndarray) -> bytes:
    """The UTF-8 bytes that the library's decode would give; bytes that are not UTF-8 are replaced as it does."""
    raw = b"".join(map(bpe.bytes_of.__getitem__, ids.tolist()))
    return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, leaf_chars: int = LEAF_CHARS, digests: bool = False) -> DataFrame:
    """id, n_tokens, and ids (little-endian 32-bit) with the text decoded from them, or with ``digests`` their SHA-256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(tokenizer)
        with ThreadPoolExecutor(2) as pool:
            for frame in frames:
                texts = frame["text"].tolist()
                for part in blocks(texts):
                    own = encode_block(bpe, texts[part], pool, leaf_chars)
                    packed = [x.astype("<u4").tobytes() for x in own]
                    decoded = [decode(bpe, x) for x in own]
                    out = {"id": frame["id"].iloc[part].to_numpy(), "n_tokens": [len(x) for x in own]}
                    if digests:
                        out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in packed]
                        out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
                    else:
                        out["ids"], out["decoded"] = packed, [x.decode() for x in decoded]
                    yield pd.DataFrame(out)

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(tidy(run), f"id {id_type}, n_tokens long, {columns}").withColumnRenamed("id", id_col)
