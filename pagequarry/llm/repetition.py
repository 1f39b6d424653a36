"""Quality rules on repetition coverage.

Words of a text become integers; the hash of each n-gram length rolls from the
length before it, in numpy.  For each length the share of word characters inside
n-grams that occur more than once, and the share of line characters in repeated
lines, is held against a limit.  Equal hashes are confirmed word by word for the
counts that are reported.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows repeat their result; an empty table gives an empty result; only
the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Limits:
    """Largest shares of characters (code points); those of the Gopher rules unless other ones are given."""

    #: In repeated n-grams of each length, all copies counted.
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    #: In later copies of lines, of all line characters.
    lines: float = 0.20
    #: In the commonest n-gram of each length.
    tops: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    #: In lines that occur more than once, all copies counted: twice that of later copies.
    line_copies: float = 0.40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _TURN
    return x ^ (x >> np.uint64(27))


def rolling_hashes(ids: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all n-grams, for rising lengths; each length extends the one before."""
    base = _mix((ids.astype(np.uint64) + np.uint64(1)) * _STEP)
    have, n = base, 1
    for length in lengths:
        while n < length and len(have) > 1:
            have = _mix(have[:-1] * _STEP + base[n:])
            n += 1
        yield length, have if n == length else have[:0]


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur more than once."""
    if len(hashes) < 2:
        return np.zeros(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    equal = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(hashes), bool)
    flags[order[1:][equal]] = True
    flags[order[:-1][equal]] = True
    return flags


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in an n-gram whose start is flagged."""
    edge = np.zeros(total + 1, np.int64)
    where = np.flatnonzero(starts)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + n, -1)
    return np.cumsum(edge[:-1]) > 0


def confirmed(flags: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Flags of n-grams that truly occur twice, should two hashes have met by chance."""
    where = np.flatnonzero(flags)
    if not len(where):
        return flags
    grams = np.lib.stride_tricks.sliding_window_view(ids, n)[where]
    _, back, counts = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
    out = np.zeros(len(flags), bool)
    out[where[counts[back.reshape(-1)] > 1]] = True
    return out


def top_share(hashes: np.ndarray, n: int, sizes: np.ndarray) -> float:
    """Share of characters in the n-gram with most of them, words of overlapping copies counted once."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    # places of one n-gram after each other, in order
    at = np.argsort(hashes, kind="stable")
    same = hashes[at][1:] == hashes[at][:-1]
    ends = at + n
    # a copy counts up to where the next one starts
    ends[:-1] = np.where(same, np.minimum(ends[:-1], at[1:]), ends[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    chars = np.add.reduceat(edges[ends] - edges[at], starts)
    often = np.diff(starts, append=len(at)) > 1
    return float(chars[often].max(initial=0)) / edges[-1]


def code_points(raw: bytes) -> int:
    """Characters of UTF-8 text."""
    return len(raw) if raw.isascii() else int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def measure(raw: bytes, limits: Limits) -> tuple[int, int, int, int, int, float, float, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, largest n-gram share over its limit, line share, verdict."""
    words = raw.split()
    n = len(words)
    points = code_points(raw) - sum(raw.count(bytes([b])) for b in SPACES)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup_lines, dup_chars, first_chars, line_chars, seen = 0, 0, 0, 0, {}
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            width = code_points(line)
            line_chars += width
            if line in seen:
                dup_lines += 1
                dup_chars += width
                first_chars += width if seen[line] == 1 else 0
            seen[line] = seen.get(line, 0) + 1
    line_share = dup_chars / line_chars if line_chars else 0.0
    ids, names = pd.factorize(np.array(words, dtype=object)) if n else (np.zeros(0, np.int64), [])
    ids = np.asarray(ids, np.int64)
    sizes = np.fromiter(map(code_points, names), np.int64, len(names))[ids]
    total = int(sizes.sum())
    repeat_words, worst, ok = 0, 0.0, line_share <= limits.lines
    ok = ok and dup_chars + first_chars <= limits.line_copies * line_chars
    shares, tops = dict(limits.ngrams), dict(limits.tops)
    for length, hashes in rolling_hashes(ids, sorted({*shares, *tops, WINDOW})):
        flags = repeated(hashes)
        if not flags.any():
            break  # a longer n-gram that occurs twice would hold one of these
        if length == WINDOW:
            repeat_words = int(covered(confirmed(flags, ids, WINDOW), WINDOW, n).sum())
        if ok and length in tops:
            ok = top_share(hashes, length, sizes) <= tops[length]
        if length in shares:
            share = float(sizes[covered(flags, length, n)].sum()) / total
            worst = max(worst, share / shares[length])
            ok = ok and share <= shares[length]
    return n, points, symbols, dup_lines, repeat_words, worst, line_share, bool(ok)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """Counts, shares and verdicts for each whole text."""
    limits = limits or Limits()
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ngram_excess", "dup_line_share", "method_kept"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts):
                rows = [measure(t.encode(), limits) for t in texts[part]]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "id", frame["id"].iloc[part].to_numpy())
                yield out

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = own.mapInPandas(
        run,
        f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ngram_excess double, dup_line_share double, method_kept boolean",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("method_kept"))
        .withColumnRenamed("id", id_col)
    )
