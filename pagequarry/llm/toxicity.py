"""Toxicity: a linear-chain conditional random field over words.

Labels say whether a document is toxic, not which words are.  Token labels come
from them: word forms and word beginnings that explain toxic documents and do
not occur in clean ones are chosen greedily until the toxic ones are explained;
the words they match in toxic documents are the labelled tokens.  The field is
trained on stretches around those and on stretches of clean text.

Fitting uses a bounded sample of labelled rows: about ``MAX_TOXIC`` and ``MAX_CLEAN``
of them at any size of the tables, picked by a hash of the id, equal texts once.
All of these take part: should they have more than ``MAX_CHARS`` characters, the
longest are cut down to one length, as pieces from all over each.  Of an id with
many texts some are taken, by hash.  Scoring takes every whole text: forward and
backward passes give each word's marginal, the largest is the document's score, and
words of at least one half are the offending spans, given by their places in the
text itself.

Defined results: a null text or one without letters scores 0; without labels of
both kinds every text scores 0; conflicting labels of a document count as toxic;
repeated rows repeat their result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.llm.rows import hash63, quota_sample
from pagequarry.workspace import drop_stage, stage

MAX_TOXIC = 1_000
MAX_CLEAN = 2_000
#: Characters of sampled texts that reach the driver, at most.
MAX_CHARS = 30_000_000
#: A text that is longer than its share of these is cut into pieces of about so many characters.
PIECE_CHARS = 2_000
STRETCH = 24
EPOCHS = 60
THRESHOLD = 0.7
WORDS_KEPT = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def features(word: str) -> list[str]:
    """What the field sees of a word: itself and its beginnings."""
    out = ["w" + word]
    return out + [f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n]


@dataclass
class Crf:
    """Weights of features for the toxic label, and 2x2 transition factors."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    transitions: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    start: float = 0.0


class Scores(dict):
    """Emission factor of each word, filled on first use."""

    def __init__(self, model: Crf):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        get = self.model.weights.get
        value = exp(min(30.0, max(-30.0, self.model.bias + sum(get(f, 0.0) for f in features(word)))))
        self[word] = value
        return value


def messages(odds: np.ndarray, transitions: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages (with a word's own emission) and backward ones (without), as ratios of the two labels.

    ``odds`` is (time, batch); rows beyond a shorter sequence's end hold NaN.
    """
    (t00, t01), (t10, t11) = transitions
    ended = np.isnan(odds)
    odds = np.where(ended, 1.0, odds)
    ahead, behind = np.empty_like(odds), np.empty_like(odds)
    ahead[0] = r = odds[0] * np.exp(start)
    for t in range(1, len(odds)):
        r = odds[t] * (t01 + r * t11) / (t00 + r * t10)
        ahead[t] = r
    s = np.ones(odds.shape[1])
    for t in range(len(odds) - 1, -1, -1):
        behind[t] = s
        v = odds[t] * s
        s = np.where(ended[t], 1.0, (t10 + t11 * v) / (t00 + t01 * v))
    return ahead, behind


def marginals(odds: np.ndarray, transitions: np.ndarray, start: float) -> np.ndarray:
    """Forward-backward marginals of the toxic label; 0 beyond a sequence's end."""
    ahead, behind = messages(odds, transitions, start)
    ratio = ahead * behind
    out = ratio / (1.0 + ratio)
    out[np.isnan(odds)] = 0.0
    return out


def pair_marginals(odds: np.ndarray, transitions: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(2, 2, time - 1, batch): chance of each pair of labels at two neighbouring places."""
    after = np.where(np.isnan(odds[1:]), 1.0, odds[1:]) * behind[1:]
    out = np.empty((2, 2, *after.shape))
    for a in (0, 1):
        for b in (0, 1):
            out[a, b] = (ahead[:-1] if a else 1.0) * transitions[a, b] * (after if b else 1.0)
    return out / out.sum(axis=(0, 1))


def batched(lengths: list[int], most: int = 1_500_000) -> Iterator[list[int]]:
    """Indices in batches of similar length, so little is padding."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__)
    batch: list[int] = []
    for k in order:
        if batch and (len(batch) + 1) * lengths[k] > most:
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def score_texts(texts: list[str], model: Crf, known: Scores) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """Score and offending spans (start and end, in characters) of each text."""
    odds = []
    for text in texts:
        own = words_of(text)
        odds.append(np.fromiter(map(known.__getitem__, own), np.float64, len(own)))
    scores, spans = [0.0] * len(texts), [[] for _ in texts]
    for batch in batched([len(x) for x in odds]):
        longest = len(odds[batch[-1]])
        if not longest:
            continue
        table = np.full((longest, len(batch)), np.nan)
        for c, k in enumerate(batch):
            table[: len(odds[k]), c] = odds[k]
        found = marginals(table, model.transitions, model.start)
        best = found.max(axis=0)
        for c, k in enumerate(batch):
            scores[k] = float(best[c])
            if best[c] >= 0.5:
                bad = set(np.flatnonzero(found[:, c] >= 0.5).tolist())
                spans[k] = [m.span() for n, m in enumerate(_WORD.finditer(texts[k])) if n in bad]
    return scores, spans


# --- fitting ----------------------------------------------------------------


def families(texts: list[list[str]], rows: int = 16) -> list[int]:
    """A number for each text; near copies share one.

    Texts meet when half of their ``rows`` minimum word hashes agree.
    """
    turns = np.random.default_rng(3).integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)
    least = np.zeros((len(texts), rows), np.uint64)
    for k, words in enumerate(texts):
        if words:
            h = pd.util.hash_array(np.array(sorted(set(words)), dtype=object), categorize=False)
            least[k] = (h[:, None] * turns).min(axis=0)
    own = list(range(len(texts)))
    for k in range(len(texts)):
        if own[k] == k:
            for j in np.flatnonzero((least[k + 1 :] == least[k]).sum(axis=1) * 2 >= rows):
                own[k + 1 + j] = k
    return own


def explain(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features that explain toxic documents and are all but absent from clean ones.

    A family of near copies counts as one document: what copies share is no marker.
    """
    kinds = lambda words: {f for w in set(words) for f in features(w)}
    first: dict[int, list[str]] = {}
    for number, words in zip(families(toxic), toxic, strict=True):
        first.setdefault(number, words)
    toxic = list(first.values())
    in_clean: Counter = Counter()
    for words in clean:
        in_clean.update(kinds(words))
    where = defaultdict(list)
    for k, words in enumerate(toxic):
        for f in kinds(words):
            where[f].append(k)
    at_least = max(2, len(toxic) // 100)
    rate = len(clean) / max(1, len(toxic))
    pure = {f: ks for f, ks in where.items() if len(ks) >= at_least and in_clean[f] <= 0.02 * rate * len(ks)}
    left, chosen = set(range(len(toxic))), set()
    by_size = sorted(pure, key=lambda f: (-len(pure[f]), f))
    while left:
        # a feature's gain only shrinks, so the first whose gain is not below the next one's size is the best
        best, gain = None, 0
        for f in by_size:
            if len(pure[f]) <= gain:
                break
            g = sum(k in left for k in pure[f])
            if g > gain:
                best, gain = f, g
        if best is None or gain < at_least:
            break
        chosen.add(best)
        left -= set(pure[best])
    # whatever is as wide-spread as the chosen ones is a marker too, though the documents were explained without it
    if chosen:
        least = max(at_least + 1, 0.5 * np.median([len(pure[f]) for f in chosen]))
        chosen |= {f for f in pure if len(pure[f]) >= least}
    return chosen


def train(toxic: list[str], clean: list[str], seed: int = 7) -> Crf:
    """Fit the field on texts of both kinds.

    After a first fit the clean texts are scored, and the stretches that were
    taken for toxic join the training data for a second one.
    """
    toxic_words, clean_words = [words_of(t) for t in toxic], [words_of(t) for t in clean]
    markers = explain(toxic_words, clean_words)
    if not markers:
        return Crf()
    draw = np.random.default_rng(seed)
    stretches: list[tuple[list[str], list[int]]] = []
    for words in toxic_words:
        tags = [int(any(f in markers for f in features(w))) for w in words]
        hits = [k for k, y in enumerate(tags) if y]
        for k in hits[:: max(1, len(hits) // 4)]:
            a = max(0, k - int(draw.integers(STRETCH)))
            stretches.append((words[a : a + STRETCH], tags[a : a + STRETCH]))
    for words in clean_words:
        if words:
            for _ in range(2):
                a = int(draw.integers(max(1, len(words) - STRETCH + 1)))
                stretches.append((words[a : a + STRETCH], [0] * len(words[a : a + STRETCH])))
    model = _fit_stretches(stretches)
    for _ in range(2):
        known, more = Scores(model), []
        for words in clean_words:
            if words:
                odds = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                p = marginals(odds[:, None], model.transitions, model.start)[:, 0]
                k = int(p.argmax())
                if p[k] > 0.1:
                    a = max(0, k - STRETCH // 2)
                    more.append((words[a : a + STRETCH], [0] * len(words[a : a + STRETCH])))
        if not more:
            break
        stretches += more * 3
        model = _fit_stretches(stretches)
    return model


@dataclass
class Stretches:
    """Tagged stretches as arrays: feature ids (time, batch, 3), tags, which places are there, number of features."""

    ids: np.ndarray
    tags: np.ndarray
    present: np.ndarray
    size: int


def slope(params: np.ndarray, data: Stretches) -> np.ndarray:
    """Gradient of the mean log-likelihood a place: weights, bias, start, four transitions (logs)."""
    size = data.size
    weights, bias, start, moves = np.append(params[:size], 0.0), params[size], params[size + 1], params[size + 2 :].reshape(2, 2)
    flat = data.ids.reshape(-1)
    raw = bias + weights[flat].reshape(data.ids.shape).sum(axis=2)
    odds = np.where(data.present, np.exp(np.clip(raw, -30, 30)), np.nan)
    factors = np.exp(moves)
    ahead, behind = messages(odds, factors, start)
    p = ahead * behind / (1.0 + ahead * behind)
    gap = np.where(data.present, data.tags - p, 0.0)
    here = data.present[1:] & data.present[:-1]
    expected = (pair_marginals(odds, factors, ahead, behind) * here).sum(axis=(2, 3))
    truth = np.array([[np.sum(here & (data.tags[:-1] == a) & (data.tags[1:] == b)) for b in (0, 1)] for a in (0, 1)])
    own = np.bincount(flat, weights=np.repeat(gap.reshape(-1), data.ids.shape[2]), minlength=size + 1)[:size]
    return np.concatenate([own, [gap.sum(), gap[0].sum()], (truth - expected).reshape(-1)]) / data.present.sum()


def _fit_stretches(stretches: list[tuple[list[str], list[int]]]) -> Crf:
    """Maximise the conditional likelihood of tagged stretches by gradient steps."""
    index: dict[str, int] = {}
    ids = np.full((STRETCH, len(stretches), 3), -1, np.int64)
    tags = np.zeros((STRETCH, len(stretches)))
    present = np.zeros((STRETCH, len(stretches)), bool)
    for c, (words, ys) in enumerate(stretches):
        for t, w in enumerate(words):
            for j, f in enumerate(features(w)):
                ids[t, c, j] = index.setdefault(f, len(index))
        tags[: len(ys), c], present[: len(ys), c] = ys, True
    size = len(index)
    # the id after the last stands for no feature
    data = Stretches(np.where(ids < 0, size, ids), tags, present, size)
    params = np.zeros(size + 6)
    params[size] = -4.0
    first, second = np.zeros(size + 6), np.zeros(size + 6)
    for epoch in range(1, EPOCHS + 1):
        g = slope(params, data)
        g[:size] -= 1e-6 * params[:size]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
        params += 0.2 * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-6)
    names = {f: float(params[k]) for f, k in index.items() if abs(params[k]) > 0.01}
    return Crf(names, float(params[size]), np.exp(params[size + 2 :].reshape(2, 2)), float(params[size + 1]))


def longest_share(lengths: list[int], most: int = MAX_CHARS) -> int:
    """Characters that each text may give so that all together give at most ``most``; shorter texts leave theirs to longer ones."""
    left, own = most, sorted(lengths)
    for k, n in enumerate(own):
        if n * (len(own) - k) > left:
            return left // (len(own) - k)
        left -= n
    return own[-1] if own else 0


def stretches_of(text: Column, most: int) -> Column:
    """The text, or if it is longer than ``most`` characters about as many from places evenly over all of it."""
    pieces = max(1, most // PIECE_CHARS)
    size = max(1, most // pieces)
    step = (F.length(text) - size) / F.lit(max(1, pieces - 1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substr(text, (k * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(cut, "\n"))


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Train on a bounded sample of labelled documents for which ``usable`` holds."""
    tags = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg((F.max(label_col) > 0).alias("toxic"))
    tags = tags.withColumn("h", hash63("labelled"))
    counts = {r["toxic"]: (r["n"], r["least"]) for r in tags.groupBy("toxic").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    if len(counts) < 2:
        return Crf()
    # about MAX_TOXIC + MAX_CLEAN ids at any size of the tables, so they are broadcast and no text is shuffled
    drawn = quota_sample(tags, counts, {True: MAX_TOXIC, False: MAX_CLEAN}, "toxic", "h").select("labelled", "toxic")
    rows = docs.where(usable & F.col(text_col).isNotNull()).select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text"))
    got = stage(rows.join(F.broadcast(drawn), "labelled").groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("text")), "toxicity-sample")
    # an id may have many texts; twice the quota is the bound then
    held = got.orderBy("h", "text").limit(2 * (MAX_TOXIC + MAX_CLEAN))
    most = longest_share([r["n"] for r in held.select(F.length("text").alias("n")).collect()])
    texts = held.select(stretches_of(F.col("text"), most).alias("text"), "toxic").collect()
    drop_stage(got)
    return train([r["text"] for r in texts if r["toxic"]], [r["text"] for r in texts if not r["toxic"]])


def score_documents(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and offending spans of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Scores(shared.value)
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts):
                if len(known) > WORDS_KEPT:
                    known.clear()
                scores, spans = score_texts(texts[part], shared.value, known)
                yield pd.DataFrame(
                    {
                        "id": frame["id"].iloc[part].to_numpy(),
                        "score": scores,
                        "spans": [[{"start": a, "end": b} for a, b in own] for own in spans],
                    }
                )

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(run, f"id {id_type}, score double, spans array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)
