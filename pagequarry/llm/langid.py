"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts hashed n-grams of one to four characters per language over a
bounded sample of labelled rows: about ``max_rows`` divided by the number of
languages of each, picked by a hash of id and text, and all rows of a language that
has fewer, so a rare language is learned at any size of the table.  A language's
prior is its share of all labelled rows.  At most ``MAX_LABELS`` languages, those with the
most rows, are learned, so the log-probability matrix, languages by ``BUCKETS``, is
bounded and is broadcast.  Scoring is sparse: of a block of texts only the buckets
that occur are looked up, in numpy.

A posterior multiplies all n-grams of a text and so is 1 after a few words in any
language.  :func:`fit_judge` adds what does not depend on length: the mean
log-probability of the n-grams of a text's letters.  Labelled texts, each scored
without its own counts, and the same texts backwards show which means are usual
for a language and which are not, and by how much a language usually leads.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no labelled row every text is ``und``; equal scores go to the first language
in order of name; repeated rows repeat their result; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.llm.rows import hash63, quota_sample
from pagequarry.workspace import tidy

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
MAX_ROWS = 20_000
#: A language is a row of ``BUCKETS`` numbers (256 KB) in the broadcast matrix.
MAX_LABELS = 256
SMOOTHING = 0.1
BLOCK_CHARS = 1_000_000
#: Products of counts and log-probabilities that are held at a time, 8 bytes each.
GRAMS = 1 << 21
#: A text this far on the way from its language's usual mean to that of the language backwards is foreign.
MAX_DISTANCE = 2 / 3
#: Lead over the second language, as a share of the usual one, below which a text is mixed: 5/8 of it in one language.
MIN_LEAD = 0.25
_OTHERS = re.compile(r"[\W\d_]+")
_STEP = np.uint32(0x9E3779B1)
_UND = "und"
#: Languages in order of name, log-probabilities, log priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def hashed_ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text in lower case, words marked by single spaces."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), np.uint32)
    out, have = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        have = have[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint32(n)
        mixed = have ^ (have >> np.uint32(15))
        mixed = mixed * _STEP
        out.append((mixed >> np.uint32(16)).astype(np.int64))
    return np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def labelled_sample(rows: DataFrame, text_col: str, label_col: str, max_rows: int = MAX_ROWS, key: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
    """text and label of the rows to fit on, and how many labelled rows each language has in all."""
    own = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(label_col).alias("label"), hash63(*([] if key is None else [key]), F.col(text_col)).alias("h")
    )
    found = own.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
    counts = {r["label"]: (r["n"], r["least"]) for r in found}
    each = max(1, max_rows // max(1, len(counts)))
    drawn = quota_sample(own, counts, dict.fromkeys(counts, each), "label", "h")
    return drawn.select("text", "label"), {k: n for k, (n, _) in counts.items()}


def count_ngrams(own: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and how often each bucket occurs in them (languages x BUCKETS)."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                got = np.bincount(hashed_ngrams(text), minlength=BUCKETS)
                if label in sums:
                    sums[label] += got
                else:
                    sums[label] = got
        for label, v in sums.items():
            k = np.flatnonzero(v)
            yield pd.DataFrame({"label": label, "bucket": k, "n": v[k]})

    # at most one row per language and bucket reaches the driver
    rows = own.mapInPandas(tidy(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(rows["label"].unique())
    counts = np.zeros((len(labels), BUCKETS), np.int64)
    if labels:
        np.add.at(counts, (np.searchsorted(labels, rows["label"].to_numpy(str)), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    return labels, counts


def log_table(counts: np.ndarray) -> np.ndarray:
    table = counts + SMOOTHING
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def log_prior(labels: list[str], sizes: dict[str, int]) -> np.ndarray:
    """Log of each language's share of the labelled rows."""
    own = np.array([sizes[x] for x in labels], np.float64)
    return np.log(own / own.sum()) if len(own) else own


def fit(rows: DataFrame, text_col: str, label_col: str, max_rows: int = MAX_ROWS, key: Column | None = None) -> Model:
    """Languages, their log-probability matrix (languages x BUCKETS) and log priors."""
    own, sizes = labelled_sample(rows, text_col, label_col, max_rows, key)
    labels, counts = count_ngrams(own)
    return labels, log_table(counts), log_prior(labels, sizes)


def log_sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the n-grams' log-probabilities (texts x languages), and numbers of n-grams.

    A block of texts is one sparse matrix, of each text the buckets that occur and
    their counts, times the table; ``GRAMS`` products are held at a time.
    """
    by_bucket = np.ascontiguousarray(table.T)
    out, sizes = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    most = max(1, GRAMS // max(1, len(table)))
    first, waiting = 0, 0
    buckets: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for k, text in enumerate(texts):
        own = np.bincount(hashed_ngrams(text), minlength=BUCKETS)
        buckets.append(np.flatnonzero(own))
        counts.append(own[buckets[-1]])
        sizes[k] = counts[-1].sum()
        waiting += len(buckets[-1])
        if waiting >= most or k + 1 == len(texts):
            starts = np.concatenate([[0], np.cumsum([len(b) for b in buckets])[:-1]])
            out[first : k + 1] = np.add.reduceat(by_bucket[np.concatenate(buckets)] * np.concatenate(counts)[:, None], starts, axis=0, dtype=np.float64)
            first, waiting, buckets, counts = k + 1, 0, [], []
    return out, sizes


def letters_of(text: str) -> str:
    """A text's letters alone, in runs."""
    return _OTHERS.sub(" ", text)


def mean_logs(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean log-probability per n-gram of each text's letters in each language."""
    sums, sizes = log_sums([letters_of(t) for t in texts], table)
    return sums / np.maximum(sizes, 1)[:, None]


def fit_judge(rows: DataFrame, text_col: str, label_col: str, max_rows: int = MAX_ROWS, key: Column | None = None) -> tuple[Model, np.ndarray]:
    """The model and, for each language, the usual mean, that of texts backwards, and the usual lead."""
    own, sizes = labelled_sample(rows, text_col, label_col, max_rows, key)
    labels, counts = count_ngrams(own)
    shared = own.sparkSession.sparkContext.broadcast((labels, counts))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, counts = shared.value
        table, sums = log_table(counts), counts.sum(axis=1) + SMOOTHING * BUCKETS
        for frame in frames:
            out = []
            for text, label in zip(frame["text"], frame["label"], strict=True):
                if not has_letter(text):
                    continue
                k = labels.index(label)
                whole = np.bincount(hashed_ngrams(text), minlength=BUCKETS)
                grams = hashed_ngrams(letters_of(text))
                # its own language without the text's own counts
                rest = float(np.log((np.maximum(counts[k, grams] - whole[grams], 0) + SMOOTHING) / (sums[k] - whole.sum())).mean())
                ahead, back = mean_logs([text, text[::-1]], table)
                others = np.delete(ahead, k)
                out.append((label, rest, back[k], rest - others.max() if len(others) else np.nan))
            yield pd.DataFrame(out, columns=["label", "mean", "back", "lead"])

    # at most ``max_rows`` rows of three numbers, about, reach the driver
    rated = own.mapInPandas(tidy(rate), "label string, mean double, back double, lead double").toPandas()
    usual = rated.groupby("label")[["mean", "back", "lead"]].median().reindex(labels)
    return (labels, log_table(counts), log_prior(labels, sizes)), usual.to_numpy(np.float64)


def judge_block(texts: list[str], names: list[str], model: Model, usual: np.ndarray) -> list[bool]:
    """Whether each text's letters are as usual for the language it was given and lead the second one clearly.

    Where labelled texts show no difference (one text of a language, say), the rule they would set is passed.
    """
    labels, table, _ = model
    out = []
    for name, logs in zip(names, mean_logs(texts, table) if labels else [None] * len(texts), strict=True):
        if name == _UND:
            out.append(False)
            continue
        k = labels.index(name)
        mean, back, lead = usual[k]
        foreign = mean > back and mean - logs[k] > MAX_DISTANCE * (mean - back)
        mixed = lead > 0 and logs[k] - np.delete(logs, k).max() < MIN_LEAD * lead
        out.append(not (foreign or mixed))
    return out


def score_block(texts: list[str], model: Model) -> tuple[list[str], list[float]]:
    """Best language and its posterior for each text."""
    labels, table, prior = model
    names, scores = [_UND] * len(texts), [0.0] * len(texts)
    own = [k for k, t in enumerate(texts) if labels and t and has_letter(t)]
    sums = log_sums([texts[k] for k in own], table)[0] + prior
    for k, logs in zip(own, sums, strict=True):
        odds = np.exp(logs - logs.max())
        best = int(np.argmax(odds))
        names[k], scores[k] = labels[best], float(odds[best] / odds.sum())
    return names, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for part in blocks(texts, BLOCK_CHARS):
                names, scores = score_block(texts[part], shared.value)
                yield pd.DataFrame({"id": frame["id"].iloc[part].to_numpy(), "lang_pred": names, "score": scores})

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInPandas(tidy(run), f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in a fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
