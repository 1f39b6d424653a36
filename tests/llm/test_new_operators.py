"""Search, exact deduplication and whitening against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import dedup, search, whitening

DOCS = "doc_id long, text string, id string, n string, terms string, digest string, row string, place string, number string, rank string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, *["x"] * 8) for k, t in rows], DOCS).repartition(5)


# --- 11 ---


def best_documents(docs, items, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    own = [(k, terms(t)) for k, t in docs]
    own = [(k, ts) for k, ts in own if ts]
    total, all_terms = len(own), sum(len(ts) for _, ts in own)
    df = {}
    for _, ts in own:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out, asked = set(), {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, ts in asked.items():
        scored = []
        for k, words in own:
            m = 10 + (90 * len(words) * total) // all_terms
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m)) for t in ts if (tf := words.count(t)))
            if score:
                scored.append((-score, math.inf if k is None else k))
        out |= {(item, n + 1, None if k == math.inf else k, -s) for n, (s, k) in enumerate(sorted(scored)[:top])}
    return out


ODD = [(900, None), (901, ""), (902, " \n\t--"), (903, "É é ß 中文 a\x00b"), (903, "É é ß 中文 a\x00b"), (None, "w1 w2 w3"), (904, "w1 " * 50_000 + "w2")]


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    return [(k, " ".join(draw.choices(words, [1 / (1 + j) for j in range(60)], k=draw.randint(1, 40)))) for k in range(n)]


ITEMS = [(1, "w1 w50 w59 W3"), (2, "w0 w0 w0"), (3, None), (4, "nowhere"), (5, "é 中文 a"), (6, "w7"), (6, "w8 w9"), (7, "")]


def found(docs, items):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.top_documents(docs, items).collect()}


@pytest.fixture(params=["as it is", "small segments", "all terms, items by blocks"])
def limits(request, monkeypatch):
    if request.param == "small segments":
        monkeypatch.setattr(search, "SEGMENT_DOCS", 37)
        monkeypatch.setattr(search, "STRETCH", 8)
        monkeypatch.setattr(search, "BLOCK", 4)
    if request.param == "all terms, items by blocks":
        monkeypatch.setattr(search, "MAX_TERMS", 0)
        monkeypatch.setattr(search, "ITEM_BLOCK", 2)


def test_search_against_brute_force(spark, limits):
    copies = [(1_000 + k, "w1 w50 w7 tie") for k in range(60)]  # equal scores beyond the tenth place
    rows = corpus(300) + ODD + copies
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, terms string")
    assert found(docs_of(spark, rows), items) == best_documents(rows, ITEMS)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.top_documents(docs_of(spark, []), items).count() == 0
    assert search.top_documents(docs_of(spark, [(1, None)]), items).count() == 0
    assert search.top_documents(docs_of(spark, corpus(5)), items.where("item_id = 3")).count() == 0
    assert search.top_documents(docs_of(spark, corpus(5)), items.where("false")).count() == 0


def test_blocks_are_rejected_before_they_are_opened():
    draw = np.random.default_rng(5)
    n = 4_000
    lengths = draw.integers(5, 300, n)
    rare = np.sort(draw.choice(n, 40, replace=False))
    # one stretch of the common list holds its large counts
    common_tf = np.where(np.arange(n) < 200, 9, 1)
    owner = np.concatenate([np.arange(n), rare])
    terms = pa.array([b"common"] * n + [b"rare"] * len(rare), pa.binary())
    seg = search.segment_of(np.arange(n) * 3, lengths, terms, owner, np.concatenate([common_tf, np.full(len(rare), 3)]), n, int(lengths.sum()))
    ids, ms = np.frombuffer(seg["ids"], "<i8"), np.frombuffer(seg["ms"], "<i8")
    lists = {x["term"]: search.Postings(x["top"], *(np.array(x[c]) for c in ("firsts", "lasts", "tops")), x["payloads"], {}) for x in seg["lists"]}
    weights = {b"common": 5, b"rare": 4_000}
    query = [(w, lists[t]) for t, w in weights.items()]
    heap = search.Heap(10, np.empty(0, np.int64), np.empty(0, np.int64))
    search.search_segment(query, ids, ms, heap)
    for own in lists.values():
        own.opened.clear()
    again = search.Heap(10, np.full(10, heap.least - 1), np.zeros(10, np.int64))  # almost as good, so the common list is not essential
    search.search_segment(query, ids, ms, again)
    m = 10 + (90 * lengths * n) // int(lengths.sum())
    score = 5 * (10**9 * common_tf // (1000 * common_tf + 8 * m))
    score[rare] += 4_000 * (10**9 * 3 // (3000 + 8 * m[rare]))
    want = np.sort(score)[::-1][:10]
    assert heap.scores.tolist() == again.scores.tolist() == want.tolist()
    assert again.ids.tolist() == heap.ids.tolist()
    assert len(lists[b"common"].opened) < len(lists[b"common"].payloads) / 2


def test_blocks_round_trip():
    for docs, tf in (([0], [1]), ([5, 300, 70_000], [1, 2, 5_000_000_000]), (list(range(128)), [255] * 128), (list(range(0, 512, 4)), [256] * 128)):
        a, b = search.open_block(search.pack_block(np.array(docs), np.array(tf)), docs[0])
        assert a.tolist() == docs and b.tolist() == tf


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    text = "ab " * 1_000 + "x" * 500 + " É" * 400
    whole = [w for part in search.terms_of(text) for w in part]
    monkeypatch.setattr(search, "_PIECE", 7)
    assert [w for part in search.terms_of(text) for w in part] == whole == text.lower().replace("é", "É").encode().split()


# --- 12 ---


def equal_groups(rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), math.inf if k is None else k))
    return {
        key: (min(own)[1], len(own), hashlib.sha256(key.encode()).hexdigest()) for key, own in groups.items()
    }, squeeze


SPACED = ["a b", "ab", "a  b", "\ta\nb\x0b\x0c\r", "", None, "  ", "a b", "A b", "x" * 300_000, "x" * 300_000 + " ", " ", "a b"]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_exact_groups_against_brute_force(spark, rounds):
    draw = random.Random(8)
    rows = list(enumerate(SPACED)) + [(100 + k, draw.choice(["hot copy", "hot  copy", f"t {k % 90}", f"t{k % 90}"])) for k in range(400)] + [(3, "a b"), (3, "a b"), (None, "only null id"), (None, "t 1")]
    got = dedup.exact_groups(docs_of(spark, rows), rounds=rounds).collect()
    groups, squeeze = equal_groups(rows)
    want = sorted((str(k), str(groups[squeeze(t)][0]), groups[squeeze(t)][1], groups[squeeze(t)][2]) for k, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]) if r["keep_id"] is not None else "inf", r["group_size"], r["text_sha256"]) for r in got) == want
    # of every group exactly one row stays, rows that repeat an id included
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_groups_of_nothing(spark):
    assert dedup.exact_groups(docs_of(spark, [])).count() == 0


def test_rounds_grow_with_rows():
    assert [dedup.rounds_for(n) for n in (0, 10**6, 10**8, 10**11)] == [2, 2, 3, 6]


def test_every_level_folds(spark):
    """After round r entries of one digest are left in at most as many places as the other digits allow."""
    rows = spark.range(64).select(F.unhex(F.sha2(F.lit("one").cast("binary"), 256)).alias("digest"), F.lit(3).cast("long").alias("bytes"), F.col("id").alias("place"), F.lit(1).cast("long").alias("n"), F.col("id").alias("chars"), F.col("id").alias("id"), F.col("id").alias("row"))
    one = dedup.merge_round(rows, 0, 6).collect()
    assert len(one) == 8 and sum(r["n"] for r in one) == 64
    two = dedup.merge_runs(rows, 2).collect()
    assert [(r["n"], r["id"], r["chars"]) for r in two] == [(64, 63, 63)]


# --- 13 ---


def brute_whitening(vectors):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    full = n * x - sums
    v = np.array([[float(a) for a in row] for row in full.T @ full / n**3])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:8]
    return n, [int(r @ r) for r in full], (full / n).astype(float) @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def vectors(seed, rows, dims):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(rows, dims)) @ draw.normal(size=(dims, dims)) * 0.3 + draw.normal(size=dims)).tolist()


def test_whitening_against_brute_force(spark):
    good = vectors(1, 200, 12)
    good += [good[0]] * 70  # a common vector
    bad = [None, [], [1.0] * 11, [1.0] * 13, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] * 12, [1e300] * 12]
    rows = [(k, v, "x", 1) for k, v in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int").repartition(4)
    got = whitening.whiten(docs).collect()
    n, deviation, white, explained = brute_whitening(good)
    assert len(got) == len(good) * 8 and {r["n"] for r in got} == {n}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(enumerate(deviation))
    mine = np.zeros((len(good), 8))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    signs = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine, white * signs, atol=1e-8)
    assert len({r["identity_error"] for r in got}) == 1 and 0 < got[0]["identity_error"] < 1e-9


def test_covariance_is_exact_far_from_zero(spark):
    """Values whose squares leave 64 bits."""
    draw = random.Random(2)
    good = [[float(draw.randint(-(2**40), 2**40)) for _ in range(3)] for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good)), "vec_id long, embedding array<double>").repartition(3)
    rows = docs.select(F.col("embedding").alias("v"))
    n, sums = whitening.moments(rows, 3)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in good]
    assert sums == [sum(v[k] for v in x) for k in range(3)]
    exact = [[sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in x) / n**3 for b in range(3)] for a in range(3)]
    assert whitening.covariance(rows, 3, n, sums).tolist() == exact


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted(r["whitened"] for r in line if r["component"] == 1) == [-1.0, 1.0] and all(r["whitened"] is None for r in line if r["component"] == 2)
