"""Cases of the reviewer's findings."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagequarry.llm import decontaminate, licenses, repetition
from tests.llm.test_operators import brute_contaminated

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")

ITALIAN = "La lingua italiana è una lingua romanza parlata principalmente in Italia e in altri paesi del mondo, con molte varietà regionali. "
RUSSIAN = "Русский язык — один из восточнославянских языков, национальный язык русского народа и один из наиболее распространённых языков мира. "


@here
def test_language_stage_rejects_foreign_mixed_and_random_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    texts = {}
    for r in docs.where("n_chars > 800").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    draw = random.Random(1)
    odd = [ITALIAN, RUSSIAN, ITALIAN * 20]
    odd += [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(30)) for _ in range(20)]
    odd += [a[:800] + " " + b[:800] for a, b in zip(texts["de"][:10], texts["en"][:10], strict=False)]
    extra = spark.createDataFrame([(9000 + k, t, None, "s", len(t)) for k, t in enumerate(odd)], docs.schema)
    left = {r["doc_id"] for r in pipeline.language_stage(spark, docs.unionByName(extra), SF).collect()}
    assert not {k for k in left if k >= 9000}
    assert len(left) >= 0.99 * docs.count()


def test_quality_stage_rejects_what_repeats(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    lines = [" ".join(word() for _ in range(4)) for _ in range(20)]
    fresh = [word() for _ in range(400)]
    pair = [w for k in range(100) for w in (["spam", "offer"] if k % 2 else fresh[k : k + 2])]
    partly = fresh[:160] + fresh[:20] + fresh[200:220]
    texts = {
        1: "\n".join(lines + draw.sample(lines, 20)),  # every line twice
        2: " ".join(pair),  # one pair of words all over
        3: " ".join(partly),  # 20% of words in repeated 8-grams
        4: " ".join(fresh),
        5: "\n".join(" ".join(fresh[k : k + 10]) for k in range(0, 400, 10)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in pipeline.quality_stage(spark, docs, SF).collect()} == {4, 5}


def test_top_share_equals_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        words = draw.choices(["a", "bb", "ccc", "dddd"], k=draw.randint(2, 30))
        for n in (2, 3, 4):
            grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            if not grams:
                continue
            best = 0
            for g in {g for g in grams if grams.count(g) > 1}:
                inside = {j for k, x in enumerate(grams) if x == g for j in range(k, k + n)}
                best = max(best, sum(len(words[j]) for j in inside))
            ids = {g: k for k, g in enumerate(sorted(set(grams)))}
            got = repetition.top_share(np.array([ids[g] for g in grams], np.uint64), n, np.array([len(w) for w in words]))
            assert got == pytest.approx(best / sum(map(len, words)))


def test_license_blocks_cross_lines(spark):
    mit = licenses.TEXTS["mit"].split()
    texts = {
        1: "Some words.\nLicensed under the Apache License,\nVersion 2.0\nmore",
        2: "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted",
        3: "\n".join(" ".join(mit[k : k + 7]) for k in range(0, len(mit), 7)),
        4: "Released under the\n MIT License",
        5: "This library is licensed under the GNU Lesser\nGeneral Public License, version 3",
        6: "Licensed under CC BY 4.0",
        7: "apache " + "word " * 60 + "licensed under the license version 2 0",
        8: None,
        9: "This library is licensed under the GNU Lesser General Public License, version 3. " + "x " * 40 + licenses.TEMPLATES["gpl-3.0"],
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    labels = {k: r["labels"] for k, r in got.items()}
    assert labels == {1: "apache-2.0", 2: "bsd", 3: "mit", 4: "mit", 5: "gpl,lgpl-3.0", 6: "cc-by", 7: "", 8: "", 9: "gpl,gpl-3.0,lgpl-3.0"}
    assert got[1]["block_word"] == 2 and got[1]["score"] == 1.0
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_contamination_with_a_repeated_tail(spark):
    draw = random.Random(4)
    items, docs = [], []
    for k in range(3):
        words = [f"w{draw.randrange(10**6)}" for _ in range(500)]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join(["before", *words[:446], *["x"] * 54, "after"])))
        docs.append((10 + k, " ".join(["before", *words[:444], *["x"] * 56, "after"])))
    expected = brute_contaminated(docs, items)
    assert expected == {(k, k) for k in range(3)}
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(*tables).collect()} == expected


def test_copies_of_a_shingle_have_their_own_hashes(spark):
    rows = spark.createDataFrame([([5, 3, 5, 5],), ([3, 5],), ([],)], "h array<bigint>")
    a, b, c = [r["o"] for r in rows.select(decontaminate.occurrences(F.col("h")).alias("o")).collect()]
    assert len(set(a)) == 4 and {3, 5} <= set(a) and b == [3, 5] and c == []


def test_radius_is_a_bound():
    draw = np.random.default_rng(5)
    for a, b, shared in ((30, 30, 27), (9, 11, 9), (1, 1, 1), (126, 126, 112)):
        x, y, z = (draw.integers(0, 2, (20_000, n)).sum(axis=1) for n in (shared, a - shared, b - shared))
        seen = np.mean((2 * (x + y) > a) != (2 * (x + z) > b))
        assert abs(seen - decontaminate.differing_chance(a, b, shared)) < 0.02
    assert len(decontaminate.radii()) == decontaminate.EXACT_SHINGLES + 2


def test_pipeline_returns_token_ids(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = pipeline.encoding_stage(spark, docs, SF).first()
    assert len(np.frombuffer(row["ids"], "<u4")) == row["n_tokens"] and row["decoded"] == "some words here"
