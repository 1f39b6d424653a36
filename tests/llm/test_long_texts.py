"""Long and adversarial texts: time grows with length, results equal those of plain loops."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from pagequarry.llm import licenses, repetition, toxicity


def taken(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def known_templates():
    texts = licenses.all_templates()
    return licenses.Templates(texts, sorted({w for _, t in texts for w in licenses.words_of(t.encode())}))


def plain_match(templates, words):
    """Every block of a label against all blocks of the others."""
    found = sorted(templates.blocks(words), key=lambda x: (-x[1], x[2], x[3]))
    best = {}
    for label, share, a, b in found:
        if label not in best and not any(x != label and s > share and a <= d and c <= b for x, s, c, d in found):
            best[label] = (share, a)
    return best


def test_overlapping_licenses_equal_plain_loops():
    draw, templates = random.Random(1), known_templates()
    texts = [licenses.words_of(t.encode()) for _, t in licenses.all_templates()]
    for _ in range(60):
        words = []
        for _ in range(draw.randint(1, 6)):
            own = list(draw.choice(texts))
            if draw.random() < 0.5 and len(own) > 12:
                del own[draw.randrange(len(own))]
            words += own + [b"x"] * draw.choice([0, 0, 1, 5])
        assert templates.match(words) == plain_match(templates, words)


def test_repeated_notices_take_linear_time():
    templates, grant = known_templates(), licenses.words_of(licenses.TEXTS["gpl-3.0"].encode())
    words = grant * (200_000 // len(grant))
    assert taken(lambda: templates.match(words)) < 6
    assert "gpl-3.0" in templates.match(grant * 50)


def test_runs_of_words_take_linear_time():
    for text in (" ".join(f"w{k // 4}" for k in range(200_000)), " ".join(f"w{k % 7}" for k in range(200_000))):
        assert taken(lambda: repetition.measure(text.encode(), repetition.Limits())) < 6  # noqa: B023


def test_range_maxima():
    draw = np.random.default_rng(4)
    values = draw.random(50)
    a = draw.integers(0, 50, 300)
    b = np.minimum(49, a + draw.integers(0, 50, 300))
    assert licenses.range_max(values, a, b).tolist() == [values[x : y + 1].max() for x, y in zip(a, b, strict=True)]


def test_one_huge_labelled_text_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_CHARS", 20_000)
    draw = random.Random(6)
    some = lambda n: " ".join("".join(draw.choices("aeioumnrst", k=5)) for _ in range(n))
    rows = [(k, some(12) + " vilefool " * (k % 3 == 0) + some(12)) for k in range(60)] + [(100, some(40_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0 and k < 100)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.weights
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert min(scores[k] for k in range(0, 60, 3)) > 0.7 > max(scores[k] for k in range(60) if k % 3)


def test_shares_of_characters():
    assert toxicity.longest_share([5, 5, 5], 15) == 5
    assert toxicity.longest_share([1, 2, 100], 33) == 30
    assert toxicity.longest_share([100, 100], 50) == 25
    assert toxicity.longest_share([], 50) == 0


def test_pieces_come_from_all_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 4)
    rows = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz",), ("short",)], "text string")
    got = [r[0] for r in rows.select(toxicity.stretches_of(F.col("text"), 12)).collect()]
    assert got == ["abcd\nlmno\nwxyz", "short"]
