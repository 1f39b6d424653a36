"""Branching reply trees against an enumeration of all paths; clashing columns and repeated rows for every operator on texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagequarry.llm import bpe, chat, decontaminate, jaccard, langid, licenses, repetition, toxicity


def best_paths(messages, top_k):
    """(tree, root, leaf, rank, texts) of the best paths of each root, by trying all."""
    kids, keys, found = {}, {(t, n) for t, n, *_ in messages}, {}
    info = {(t, n): (p, role, text, score) for t, n, p, role, text, score in messages}
    for (t, n), (p, *_) in info.items():
        if p is not None and (t, p) in keys and p != n:
            kids.setdefault((t, p), []).append(n)

    def down(t, n, path, score):
        path, score = [*path, n], score + (info[t, n][3] or 0.0)
        if (t, n) not in kids:
            found.setdefault((t, path[0]), []).append((-score, n, path))
        for k in kids.get((t, n), ()):
            down(t, k, path, score)

    for (t, n), (p, *_) in info.items():
        if p is None or (t, p) not in keys or p == n:
            down(t, n, [], 0.0)
    return {(t, root, leaf, rank + 1, tuple((info[t, n][1], info[t, n][2]) for n in path)) for (t, root), own in found.items() for rank, (_, leaf, path) in enumerate(sorted(own)[:top_k])}


@pytest.mark.parametrize("top_k", [1, 3])
def test_branching_trees_equal_all_paths(spark, top_k):
    draw = random.Random(top_k)
    messages = []
    for tree in range(12):
        for node in range(1, draw.randint(2, 30)):
            parent = draw.choice([None, 999, *range(1, node)]) if node > 1 and draw.random() < 0.15 else (max(1, node - draw.randint(1, 4)) if node > 1 else None)
            messages.append((tree, node, parent, draw.choice(["user", "assistant"]), draw.choice(["hi", "</s>", "a\\b", ""]) + str(node), draw.choice([0.0, 0.5, 1.0, -1.0])))
    rows = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    out = chat.format_chats(rows, top_k=top_k).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {(r["tree"], r["root"], r["leaf"], r["rank"], tuple((t["role"], t["text"]) for t in r["turns"])) for r in out.collect()}
    assert got == best_paths(messages, top_k)


CLASH = {c: "x" for c in ("id", "n", "h", "size", "shard", "score", "spans", "labels", "label", "piece", "pieces", "row", "words", "n_words", "n_tokens", "n_bytes", "kept", "lang_pred", "component_id", "item", "doc", "ws", "anchors", "known", "block_word", "h1")}
TEXTS = ["the quick brown fox jumps over the lazy dog again and again " * 3, "Licensed under the MIT License", "", None, "été naïve words here " * 8]


def documents(spark, clash):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit(v) for c, v in CLASH.items()}) if clash else docs


OPERATORS = {
    "op2": lambda docs: bpe.count_tokens(docs),
    "op4": lambda docs: toxicity.score_documents(docs, toxicity.Crf({"wfox": 40.0})),
    "op5": lambda docs: repetition.repetition_rules(docs),
    "op6": lambda docs: langid.identify(docs, langid.fit(docs.select("text", F.when(F.col("text").contains("quick"), "en").otherwise("fr").alias("lang")), "text", "lang")),
    "op7": lambda docs: licenses.scan_licenses(docs),
    "op8": lambda docs: bpe.encode_documents(docs, digests=True),
    "op9": lambda docs: jaccard.link_components(docs, n=3, num=90, den=100),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_that_clash_and_rows_that_repeat(spark, name):
    """Extra columns change nothing; a row that occurs twice has its result twice."""
    shown = lambda rows: Counter(str(r.asDict()) for r in rows)
    plain, clashing = OPERATORS[name](documents(spark, False)).collect(), OPERATORS[name](documents(spark, True)).collect()
    assert shown(plain) == shown(clashing)
    by_id = Counter(r["doc_id"] for r in plain)
    assert by_id[0] == by_id[3] and len({str(r) for r in plain if r["doc_id"] == 0}) == 1 and set(by_id) == set(range(len(TEXTS)))


def test_clashing_columns_of_documents_and_items(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    rows = decontaminate.contaminated(documents(spark, True), items).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in rows} == {(0, 1, 1.0)}
