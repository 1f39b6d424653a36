"""The pipeline's stages against brute force on a small table."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagequarry.llm import bpe
from tests.llm.test_operators import brute_components, brute_contaminated, brute_repetition

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).withColumn("extra", F.lit(None).cast("int"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(9001, None, None, None, None, 1), (9002, "12 34", "en", "s", 5, None)], docs.schema)
    docs = docs.unionByName(odd).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in pipeline.STAGES[:-1]:
        kept = step(spark, docs, SF).cache()
        assert kept.columns == docs.columns
        left = {r["doc_id"] for r in kept.collect()}
        before = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert before - left == {9001, 9002}
        if name == "quality_rules":
            base = {k: brute_repetition(texts[k]) for k in before}
            failed = {k for k, m in base.items() if m[0] < 20 or 100 * m[4] > 30 * m[0]}
            assert failed <= before - left and len(before - left - failed) <= 0.02 * len(before)
        if name == "near_copies":
            parts = brute_components([(k, texts[k]) for k in before], 5, 80, 100)
            assert left == {k for k in before if parts[k][1] == k}
        if name == "decontamination":
            assert before - left == {d for d, _ in brute_contaminated([(k, texts[k]) for k in before], items)}
        docs = kept
    out = {r["doc_id"]: r["n_tokens"] for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    own = bpe.load(bpe.TOKENIZER)
    assert out == {k: len(own.slow.encode(texts[k], add_special_tokens=False).ids) for k in left}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, step in pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0


def test_rows_without_an_id_take_part(spark):
    """A near copy without an id goes, one that is alone stays, and one that holds an item goes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = docs.where("length(text) > 600").limit(3).select("doc_id", "text").collect()
    item = items.where("length(text) > 150").first()["text"]
    rows = [(r["doc_id"], r["text"]) for r in own[:2]] + [(None, own[0]["text"]), (None, own[2]["text"]), (None, f"{own[1]['text'][::-1]} {item}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    alone = pipeline.near_copy_stage(spark, table, SF)
    left = [(r["doc_id"], r["text"]) for r in alone.collect()]
    assert sorted(left, key=str) == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)
    clean = [(r["doc_id"], r["text"]) for r in pipeline.decontamination_stage(spark, table, SF).collect()]
    assert rows[4] not in clean and rows[3] in clean
