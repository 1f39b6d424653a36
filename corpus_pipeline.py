"""Corpus pipeline: from raw documents to token ids, one operator after the other.

Every stage takes what its predecessor kept and works on all of it.  Documents
keep all their columns until the last stage, which returns what was encoded.

Defined results: null texts are empty texts and fall to the first stage; rows
that repeat a document share its fate; rows without an id are told apart by their
text, come after all ids where one of a group stays, and keep their null; extra
columns pass through; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontaminate, jaccard, langid, repetition
from pagequarry.llm.rows import keep_rows
from pagequarry.workspace import drop_stage, ship, stage

#: A language is believed from this posterior on; alone it hardly decides, see langid.
MIN_LANGUAGE_SCORE = 0.6


#: Ids of documents that go are broadcast up to so many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 500_000


#: Bytes of one Arrow batch: one worker serves all stages and keeps what the largest one took.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """The package in the workers, and small batches."""
    ship(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(spark.conf.get(setting)).rstrip("b")
    if given.isdigit() and int(given) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def keys_of(docs: DataFrame) -> Column:
    """A document's id; for a row without one a number from its text, larger than ids are."""
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(docs["text"], F.lit(""))), 2) + F.lit(1 << 62)
    return F.coalesce(docs["doc_id"].cast("long"), own)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(keys_of(docs).alias("doc_id"), "text")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose key is not among ``ids``, all columns as they were."""
    gone = stage(ids.select(F.col("doc_id").cast("long").alias("gone")).distinct(), "pipeline-gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, keys_of(docs) == gone["gone"], "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, in no learned language, or in a mix of them, go."""
    ready(spark)
    shared = spark.sparkContext.broadcast(langid.fit_judge(docs, "text", "lang", key=F.col("doc_id")))

    def verdicts():
        model, usual = shared.value

        def judge(texts: list[str]) -> list[bool]:
            names, scores = langid.score_block(texts, model)
            clear = langid.judge_block(texts, names, model, usual)
            return [c and s >= MIN_LANGUAGE_SCORE for c, s in zip(clear, scores, strict=True)]

        return judge

    return keep_rows(docs, verdicts)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that are too short or repeat themselves, go."""
    ready(spark)
    limits = repetition.Limits()

    def kept(text: str) -> bool:
        n, _, _, _, repeats, _, _, ok = repetition.measure(text.encode(), limits)
        return ok and n >= repetition.MIN_WORDS and 100 * repeats <= repetition.MAX_REPEAT_PERCENT * n

    return keep_rows(docs, lambda: lambda texts: [kept(t) for t in texts])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: one document of each group stays."""
    ready(spark)
    found = jaccard.link_components(texts_of(docs), n=5, num=80, den=100)
    return without(docs, found.where(F.col("component_id") != F.col("doc_id")).select("doc_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    ready(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contaminated(texts_of(docs), items).select("doc_id"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document that stayed: token ids and the text decoded from them."""
    ready(spark)
    return bpe.encode_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Encoding and naive Bayes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, step) in enumerate(STAGES[:-1]):
        kept = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if number:
            drop_stage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
