"""Filtering whole rows by a verdict on their text, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.bpe import blocks
from pagequarry.workspace import tidy


def keep_rows(docs: DataFrame, verdicts: Callable[[], Callable[[list[str]], list[bool]]], text_col: str = "text") -> DataFrame:
    """Rows whose text is kept, all columns as they were; a null text is judged as the empty text.

    ``verdicts`` makes, once per task, the function that judges a block of texts.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdicts()
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            mask: list[bool] = []
            for part in blocks(texts):
                mask += judge(texts[part])
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def label_shares(counts: dict, quota: dict) -> dict:
    """For each label the bound on a 63-bit hash below which about ``quota`` of its ``counts`` rows lie.

    ``counts``: label to number of rows and least hash.  The row with the least
    hash is always below the bound, so a label with rows never goes without.
    """
    return {k: max(least, (quota[k] << 63) // n if quota[k] < n else (1 << 63) - 1) for k, (n, least) in counts.items()}


def quota_sample(rows: DataFrame, counts: dict, quota: dict, label_col: str, hash_col: str) -> DataFrame:
    """Rows of each label, ``quota`` of them about, by their 63-bit hash."""
    bounds = label_shares(counts, quota)
    if not bounds:
        return rows.where("false")
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col(label_col))
    return rows.where(F.col(hash_col) <= limit)


def hash63(*columns: Column) -> Column:
    """A hash from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)
