"""Table functions: content operations of any bytes, in SQL by LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagequarry.sources.scan import SCHEMAS, operation_rows
from pagequarry.workspace import ship

_COLUMNS = SCHEMAS["content_ops"].split(", ", 1)[1]


class ContentOperations:
    """Operations of a content stream: op_index, operator, offset, operands, image, error."""

    def eval(self, content: bytes | None) -> Iterator[tuple]:
        yield from operation_rows(content or b"")


def register(spark: SparkSession) -> None:
    """Make ``content_operations(bytes)`` known to SQL, as in ``FROM t, LATERAL content_operations(t.content)``."""
    ship(spark)
    # with Arrow each call's few rows are a table of their own, which takes many times what reading the content does
    spark.udtf.register("content_operations", F.udtf(ContentOperations, returnType=_COLUMNS, useArrow=False))
