"""Exact deduplication: sorted runs of digests merged in binomial rounds between partitions.

Texts are equal when they are identical after all ASCII white space is deleted.

1.  Digests.  Every row gets the SHA-256 of its normalised text, its number of
    code points and a number of its own; this table is written, without texts.
2.  Runs.  Each task sorts its rows and folds equal digests into one entry: how
    many rows, and the best of them.  Copies, a hot group too, are one entry a
    run from here on.
3.  Rounds.  There are ``FAN ** rounds`` places.  A run starts at the place its task
    has; a digest ends at the place of its first bits.  In round r the ``FAN``
    places that differ in digit r alone exchange entries, each keeping those whose
    end has its own digit.  For one end these steps are the binomial tree rooted
    there (``FAN`` is a power of two, so a round is several binomial steps taken
    as one wider merge), and the trees of all ends run side by side: no place is a
    root for everything, and each holds its share only.
4.  Merge.  Arriving runs are merged in digest order by Spark's sort, which
    spills, and a pass folds neighbours.  Entries meet only if all 32 bytes of the
    digest, and the length of the normalised text beside it, agree; the best row
    stays at every level.
5.  Answers go back in two hops: to each run's entries, of which a digest has one a
    run, then to the run's rows by (run, digest).  No key holds more rows than a
    task has read.

Of equal texts the row with the most code points stays, then that with the
smallest id, then the first in the order of reading.

Defined results: a null text is empty and equals all texts of white space; a null
id is larger than any other, and stays only where no other row is as long; of rows
that repeat an id exactly one is kept; an empty table gives an empty result; other
columns are not read, whatever their names.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.workspace import stage

#: Runs that meet in one merge: 2^FAN_BITS, that is FAN_BITS binomial steps a round.
FAN_BITS = 3
#: Rows for which one more place is worth having; an entry takes some 80 bytes.
PLACE_ROWS = 500_000
#: Code points of ASCII white space (fixed values).
SPACES = "\t\n\x0b\x0c\r "
_ENTRY = "digest binary, bytes long, place long, n long, chars long, id long, row long"
#: Entries handed on at a time.
_BATCH = 20_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def rounds_for(rows: int, place_rows: int = PLACE_ROWS, bits: int = FAN_BITS) -> int:
    """Rounds after which a place holds about ``place_rows`` entries; two at least."""
    rounds = 2
    while (1 << bits * rounds) * place_rows < rows:
        rounds += 1
    return rounds


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, row) the one that stays."""
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return a if order(a) <= order(b) else b


def fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in digest order with equal neighbours made one; one batch is held at a time."""
    schema = None
    key = best = None
    place = count = 0
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for digest, size, at, n, chars, own_id, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (chars, own_id, row)
            if (digest, size) == key:
                count, best = count + n, _better(best, own)
                continue
            if key is not None:
                out.append((*key, place, count, *best))
                if len(out) >= _BATCH:
                    yield packed()
                    out.clear()
            key, place, count, best = (digest, size), at, n, own
    if key is not None:
        out.append((*key, place, count, *best))
        yield packed()


def _folded(entries: DataFrame) -> DataFrame:
    return entries.sortWithinPartitions("digest", "bytes").mapInArrow(fold_sorted, _ENTRY)


def end_of(digest: Column, places_bits: int) -> Column:
    """The place where a digest ends: its first bits."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long").bitwiseAND(F.lit((1 << places_bits) - 1))


def merge_round(runs: DataFrame, r: int, total_bits: int, bits: int = FAN_BITS) -> DataFrame:
    """One round: entries move to the place that has digit ``r`` of their end, and are merged there."""
    digit = F.lit(((1 << bits) - 1) << bits * r)
    end = end_of(F.col("digest"), total_bits)
    moved = F.col("place").bitwiseAND(F.bitwise_not(digit)).bitwiseOR(end.bitwiseAND(digit))
    return _folded(runs.withColumn("place", moved).repartitionById(1 << total_bits, F.col("place").cast("int")))


def merge_runs(runs: DataFrame, rounds: int, bits: int = FAN_BITS) -> DataFrame:
    """Entries of all runs merged into one for each digest, spread over ``2 ** (bits * rounds)`` places."""
    for r in range(rounds):
        runs = merge_round(runs, r, bits * rounds, bits)
    return runs


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    text = F.col(text_col)
    digests = stage(
        docs.select(F.col(id_col).cast("long").alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"), normalised(text).alias("own"))
        .select("id", "chars", F.unhex(F.sha2(F.col("own").cast("binary"), 256)).alias("digest"), F.octet_length("own").cast("long").alias("bytes"))
        .withColumn("row", F.monotonically_increasing_id())
        # the task that read a row is in the upper bits of its number
        .withColumn("run", F.shiftright("row", 33)),
        "dedup-digests",
    )
    rounds = rounds or rounds_for(digests.count())
    places = 1 << FAN_BITS * rounds
    single = digests.select("digest", "bytes", F.col("run").alias("place"), F.lit(1).cast("long").alias("n"), "chars", "id", "row")
    # a task may read several runs; each place keeps to one of them
    runs = stage(single.sortWithinPartitions("place", "digest", "bytes").mapInArrow(fold_runs, _ENTRY), "dedup-runs")
    start = F.pmod(F.col("place"), F.lit(places))
    merged = merge_runs(runs.withColumn("place", start), rounds)
    best = merged.select("digest", "bytes", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    # one row a run and digest; a run that two tasks read in parts has two, which are one here
    heads = runs.select(F.col("place").alias("run"), "digest", "bytes").repartition("digest", "bytes").distinct()
    answers = heads.join(best, ["digest", "bytes"])
    return digests.join(answers, ["run", "digest", "bytes"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of run and digest, folded within each run."""
    held: list[pa.RecordBatch] = []
    run = None
    for batch in batches:
        places = batch.column("place").to_pylist()
        start = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] != places[start]:
                if run is not None and places[start] != run:
                    yield from fold_sorted(iter(held))
                    held = []
                run = places[start]
                held.append(batch.slice(start, k - start))
                start = k
    yield from fold_sorted(iter(held))
