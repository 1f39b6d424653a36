"""Whitening of embeddings by an exact polarisation covariance.

1.  Entries become whole numbers, ``x = floor(1024 * c) + 100000``.
2.  A first pass sums every dimension: ``n`` vectors with sums ``S``.
3.  A second pass aggregates squares of centred values, for every dimension and for
    the sum of every pair of dimensions.  A value is centred on the whole part of its
    mean, ``y = x - S div n``, before it is multiplied, so squares stay small; with
    the remainder ``r = S - n * (S div n)`` the exact sum of ``(n * x - S) ** 2`` is
    ``n * n * sum(y * y) - n * r * r``, in whole numbers of any size.
4.  Polarisation: the covariance of two dimensions is half of what the variance of
    their sum exceeds their variances by; each entry is one division of whole numbers.
5.  The matrix, as large as the number of dimensions alone demands, goes through
    ``eigh``; rows are projected in tasks, and a last pass measures the covariance of
    what came out.

Tasks return sums only, a row for each dimension or pair of a task.

Defined results: rows with a null vector, or with null or non-finite entries, are
dropped, and so are rows with an entry beyond 64 bits, and rows whose number of
entries is not the commonest one (of equally common ones the largest): they lack
entries or hold unknown ones.  Repeated rows count as often as they occur; ids may
be null or repeat.  A direction without variance (eigenvalue 0 to double precision)
has no unit variance to be brought to: ``whitened`` is null there and ``explained``
0, and ``identity_error`` is over the other components.  A table without a remaining
row gives none.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.workspace import stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_BIG = "decimal(38,0)"
_MOST = 1 << 63
#: Pair sums that are taken at a time, 8 bytes each.
BLOCK_SUMS = 4 << 20


def whole_numbers(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that remain, and their entries as whole numbers."""
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == dims)
    flat = pc.list_flatten(vectors.take(pa.array(places))).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        good = (np.isfinite(scaled) & (np.abs(scaled) < _MOST - 2 * SHIFT - 1024)).all(axis=1)
    return places[good], scaled[good].astype(np.int64) + SHIFT


def exact_sums(block: np.ndarray) -> list[int]:
    """Column sums of whole numbers, exact whatever their size."""
    if not len(block):
        return [0] * block.shape[1]
    most = max(abs(int(block.max())), abs(int(block.min())))
    return [int(v) for v in (block if most * len(block) < _MOST else block.astype(object)).sum(axis=0)]


def squares(block: np.ndarray) -> list[int]:
    """Column sums of squares, exact whatever their size."""
    if not len(block):
        return [0] * block.shape[1]
    most = max(abs(int(block.max())), abs(int(block.min())))
    wide = block if most * most * len(block) < _MOST else block.astype(object)
    return [int(v) for v in (wide * wide).sum(axis=0)]


def centred(x: np.ndarray, whole: list[int]) -> np.ndarray:
    """Entries less the whole parts of their means; in Python's numbers where 64 bits do not hold them."""
    near = np.array(whole, dtype=np.int64)
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 61:
        return x.astype(object) - near.astype(object)
    return x - near


def _commonest_size(rows: DataFrame) -> int:
    usable = rows.where("v is not null").where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    sizes = usable.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return sizes["size"] if sizes else 0


def moments(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of remaining rows and exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            n += len(x)
            sums = [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        yield _sum_rows([-1, *range(dims)], [0] * (dims + 1), [n, *sums])

    found = rows.select("v").mapInArrow(run, f"i int, j int, s {_BIG}").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in found}
    return by.get(-1, 0), [by.get(k, 0) for k in range(dims)]


def _sum_rows(i: list[int], j: list[int], sums: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], names=["i", "j", "s"])


def covariance(rows: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor ``n``, each entry the double nearest to the exact one."""
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    first, second = np.triu_indices(dims, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs = [0] * dims, [0] * len(first)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            y = centred(x, whole)
            step = max(1, BLOCK_SUMS // max(1, len(first)))
            for k in range(0, len(y), step):
                part = y[k : k + step]
                own = [a + b for a, b in zip(own, squares(part), strict=True)]
                pairs = [a + b for a, b in zip(pairs, squares(part[:, first] + part[:, second]), strict=True)]
        yield _sum_rows([*range(dims), *first.tolist()], [*range(dims), *second.tolist()], [*own, *pairs])

    found = rows.select("v").mapInArrow(run, f"i int, j int, s {_BIG}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    by = {(r["i"], r["j"]): int(r["s"]) for r in found}
    # exact sums of squares of n * x - S, and of their pairwise sums
    own = [n * n * by[k, k] - n * rest[k] ** 2 for k in range(dims)]
    out = np.zeros((dims, dims))
    for k in range(dims):
        out[k, k] = own[k] / n**3
    for a, b in zip(first.tolist(), second.tolist(), strict=True):
        both = n * n * by[a, b] - n * (rest[a] + rest[b]) ** 2
        out[a, b] = out[b, a] = (both - own[a] - own[b]) / (2 * n**3)
    return out


def components_of(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order].T
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    floor = len(v) * np.finfo(float).eps * max(values[0], 0.0)
    return np.where(values > floor, values, 0.0), vectors * signs[:, None]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation (decimal), whitened, explained and identity_error of every remaining row."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()
    columns = f"{id_col} {id_type}, component int, n bigint, deviation {_BIG}, whitened double, explained double, identity_error double"
    dims = _commonest_size(rows)
    n, sums = moments(rows, dims) if dims else (0, [])
    if not n:
        return spark.createDataFrame([], columns)
    v = covariance(rows, dims, n, sums)
    values, vectors = components_of(v, components)
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    known = values > 0
    weights = vectors * np.where(known, 1 / np.sqrt(np.where(known, values, 1.0)), np.nan)[:, None]
    trace = float(np.trace(v))
    explained = values / trace if trace > 0 else np.zeros(len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            places, x = whole_numbers(batch.column(1), dims)
            y = centred(x, whole)
            most = max(abs(int(y.max())), abs(int(y.min()))) + 1 if len(y) else 0
            fits = (n * most) ** 2 * dims < _MOST
            full = (y if fits else y.astype(object)) * n - np.array(rest, dtype=np.int64 if fits else object)
            deviation = [Decimal(int(s)) for s in (full * full).sum(axis=1)]
            # centred exactly up to the last step: y and r / n
            white = (y.astype(float) - np.array(rest) / n) @ weights.T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places)), pa.array(deviation, pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64()))],
                names=["id", "deviation", "white"],
            )

    done = stage(rows.mapInArrow(run, f"id {id_type}, deviation {_BIG}, white array<double>"), "whitening")
    error = identity_error(done, np.flatnonzero(known).tolist())
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return done.select("id", "deviation", F.posexplode("white").alias("k", "w")).select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get(shares, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(done: DataFrame, known: list[int]) -> float:
    """Largest absolute entry of the covariance of what was whitened, less the identity."""
    pairs = [(a, b) for a in known for b in known if a <= b]
    if not pairs:
        return 0.0
    at = lambda k: F.get("white", k)
    found = done.agg(*[F.covar_pop(at(a), at(b)).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
