"""Whitening of embeddings by shifted Cholesky QR.

Each entry c of a vector becomes the whole number x = floor(64 * c) + 1,000,000. The fit list is every distinct
x vector once: n vectors with sums S. Rows are centred before anything is multiplied, exactly: n * x - S in whole
numbers, then divided by n.

A pass sends every centred row through the triangular solves of the factors so far and sums the Gram matrix of
what comes out: each task sums its rows, Spark adds the tasks' cells, and d * d sums reach the driver, whatever
the number of rows. The driver factors the Gram matrix (Cholesky), and the factor joins the next pass's solves. The first
Gram matrix, whose condition is that of the rows squared, gets a small shift on its diagonal; the rows that leave the
first pass are well conditioned, so after ``PASSES`` passes they are orthonormal. The product R of the factors holds
the rows' singular values and right singular vectors, which its decomposition gives without ever squaring it.

A row takes part if its vector is not null and holds no null or non-finite entry; others are left out of the result too.
Vectors shorter than the longest count as ended with zero entries. Entries beyond ``RANGE`` are an error, as
their whole numbers would not be exact. Directions without variance (constant or dependent dimensions, fewer rows than
dimensions) come last, with explained 0 and whitened null; a later Gram matrix that is not positive is
shifted as well. ``deviation`` is null where it exceeds 64 bits. Repeated rows and ids all get their result; a null id is kept.
An empty table, or only empty vectors, give no rows. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import frugal, materialise, rows

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
PASSES = 3
RANGE = float(1 << 40)
_NULL_BELOW = 1e-11  # singular values against the largest


class Model(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # dimension, component
    variance: np.ndarray  # of every component
    total: float  # trace of the covariance
    identity_error: float | None


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """All columns of the rows that take part, as a struct ``row``, and their ``x``."""
    entry = lambda c: F.when(F.abs(c.cast("double")) <= RANGE, F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + OFFSET).otherwise(F.raise_error(F.lit("an entry is out of range")))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vector).isNotNull()).where(fine).select(F.struct("*").alias("row"), F.transform(vector, entry).alias("x"))


def padded(x: Column, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size(x)))


def _table(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_CELLS = pa.schema([("cell", pa.int32()), ("value", pa.float64())])
_SUMS = pa.schema([("cell", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_LOW = 1 << 24


def _column_sums(width: int):
    """Exact sums by dimension, in two halves so that no partial sum outgrows 64 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
        for batch in batches:
            table = _table(batch.column(0), width)
            high[:width] += (table >> 24).sum(axis=0)
            low[:width] += (table & (_LOW - 1)).sum(axis=0)
            low[width] += len(table)
        yield rows(_SUMS, np.arange(width + 1), low, high)

    return add


def centred(table: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact n * x - S."""
    if n * (int(np.abs(table).max(initial=0)) + 1) < 1 << 62:
        return (n * table - np.array(sums, np.int64)) / float(n)
    return ((n * table.astype(object) - np.array(sums, object)) / n).astype(float)


def deviations(table: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S) ** 2 of each row, exact; None beyond 64 bits."""
    if n * (int(np.abs(table).max(initial=0)) + 1) < 1 << 62:
        off = n * table - np.array(sums, np.int64)
        if float(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) < 2.0 ** 62:
            return (off * off).sum(axis=1).tolist()
    off = n * table.astype(object) - np.array(sums, object)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def solved(table: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor in turn."""
    for r in factors:
        table = np.linalg.solve(r.T, table.T).T
    return table


def _gram(width: int, transform):
    """The Gram matrix of what ``transform`` makes of the x vectors, one row a cell."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            made = transform(batch.column(0))
            total += made.T @ made
        yield rows(_CELLS, np.arange(width * width), total.ravel())

    return add


def gram(fit: DataFrame, width: int, transform) -> np.ndarray:
    cells = fit.mapInArrow(frugal(_gram(width, transform)), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * width)
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    out = out.reshape(width, width)
    return (out + out.T) / 2


def shift(g: np.ndarray, n: int) -> float:
    """The shift that keeps the factorisation of a Gram matrix with rounding errors positive."""
    d = len(g)
    return 11 * (n * d + d * (d + 1)) * 2.0 ** -53 * max(float(np.linalg.norm(g, 2)), 1e-300)


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper triangular factor of a Gram matrix."""
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:  # directions without variance
            pass
    return np.linalg.cholesky(g + shift(g, n) * np.eye(len(g))).T


def fitted(x: DataFrame, width: int, components: int = COMPONENTS, passes: int = PASSES) -> Model | None:
    """Fit on the distinct vectors of ``x`` (one column of arrays of ``width`` whole numbers)."""
    if not width:
        return None
    fit = materialise(x.distinct())
    sums = fit.mapInArrow(frugal(_column_sums(width)), "cell int, low long, high long").groupBy("cell").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high"))).collect()
    total = {r["cell"]: int(r["low"]) + (int(r["high"]) << 24) for r in sums}
    n = total.get(width, 0)
    if not n:
        return None
    means = [total[i] for i in range(width)]
    factors: list[np.ndarray] = []
    for k in range(passes):
        known = list(factors)
        g = gram(fit, width, lambda column: solved(centred(_table(column, width), n, means), known))
        if not k and not g.any():  # all vectors equal
            return Model(n, means, np.eye(width), np.zeros(width), 0.0, None)
        factors.append(factor(g, n, not k))
    r = np.eye(width)
    for part in factors:
        r = part @ r
    _, singular, right = np.linalg.svd(r)
    singular = np.where(singular > _NULL_BELOW * singular[0], singular, 0.0)
    axes = right.T * np.where(right[np.arange(width), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)
    variance = singular ** 2 / n
    k = int((variance[:components] > 0).sum())
    model = Model(n, means, axes, variance, float(variance.sum()), None)
    check = gram(fit, k, lambda column: projected(_table(column, width), model, k)) / n
    return model._replace(identity_error=float(np.abs(check - np.eye(k)).max()))


def projected(table: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Whitened rows: the first ``k`` components, each of variance one."""
    return centred(table, model.n, model.sums) @ (model.axes[:, :k] / np.sqrt(model.variance[:k]))


_OUT = pa.schema([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error): for every row that takes part, as a
    struct ``row`` of its columns, its components from 1."""
    part = whole(vectors, vector)
    width = part.agg(F.max(F.size("x"))).first()[0] or 0
    part = part.withColumn("x", padded(F.col("x"), width))
    model = fitted(part.select("x"), width, components)
    schema = part.schema
    ddl = "row " + schema["row"].dataType.simpleString()
    if model is None:
        facts = ", component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], ddl + facts)
    some = min(components, width)
    k = int((model.variance[:some] > 0).sum())
    explained = (model.variance[:some] / model.total).tolist() if model.total else [None] * some

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch.column(1), width)
            made = projected(table, model, k)
            flat = pa.array(np.column_stack([made, np.full((len(table), some - k), np.nan)]).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(table) * some + 1, some), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(table, model.n, model.sums), pa.int64()), lists], names=["row", "deviation", "whitened"])

    done = part.select("row", "x").mapInArrow(frugal(apply), f"{ddl}, deviation long, whitened array<double>")
    each = done.select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*(F.lit(v).cast("double") for v in explained))
    return each.select("row", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
