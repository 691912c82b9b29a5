"""Embedding whitening from the covariance of distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import put_down, scope
from wardline.llm.vectors import floored, matrix, whole_vectors

#: Rows of a matrix product in a task.
CHUNK = 8192


class Whitening(NamedTuple):
    """A fitted transform: ``z = (n * x - sums) @ axes / n``, the axes already divided by the square roots of ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float


def distinct_vectors(rows: DataFrame, weight: str = "count") -> DataFrame:
    """``x, weight``: the distinct vectors ``x`` with their number of rows, or one each; copies fold before the shuffle."""
    grouped = rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    return grouped if weight == "count" else grouped.select("x", F.lit(1).cast("long").alias("weight"))


def _totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight, and the exact weighted sum of each dimension; every task sends one number for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column(0)), batch.column(1).to_numpy()
                bound = int(np.abs(x).max()) * int(w.max()) * len(w)
                part = w @ x if bound < 1 << 62 else w.astype(object) @ x.astype(object)
                n, sums = n + int(w.sum()), part.astype(object) + (0 if sums is None else sums)
        if sums is not None:
            values = pa.array([str(v) for v in (n, *sums)])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), values], ["i", "part"])

    parts = distinct.select("x", "weight").mapInArrow(run, "i int, part string")
    total = parts.groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("i").collect()
    return (int(total[0]["total"]), [int(r["total"]) for r in total[1:]]) if total else (0, [])


def _moments(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the ``i, j, part`` entries that tasks send: row -1 a vector, the other rows a matrix.

    Entries are summed by Spark; the driver gets a matrix of the vectors' length, however many rows and tasks there are.
    """
    total = {(r["i"], r["j"]): r["total"] for r in parts.groupBy("i", "j").agg(F.sum("part").alias("total")).collect()}
    d = 1 + max(j for _, j in total)
    return np.array([total[-1, j] for j in range(d)]), np.array([[total[i, j] for j in range(d)] for i in range(d)])


def _entries(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    d = len(first)
    i, j = np.repeat(np.arange(-1, d), d), np.tile(np.arange(d), d + 1)
    parts = np.concatenate([first, second.ravel()])
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(parts)], ["i", "j", "part"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``; the whole part of the mean is taken off exactly first."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance of centred vectors, divisor ``n``: one matrix product a chunk, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = np.zeros((len(sums), len(sums))), False
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                y, w = _centred(matrix(part.column(0)), n, sums), part.column(1).to_numpy().astype(np.float64)
                gram += y.T @ (w[:, None] * y)
                seen = True
        if seen:
            yield _entries(np.zeros(len(sums)), gram)

    _, gram = _moments(distinct.select("x", "weight").mapInArrow(run, "i int, j int, part double"))
    return (gram + gram.T) / (2 * n)


def fit(distinct: DataFrame, components: int = 32) -> Whitening | None:
    """The transform to at most ``components`` components of ``distinct`` (``x, weight``), None without vectors.

    Components run by falling eigenvalue; of the two unit vectors of a component that with a positive largest entry is
    used.  One without variance, as far as doubles tell, has a NaN axis.
    """
    n, sums = _totals(distinct)
    if not n:
        return None
    covariance = _covariance(distinct, n, sums)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    real = values > len(sums) * np.finfo(float).eps * max(values.max(), 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        axes = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    return Whitening(n, sums, np.where(real, values, 0.0), axes, float(np.trace(covariance)))


def whiten(distinct: DataFrame, model: Whitening) -> DataFrame:
    """``x, weight, deviation, whitened`` for every row of ``distinct``; ``whitened`` lists the components in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, axes = model.n, model.sums, model.axes
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = matrix(part.column(0))
                # n * x - S, with the whole part of the mean taken off x first
                near, rest = (np.array([f(s, n) for s in sums], np.int64) for f in (int.__floordiv__, int.__mod__))
                away = x - near
                spread = (n * int(np.abs(away).max()) + n) ** 2 * len(sums)
                away = away.astype(np.int64 if spread < 1 << 63 else object) * n - rest
                deviation = pa.array((away * away).sum(axis=1).tolist(), pa.int64())
                z = _centred(x, n, sums) @ axes
                flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), deviation, lists], ["x", "weight", "deviation", "whitened"])

    return distinct.select("x", "weight").mapInArrow(run, "x array<long>, weight long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    real = np.flatnonzero(model.values > 0)
    if not len(real):
        return 0.0

    def moments(mean: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, seen = np.zeros(len(real)), np.zeros((len(real), len(real))), False
            for batch in batches:
                if batch.num_rows:
                    z = matrix(batch.column(0))[:, real] - mean
                    w = batch.column(1).to_numpy().astype(np.float64)
                    first, second, seen = first + w @ z, second + z.T @ (w[:, None] * z), True
            if seen:
                yield _entries(first, second)

        first, second = _moments(whitened.select("whitened", "weight").mapInArrow(run, "i int, j int, part double"))
        return first / model.n, second / model.n

    mean, _ = moments(np.zeros(len(real)))
    _, covariance = moments(mean)
    return float(np.abs(covariance - np.eye(len(real))).max())


def whiten_table(
    table: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000, weight: str = "count"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every whole vector and component.

    Components ``c`` become ``x = floor(scale * c) + shift``.  Equal ``x`` vectors are one row with their number as weight
    (``weight="one"``: one), so the fit and the transform see each distinct vector once; results join back to the rows.
    ``n`` is the total weight and ``deviation`` the exact sum over dimensions of ``(n * x - S) ** 2``, an error beyond 64
    bits.  ``whitened`` is the centred vector on a component's axis over the root of its eigenvalue, ``explained`` its
    share of the trace, ``identity_error`` how far the whitened covariance is from the identity at most.

    Rows whose vector is null, empty, or has null or non-finite entries take no part, and neither do vectors of another
    length than most (see ``vectors.whole_vectors``).  Repeated rows and repeated or null ids are rows like others.
    A component without variance has null ``whitened`` and zero ``explained`` (null if nothing varies) and is left out of
    ``identity_error``.  No whole vectors give no rows.  Other columns are ignored.
    """
    rows = whole_vectors(table.select("vec_id", vector), vector).select("vec_id", floored(vector, scale, shift).alias("x"))
    with scope():
        distinct = put_down(distinct_vectors(rows, weight), "white-distinct")
        model = fit(distinct, components)
        if model is None:
            kind = table.schema["vec_id"].dataType.simpleString()
            return table.sparkSession.createDataFrame(
                [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
            )
        done = put_down(whiten(distinct, model), "white-vectors", kept=True)
        error = identity_error(done, model)
    share = F.array(*(F.lit(float(v) / model.trace if model.trace > 0 else None).cast("double") for v in model.values))
    of = done.select(F.col("x").alias("of"), "deviation", "whitened")
    joined = rows.join(of, F.col("x") == F.col("of")).select("vec_id", "deviation", F.posexplode("whitened").alias("nth", "whitened"))
    return joined.select(
        "vec_id", (F.col("nth") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "nth").alias("explained"), F.lit(error).alias("identity_error"),
    )
