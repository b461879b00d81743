"""Embedding whitening from upper-triangle column aggregates.

Entries become whole numbers (``floor(64 * c) + 1000000``), and each distinct vector
of them is once in the *fit list*. One aggregation over that list gives its size and
the sum of each dimension; a second one has a generated SQL expression for each pair
of dimensions i <= j, the sum of the products of the entries less their dimension's
centre. The centre is the mean rounded to a whole number, so sums are exact and don't
depend on the order of rows; what rounding leaves is taken off the matrix as whole
numbers too. The driver holds this matrix alone (dimensions squared) and LAPACK takes
it apart. Rows then meet the model (components x dimensions) in one narrow pass.

Where whole-number sums could overflow (entries in the millions over thousands of
millions of rows), the same expressions sum doubles. Pairs of more than
``PAIRS`` (140 dimensions) are dealt over several aggregations of the same list.

Vectors that are null or empty, or hold null or non-finite entries, are left out, and
so are those of another length than the most frequent one of the fit list (ties: the
longest). Repeated rows and rows with one vector each get their result, and count once
in the fit list. Entries saturate at 2^61. Components without variance (a fit list of
one vector, or of fewer independent ones) whiten to null. Of equal eigenvalues the order
is LAPACK's. Each component's entry of largest size is positive. Empty tables give no
rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import free_name, materialize, ship

COMPONENTS = 16
#: The contract's whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Expressions in one aggregation, at most.
PAIRS = 10_000
#: A component counts as without variance below this share of all variance.
NO_VARIANCE = 1e-13

_MOST = 2**61


def is_usable(vector: Column) -> Column:
    """Is there a vector, and are its entries numbers?"""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """The vector as ``array<bigint>``."""
    scaled = F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(_MOST)), F.lit(-_MOST)))
    return F.transform(scaled, lambda c: (c + SHIFT).cast("long"))


@dataclass
class Whitening:
    """A fitted model: numbers by dimension and component only."""

    n: int
    sums: list[int]
    components: np.ndarray  # components x dimensions, unit rows
    variances: np.ndarray  # by component
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace else 0.0 for e in self.variances]

    @property
    def live(self) -> np.ndarray:
        return self.variances > NO_VARIANCE * self.trace

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviations (null beyond a long) and whitened entries of vectors (a row each)."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if most < 2**62 and int(np.abs(m := self.n * x - np.array(self.sums, np.int64)).max(initial=0)) ** 2 * x.shape[1] < 2**63:
            far = (m * m).sum(axis=1).tolist()
        else:
            m = self.n * x.astype(object) - np.array(self.sums, object)
            far = [s if s < 2**63 else None for s in (m * m).sum(axis=1).tolist()]
        scale = np.sqrt(np.where(self.live, self.variances, 1.0))
        out = (m.astype(np.float64) / self.n) @ self.components.T / scale
        return far, out


def fit_list(rows: DataFrame, x: str) -> DataFrame:
    """The distinct vectors ``(x)`` of the most frequent length, in the shared folder."""
    distinct = materialize(rows.select(F.col(x).alias("x")).distinct(), "fit-list")
    length = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return distinct.filter(F.size("x") == (length.d if length else 0))


def pair_sums(rows: DataFrame, column: str, centre: list, kind: str) -> np.ndarray:
    """For dimensions i <= j the sum over ``rows`` of (x[i] - centre[i]) * (x[j] - centre[j]),
    as a symmetric matrix: Python ints for ``bigint``, floats for ``double``."""
    d = len(centre)
    centred = rows.selectExpr(*(f"CAST({column}[{i}] AS {kind}) - CAST({c} AS {kind}) AS c{i}" for i, c in enumerate(centre)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d), object if kind == "bigint" else float)
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        found = centred.selectExpr(*(f"sum(c{i} * c{j})" for i, j in part)).first()
        for (i, j), value in zip(part, found, strict=True):
            out[i, j] = out[j, i] = value or 0
    return out


def covariance(fit: DataFrame, column: str = "x") -> tuple[int, list[int], np.ndarray] | None:
    """Size, sums and covariance (divisor: the size) of whole-number vectors; None of none."""
    first = fit.select(F.size(column).alias("d")).first()
    if first is None:
        return None
    sums = (f"CAST(sum(CAST({column}[{i}] AS DECIMAL(20, 0))) AS STRING)" for i in range(first.d))
    n, low, high, *said = fit.selectExpr("count(*)", f"min(array_min({column}))", f"max(array_max({column}))", *sums).first()
    s = [int(v) for v in said]
    centre = [(2 * v + n) // (2 * n) for v in s]  # the mean, rounded
    exact = n * (max(abs(high - c) for c in centre) + max(abs(low - c) for c in centre)) ** 2 < 2**62
    products = pair_sums(fit, column, centre, "bigint" if exact else "double")
    rest = [v - n * c for v, c in zip(s, centre)]
    matrix = np.array([[(int(p) * n - a * b) / (n * n) if exact else p / n - (a / n) * (b / n) for p, b in zip(row, rest)] for row, a in zip(products, rest)])
    return n, s, matrix


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, column: str = "x") -> Whitening | None:
    """The model of a fit list (vectors of one length); None of an empty one."""
    found = covariance(fit, column)
    if found is None:
        return None
    n, sums, matrix = found
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    rows = vectors.T[order]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
    return Whitening(n, sums, rows * signs[:, None], np.maximum(values[order], 0.0), float(np.trace(matrix)))


def whitened(rows: DataFrame, model: Whitening, x: str, into: str = "whitening") -> DataFrame:
    """``rows`` with the struct ``into`` of ``deviation long, whitened array<double>``."""
    ship(rows.sparkSession)
    live = model.live

    @F.arrow_udf("deviation long, whitened array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(model.sums))
        far, out = model.apply(matrix)
        k = out.shape[1]
        entries = pa.array(out.ravel(), pa.float64(), mask=np.tile(~live, len(vectors)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * k, pa.int32()), entries)
        return pa.StructArray.from_arrays([pa.array(far, pa.int64()), lists], names=["deviation", "whitened"])

    return rows.withColumn(into, project(F.col(x)))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, measured by
    the same pair expressions: the largest entry of the difference."""
    live = np.flatnonzero(model.live)
    if not len(live):
        return None
    rows = whitened(fit, model, "x", "w").select(F.transform(F.array(*(F.lit(int(i)) for i in live)), lambda i: F.get(F.col("w.whitened"), i)).alias("y"))
    held = materialize(rows, "whitened-fit")
    means = np.array(held.selectExpr(*(f"avg(y[{i}])" for i in range(len(live)))).first())
    products = pair_sums(held, "y", [repr(float(m)) for m in means], "double") / model.n
    return float(np.abs(products - np.eye(len(live))).max())


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, into: str = "whitening") -> tuple[DataFrame, Whitening | None, float | None]:
    """The usable rows of ``df`` with the struct ``into``, the model, and its identity error."""
    x = free_name(df, "x")
    rows = df.filter(is_usable(F.col(vector_col))).withColumn(x, whole_numbers(F.col(vector_col)))
    fit = fit_list(rows, x)
    model = fit_whitening(fit, components)
    if model is None:
        return df.filter(F.lit(False)).withColumn(into, F.lit(None).cast("struct<deviation:bigint,whitened:array<double>>")), None, None
    same = rows.filter(F.size(x) == len(model.sums))
    return whitened(same, model, x, into).drop(x), model, identity_error(fit, model)


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for
    each usable row and component."""
    rows, model, error = whiten(embeddings.select("vec_id", "embedding"), components=components)
    shares = F.array(*(F.lit(e) for e in (model.explained if model else []))).cast("array<double>")
    each = rows.select("vec_id", F.col("whitening.deviation").alias("deviation"), F.posexplode("whitening.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
