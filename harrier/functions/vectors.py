"""Vector functions over ``array<double>`` columns; they stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

NORM_FLOOR = 1e-12
SCORE_DECIMALS = 10


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product, summed in order, in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """The vector by its length, which counts as 1e-12 at least."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(_col(v), lambda x: x.cast("double") / length)


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine, rounded as ranking needs it."""
    return F.round(dot(unit(a), unit(b)), SCORE_DECIMALS)


def sign_bits(v: Column | str) -> Column:
    """``array<int>``: 1 where the value is 0 or more."""
    return F.transform(_col(v), lambda x: F.when(x >= 0, 1).otherwise(0))


def packed_bits(v: Column | str, words: int = 2, width: int = 32) -> Column:
    """The sign bits packed into ``array<long>`` of ``width`` bits each."""
    bits = sign_bits(v)
    return F.array(*(F.aggregate(F.slice(bits, i * width + 1, width), F.lit(0).cast("long"), lambda s, b: s * 2 + b) for i in range(words)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two packed arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def to_half(v: Column | str) -> Column:
    """Each value rounded to half precision."""
    return F.arrow_udf(_halves, ArrayType(FloatType()))(_col(v))


def _halves(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.asarray(x, np.float32).astype(np.float16).astype(np.float32).tolist() for x in v.to_pylist()], pa.list_(pa.float32()))
