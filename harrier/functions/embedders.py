"""Text embedders. They turn a column of texts into ``array<float>``.

``hash_vectors`` needs BLAKE2, which Spark SQL lacks, so it runs in Arrow batches;
``sql_hash_vectors`` is a sibling by ``xxhash64`` that stays in the JVM and gives other
vectors. ``tfidf`` is fitted with Spark ML. A model-backed embedder plugs in as any
function from texts to a matrix, by ``with_model``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from harrier.functions import text as T
from harrier.functions import vectors as V
from harrier.shipping import ship

DIM = 256


def _spot(gram: str, dim: int) -> tuple[int, float]:
    digest = hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] & 1 else -1.0


def hash_vector(text: str, dim: int = DIM, spots: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
    """Signed counts of the lower-case text's 3- and 4-grams, scaled to length 1."""
    spots = {} if spots is None else spots
    folded = (text or "").lower()
    out = np.zeros(dim, np.float32)
    for n in (3, 4):
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            spot = spots.get(gram)
            if spot is None:
                if len(spots) > 200_000:
                    spots.clear()
                spot = spots[gram] = _spot(gram, dim)
            out[spot[0]] += spot[1]
    return out / max(float(np.linalg.norm(out)), V.NORM_FLOOR)


def hash_vectors(text: Column | str, dim: int = DIM) -> Column:
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spots: dict[str, tuple[int, float]] = {}
        for texts in batches:
            yield pd.Series(_hashed(texts.tolist(), dim, spots), texts.index)

    return F.pandas_udf(embed, ArrayType(FloatType()))(F.col(text) if isinstance(text, str) else text)


def _hashed(texts: list[str | None], dim: int, spots: dict[str, tuple[int, float]]) -> list[np.ndarray]:
    """``hash_vector`` of each text. The grams of many texts are numbered at once, so that
    each different one is looked up once."""
    out, at = [], 0
    folded = [(t or "").lower() for t in texts]
    while at < len(folded):
        end, n = at, 0
        while end < len(folded) and (end == at or n + len(folded[end]) <= _CHARS):
            n, end = n + len(folded[end]), end + 1
        counts = _gram_counts(folded[at:end], dim, spots).astype(np.float32)
        out += [x / max(float(np.linalg.norm(x)), V.NORM_FLOOR) for x in counts]
        at = end
    return out


#: Characters whose grams are numbered at once.
_CHARS = 2_000_000


def _gram_counts(texts: list[str], dim: int, spots: dict[str, tuple[int, float]]) -> np.ndarray:
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends, row = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
    code, letters = pd.factorize(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    code, base = code.astype(np.int64), len(letters) + 1
    out = np.zeros(len(texts) * dim)
    # numbers of letters, of which a text has 1.1 million at most, are put together two at a time
    key = code
    for n in (2, 3, 4):
        if len(joined) < n:
            break
        key, grams = pd.factorize(key[: len(joined) - n + 1] * base + code[n - 1 :])
        key = key.astype(np.int64)
        if n == 2:
            continue
        place = np.arange(len(key))
        inside = place + n <= ends[row[: len(key)]]
        first = np.full(len(grams), -1, np.int64)
        first[key[inside][::-1]] = place[inside][::-1]
        bucket, sign = np.zeros(len(grams), np.int64), np.zeros(len(grams))
        for g in np.flatnonzero(first >= 0).tolist():
            gram = joined[first[g] : first[g] + n]
            spot = spots.get(gram)
            if spot is None:
                if len(spots) > 200_000:
                    spots.clear()
                spot = spots[gram] = _spot(gram, dim)
            bucket[g], sign[g] = spot
        kept = key[inside]
        out += np.bincount(row[: len(key)][inside] * dim + bucket[kept], sign[kept], len(out))
    return out.reshape(len(texts), dim)


def sql_hash_vectors(docs: DataFrame, item: str, text: str = "text", dim: int = DIM) -> DataFrame:
    """``(item, bucket, value)``, sparse: signed counts of tokens by hash, in one shuffle."""
    from harrier.operators.lexical import exploded

    words = exploded(docs.select(item, T.tokens(text).alias("tokens")))
    h = F.xxhash64("term")
    spread = words.select(item, F.pmod(h, F.lit(dim)).cast("int").alias("bucket"), F.when(F.shiftright(h, 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0).alias("sign"))
    counts = spread.groupBy(item, "bucket").agg(F.sum("sign").alias("value"))
    return counts.filter("value <> 0")


def tfidf(docs: DataFrame, text: str = "text", features: int = 4096):
    """A fitted pipeline that adds ``features``: TF-IDF of tokens and pairs of tokens."""
    rows = docs.withColumn("tokens", T.tokens(text)).withColumn("grams", F.concat("tokens", _pairs("tokens")))
    return Pipeline(stages=[CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=features), IDF(inputCol="counts", outputCol="features")]).fit(rows), rows


def principal(vectors: DataFrame, dim: int, column: str = "features") -> np.ndarray:
    """The ``dim`` leading right singular vectors of the rows, uncentred: an array of
    (features, dim), fewer columns where the rank is lower. The entry of each that is
    largest by size is positive. A task keeps one Gram matrix (features squared, so the
    vocabulary must be bounded, as ``tfidf`` bounds it); a tree adds them up. No rows at
    all are an error: they have no axes."""
    ship(vectors.sparkSession)

    def gram(rows: Iterator) -> Iterator[np.ndarray]:
        total, block = None, []

        def added() -> np.ndarray:
            x = np.array([v.toArray() for v in block])
            return x.T @ x if total is None else total + x.T @ x

        for (v,) in rows:
            block.append(v)
            if len(block) == _GRAM_ROWS:
                total, block = added(), []
        if block:
            total = added()
        if total is not None:
            yield total

    return leading(vectors.select(column).rdd.mapPartitions(gram).treeReduce(np.add), dim)


def leading(gram: np.ndarray, dim: int) -> np.ndarray:
    """The axes of ``principal``, by the rows' Gram matrix."""
    values, axes = np.linalg.eigh(gram)
    kept = [k for k in np.argsort(-values)[:dim] if values[k] > _RANK * values.max()]
    axes = axes[:, kept]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])


#: Rows that are made dense at a time, and the share of the largest eigenvalue that counts as zero.
_GRAM_ROWS = 512
_RANK = 1e-12


def reduced(vectors: DataFrame, axes: np.ndarray, column: str = "features") -> DataFrame:
    """``vectors`` with ``embedding``: the rows on the axes, scaled to length 1. A row of
    zeros stays one. The axes' size is bounded by the vocabulary's."""
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, values in batches:
            out = (np.asarray(v) @ shared.value[np.asarray(i, np.int64)] if len(i) else np.zeros(shared.value.shape[1]) for i, v in zip(at, values, strict=True))
            yield pd.Series([x / max(float(np.linalg.norm(x)), V.NORM_FLOOR) for x in out])

    dense = vector_to_array(column)
    at = F.filter(F.transform(dense, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return vectors.withColumn("embedding", F.pandas_udf(project, ArrayType(DoubleType()))(at, F.filter(dense, lambda x: x != 0)))


def _pairs(column: str) -> Column:
    c = F.col(column)
    return F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(c, i), F.try_element_at(c, i + 1)))).otherwise(F.array().cast("array<string>"))


def with_model(text: Column, encode: Callable[[list[str]], np.ndarray]) -> Column:
    """Vectors by a function that is shipped to the workers, a batch at a time."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), np.float32)))

    return F.pandas_udf(embed, ArrayType(FloatType()))(text)


def mean_unit(vectors: list[Column]) -> Column:
    """The mean of several vector columns, scaled to length 1."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda a, b: a + b)
    return V.unit(F.transform(total, lambda x: x / len(vectors)))


