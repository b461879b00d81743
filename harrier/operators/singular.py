"""TF-IDF of words and pairs of words on singular axes, for tables of any length.

The texts are read twice: to count words, and to store each as the numbers of its frequent
words. The rest works on those numbers. A pair is no more frequent than either of its words,
so pairs are counted among the most frequent words only, and none is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.functions import vectors as V
from harrier.functions.embedders import leading
from harrier.scratch import fresh_folder
from harrier.shipping import ship

#: Bytes that are in tokens, in lower case, and 0 for the others. Bytes of characters that aren't ASCII are in none.
_LOWER = np.array([ord(chr(c).lower()) if c < 128 and re.fullmatch(T.TOKEN, chr(c)) else 0 for c in range(256)], np.uint8)
#: Bytes of texts that are cut at a time, different words that a task holds before it hands them on,
#: rows and words of a block that is made dense, and parts in which tasks' arrays are added up.
_BYTES = 4_000_000
_WORDS = 1_000_000
_ROWS, _CODES = 512, 1_000_000
_PARTS = 16


def _slices(column: pa.Array, rows: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a binary column, of one row or of ``rows`` rows and ``size`` bytes at most: the
    first row, the bytes, and where each row ends in them."""
    if not len(column):
        return
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
        yield at, data[ends[at] : ends[end]], ends[at + 1 : end + 1] - ends[at]
        at = end


def _words(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """``T.tokens`` of a binary column of texts in UTF-8, piece by piece: the first row, the
    words of its rows, and how many words there are up to the end of each."""
    for at, data, ends in _slices(column, len(column), _BYTES):
        low = _LOWER[data]
        inside = low != 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < len(low)]
        starts[first] = inside[first]
        bounds = np.append(np.flatnonzero(starts[inside]), inside.sum()).astype(np.int32)
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(low[inside]))
        yield at, words, np.searchsorted(np.flatnonzero(starts), ends)


def frequent_words(docs: DataFrame, text: str = "text", most: int = 1024) -> list[tuple[str, int]]:
    """The most frequent words with their counts: by falling count, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                yield from pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"]).to_batches()
                held.clear()

        for batch in batches:
            for _, words, _ in _words(batch.column(0)):
                found = pc.value_counts(words)
                held.append(pa.table({"term": found.field(0), "n": found.field(1)}))
                if sum(map(len, held)) > _WORDS:
                    yield from told()
        yield from told()

    ship(docs.sparkSession)
    counts = docs.select(_bytes(text)).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [(r.term, r.n) for r in counts.orderBy(F.desc("n"), "term").limit(most).collect()]


def coded(docs: DataFrame, item: str, words: list[str], text: str = "text") -> DataFrame:
    """``(item, codes)``: for each text the places of its words in ``words`` as int32, with -1
    for other words between them and at the end. Stored in the shared folder."""
    spark = docs.sparkSession
    ship(spark)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            for at, found, ends in _words(batch.column(1)):
                place = pc.index_in(found, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                codes = np.insert(place, ends, -1).astype(np.int32)
                last = ends + np.arange(len(ends))
                kept = codes >= 0
                kept[1:] |= kept[:-1].copy()  # the first of other words on end
                kept[last] = True
                bounds = np.append(0, np.cumsum(kept)[last] * 4).astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(codes[kept])])
                yield pa.record_batch([batch.column(0).slice(at, len(ends)), out], ["item", "codes"])

    folder = fresh_folder(spark, "codes")
    rows = docs.select(F.col(item).alias("item"), _bytes(text)).mapInArrow(code, f"item {docs.schema[item].dataType.simpleString()}, codes binary")
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def frequent_pairs(codes: DataFrame, words: int, most: int, above: int = 0) -> list[tuple[int, int, int]]:
    """The most frequent pairs of neighbours in ``codes``, of those found more than ``above``
    times: ``(left, right, count)`` by falling count, then by code. A task keeps a count for
    each pair that can be (``words`` squared)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words * words, np.int64)
        for batch in batches:
            for _, data, _ in _slices(batch.column(0), batch.num_rows, _CODES * 4):
                x = data.view(np.int32).astype(np.int64)
                both = (x[:-1] >= 0) & (x[1:] >= 0)
                total += np.bincount(x[:-1][both] * words + x[1:][both], minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.record_batch([pa.array(key), pa.array(total[key])], ["pair", "n"])

    counts = codes.select("codes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return [(*divmod(r.pair, words), r.n) for r in counts.filter(F.col("n") > above).orderBy(F.desc("n"), "pair").limit(most).collect()]


def vocabulary(docs: DataFrame, item: str, text: str = "text", features: int = 1024) -> tuple[list[str], list[tuple[int, ...]], DataFrame]:
    """The words that ``codes`` number, the most frequent words and pairs as tuples of such
    numbers, and ``codes``. Of equal counts words go before pairs, then by alphabet: so a
    pair has both its words before it, and they are among the ``features`` most frequent."""
    found = frequent_words(docs, text, features)
    if not found:
        raise ValueError("the texts hold no word")
    words = sorted(w for w, _ in found)  # no character of a word is below the space that joins a pair: codes sort as pairs do
    codes = coded(docs, item, words, text)
    least = found[-1][1] if len(found) == features else 0
    place = {w: i for i, w in enumerate(words)}
    grams = [(-n, 1, (place[w],)) for w, n in found] + [(-n, 2, (a, b)) for a, b, n in frequent_pairs(codes, len(words), features, least)]
    return words, [g for _, _, g in sorted(grams)[:features]], codes


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def _counts(batch: pa.Array, words: int, grams: list[tuple[int, ...]]) -> Iterator[tuple[int, np.ndarray]]:
    """How often each row of a column of codes has each gram, block by block, with the block's first row."""
    width = len(grams)
    # the feature of each word and of each pair; what has none, and -1, has the one after the last
    single, double = np.full(words + 1, width, np.int64), np.full((words + 1, words + 1), width, np.int32)
    for i, g in enumerate(grams):
        (single if len(g) == 1 else double)[g] = i
    for at, data, ends in _slices(batch, _ROWS, _CODES * 4):
        x = data.view(np.int32)
        row = np.repeat(np.arange(len(ends)) * (width + 1), np.diff(ends // 4, prepend=0))
        feature = np.concatenate([row + single[x], row[:-1] + double[x[:-1], x[1:]]])
        yield at, np.bincount(feature, minlength=len(ends) * (width + 1)).reshape(len(ends), -1)[:, :width].astype(np.float64)


def embedded(docs: DataFrame, item: str, text: str = "text", features: int = 1024, dim: int = 64) -> DataFrame:
    """``(item, embedding)``: TF-IDF of the ``features`` most frequent words and pairs, as
    ``embedders.tfidf`` weighs them, on the ``dim`` leading singular axes of all rows, scaled
    to length 1; a row at right angles to them is zeros. Counts are multiplied and added as
    whole numbers and weighed at the end, so the axes don't depend on how rows are dealt. A
    task keeps two arrays of features squared."""
    words, grams, codes = vocabulary(docs, item, text, features)
    n_words, width = len(words), len(grams)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 2, width))
        for batch in batches:
            for _, x in _counts(batch.column(0), n_words, grams):
                total[:width] += x.T @ x
                total[width] += (x > 0).sum(axis=0)
                total[width + 1] += len(x)
        yield pa.record_batch([pa.array(range(_PARTS), pa.int32()), pa.array([x.tobytes() for x in np.array_split(total.ravel(), _PARTS)])], ["part", "total"])

    parts = codes.select("codes").mapInArrow(products, "part int, total binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1])))
    sums = parts.reduceByKey(np.add, _PARTS).collectAsMap()  # one array, however many tasks there are
    total = np.concatenate([sums[i] for i in range(_PARTS)]).reshape(-1, width)
    idf = np.log((total[-1] + 1) / (total[-2] + 1))
    shared = docs.sparkSession.sparkContext.broadcast((idf, idf[:, None] * leading(total[:width] * idf[:, None] * idf, dim)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, axes = shared.value
        for batch in batches:
            for at, counts in _counts(batch.column(1), n_words, grams):
                x = counts @ axes
                x[np.linalg.norm(x, axis=1) < V.NORM_FLOOR * np.sqrt(counts**2 @ weights**2)] = 0  # only rounding's noise
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.NORM_FLOOR)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.record_batch([batch.column(0).slice(at, len(x)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [item, "embedding"])

    return codes.mapInArrow(project, f"`{item}` {codes.schema['item'].dataType.simpleString()}, embedding array<double>")
