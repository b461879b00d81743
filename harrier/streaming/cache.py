"""The semantic cache: an earlier answer serves a question that is near enough.

Entries expire after a time to live and the least recently used goes when the cache
is full. Questions are dealt to shards, each with a cache of bounded size, by a key;
within a shard they are taken in order, as a cache must. State is bounded by the
cache's size, whatever the number of questions. ``replay`` does so over a table; ``serve``
over a stream, with the caches as keyed state that outlives a restart.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from harrier.shipping import ship

SIMILARITY, TTL, SIZE = 0.92, 3600.0, 256


class SemanticCache:
    """One shard's cache, with its counts."""

    def __init__(self, similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE):
        self.similarity, self.ttl, self.size = similarity, ttl, size
        self.entries: OrderedDict[object, tuple[np.ndarray, float]] = OrderedDict()
        self.hits = self.misses = self.evictions = 0
        self.nearest: float | None = None  # the best similarity of the last lookup

    def get(self, vector: np.ndarray, now: float) -> object | None:
        """The key of the nearest entry, if it is near enough and not expired."""
        self.nearest = None
        if self.entries:
            keys = list(self.entries)
            scores = np.array([e[0] for e in self.entries.values()]) @ vector
            best = int(np.argmax(scores))
            self.nearest = float(scores[best])
            if scores[best] >= self.similarity:
                key = keys[best]
                if now - self.entries[key][1] <= self.ttl:
                    self.entries.move_to_end(key)
                    self.hits += 1
                    return key
                del self.entries[key]
                self.evictions += 1
        self.misses += 1
        return None

    def put(self, key: object, vector: np.ndarray, now: float) -> None:
        if key in self.entries:
            del self.entries[key]
        while len(self.entries) >= self.size:
            self.entries.popitem(last=False)
            self.evictions += 1
        self.entries[key] = (vector, now)

    def forget(self, keys: set | None = None) -> int:
        """Drop the entries of some keys (whose sources changed), or all; how many went."""
        gone = [k for k in self.entries if keys is None or k in keys]
        for k in gone:
            del self.entries[k]
        self.evictions += len(gone)
        return len(gone)

    def rows(self) -> list[tuple[object, list[float], float]]:
        """The entries, least recently used first, to be stored."""
        return [(k, v.tolist(), at) for k, (v, at) in self.entries.items()]

    @classmethod
    def of_rows(cls, rows: list[tuple[object, list[float], float]], similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE) -> SemanticCache:
        """A cache with stored entries in their order."""
        cache = cls(similarity, ttl, size)
        for key, vector, at in rows:
            cache.put(key, np.asarray(vector, np.float64), at)
        return cache

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def replay(questions: DataFrame, shards: int = 8, similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE) -> DataFrame:
    """``(shard, question_id, served_by)`` of ``questions (question_id, shard, at, vector)``
    in the order of time: the earlier question whose answer serves, or null.

    Each task streams the sorted rows of its shards through their caches.
    """
    return _streamed(questions.withColumn("probe", F.lit(False)), shards, similarity, ttl, size).select("shard", "question_id", "served_by")


def probed(questions: DataFrame, probes: DataFrame, shards: int = 8, similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE) -> DataFrame:
    """``(shard, question_id, served_by, similarity)`` of the probes, which are looked up in
    the caches that the questions have filled, and not added. ``similarity`` is that of
    the nearest entry, null in an empty cache."""
    rows = questions.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True)))
    return _streamed(rows, shards, similarity, ttl, size).filter("probe").drop("probe")


def probe_counts(found: DataFrame, sources: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(n, from_source, from_other, misses, least_margin)`` of probes, given the question
    ``(question_id, source_id)`` that each rewrites: served by it, by another, or not; and
    how near the closest decision was to the threshold."""
    met = found.join(sources, "question_id")
    own = F.col("served_by") == F.col("source_id")
    return met.agg(F.count("*").alias("n"), F.count_if(own).alias("from_source"), F.count_if(~own).alias("from_other"), F.count_if(F.col("served_by").isNull()).alias("misses"), F.round(F.min(F.abs(F.col("similarity") - threshold)), 6).alias("least_margin"))


_STREAMED = "shard long, question_id long, probe boolean, served_by long, similarity double"


def _streamed(rows: DataFrame, shards: int, similarity: float, ttl: float, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cache = None, SemanticCache(similarity, ttl, size)
        for batch in batches:
            out = []
            for own, probe, at, number, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if own != shard:
                    shard, cache = own, SemanticCache(similarity, ttl, size)
                v = np.asarray(vector, np.float64)
                v = v / max(float(np.linalg.norm(v)), 1e-12)
                served = cache.get(v, at)
                out.append((own, number, probe, served, cache.nearest))
                if served is None and not probe:
                    cache.put(number, v, at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()))], names=["shard", "question_id", "probe", "served_by", "similarity"])

    ship(rows.sparkSession)
    typed = rows.selectExpr("cast(shard as bigint) shard", "probe", "cast(at as double) at", "cast(question_id as bigint) question_id", "vector")
    return typed.repartition(shards, "shard").sortWithinPartitions("shard", "probe", "at", "question_id").mapInArrow(run, _STREAMED)


class KeyedCache(StatefulProcessor):
    """The cache of each shard as state: a map from a question to its vector, its time and its turn
    (the larger, the later it was used), so that the entry to go is known after a restart too.

    A shard without questions for ``idle_ms`` (processing time) is forgotten by a timer;
    ``handleInputRows`` takes a micro-batch of a shard in the order of time.
    """

    def __init__(self, similarity: float, ttl: float, size: int, idle_ms: int | None):
        self.limits, self.idle_ms = (similarity, ttl, size), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "question_id bigint", "vector array<double>, at double, turn bigint")
        self.turns = handle.getValueState("turns", "turn bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted(((v[2], k[0], v[0], v[1]) for k, v in self.entries.iterator()), key=lambda e: e[0])
        cache = SemanticCache.of_rows([(k, vector, at) for _, k, vector, at in held], *self.limits)
        turn = {k: t for t, k, *_ in held}
        last = self.turns.get()[0] if self.turns.exists() else 0
        batch = pd.concat(list(rows)).sort_values(["at", "question_id"], kind="stable")
        served = []
        touched = set()
        for number, at, vector in zip(batch["question_id"].tolist(), batch["at"].tolist(), batch["vector"].tolist()):
            v = np.asarray(vector, np.float64)
            v = v / max(float(np.linalg.norm(v)), 1e-12)
            found = cache.get(v, at)
            if found is None:
                cache.put(number, v, at)
            served.append(found)
            last += 1
            turn[number if found is None else found] = last
            touched.add(number if found is None else found)
        now = {k: (vector, at) for k, vector, at in cache.rows()}
        for k in [k for _, k, *_ in held if k not in now]:
            self.entries.removeKey((k,))
        for k in touched & set(now):
            self.entries.updateValue((k,), (now[k][0], now[k][1], turn[k]))
        self.turns.update((last,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"shard": key[0], "question_id": batch["question_id"].to_numpy(), "served_by": pd.array(served, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass


#: The state store that keyed state with maps and timers needs.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def serving(questions: DataFrame, path: str, checkpoint: str, similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE, idle_ms: int | None = None, **trigger) -> StreamingQuery:
    """A running query that serves a stream of ``(question_id, shard, at, vector)``: appends
    ``(shard, question_id, served_by)`` to the table at ``path``. ``trigger`` is the writer's; with
    ``idle_ms`` timers keep a query going that takes what is there only, so it must be stopped."""
    spark = questions.sparkSession
    ship(spark)
    typed = questions.selectExpr("cast(shard as bigint) shard", "cast(question_id as bigint) question_id", "cast(at as double) at", "transform(vector, x -> cast(x as double)) vector")
    served = typed.groupBy("shard").transformWithStateInPandas(KeyedCache(similarity, ttl, size, idle_ms), "shard bigint, question_id bigint, served_by bigint", "append", "None" if idle_ms is None else "ProcessingTime")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # read when the query starts
    try:
        writer = served.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.set(_STORE, before)


def serve(questions: DataFrame, path: str, checkpoint: str, similarity: float = SIMILARITY, ttl: float = TTL, size: int = SIZE) -> None:
    """Serve what is there of a stream. A later call with the same checkpoint goes on with the
    caches as they were. Rows are as ``replay`` gives them if the micro-batches come in the
    order of time."""
    serving(questions, path, checkpoint, similarity, ttl, size, availableNow=True).awaitTermination()
