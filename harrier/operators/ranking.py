"""Ranks and ranked lists. A list is rows of ``(query_id, item, score)``; each rank is
a column, and each order is total: the score descending, then the item."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at once.
QUERY_BLOCK = 4_096


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], most: int = QUERY_BLOCK, key: str = "query_id") -> DataFrame:
    """``answer`` of the queries, which it may broadcast: it gets them in blocks of about
    ``most`` (one, if there are no more), dealt by the hash of their id."""
    n = -(-queries.count() // most)
    if n <= 1:
        return answer(queries)
    out = None
    for i in range(n):
        part = answer(queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i))
        out = part if out is None else out.unionByName(part)
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows; a larger one is joined
    by a shuffle. Only so many rows are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, if its files give fewer splits than there are cores: for a
    table in a few files, dealing rows costs less than working on few cores. A table of
    many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def top_k(scored: DataFrame, k: int, score: str = "score", item: str = "item", by: str | Sequence[str] = "query_id", rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1. The rank's filter lets
    Spark keep only ``k`` rows of a query in each task before the shuffle."""
    keys = [by] if isinstance(by, str) else list(by)
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item).asc())
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def rrf(lists: DataFrame, k: int = 60, weight: Column | None = None, item: str = "item") -> DataFrame:
    """Reciprocal rank fusion of rows ``(query_id, item, rank)``: the sum of
    ``weight / (k + rank)`` by query and item, in one shuffle for any number of lists."""
    share = (weight if weight is not None else F.lit(1.0)) / (F.lit(float(k)) + F.col("rank"))
    return lists.groupBy("query_id", item).agg(F.round(F.sum(share), 10).alias("rrf"))


def weighted_rrf(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = 60, item: str = "item") -> DataFrame:
    """RRF of several lists, each with a weight; weights must be positive and finite, one
    for each list."""
    weights = list(weights) if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists) or any(not (0 < w < float("inf")) for w in weights):
        raise ValueError("each list needs one positive, finite weight")
    every = None
    for ranked, w in zip(lists, weights):
        part = ranked.select("query_id", item, "rank", F.lit(float(w)).alias("weight"))
        every = part if every is None else every.unionByName(part)
    return rrf(every, k, F.col("weight"), item)


def best_of(lists: DataFrame, by: Sequence[str] = ("query_id", "item")) -> DataFrame:
    """Of an item found by several sub-queries, the highest score."""
    return lists.groupBy(*by).agg(F.max("score").alias("score"))


def first_hits_by_path(hits: DataFrame) -> DataFrame:
    """The paths of each query in the order in which they first occur."""
    first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path"))).drop("first")


def file_depth_cut(hits: DataFrame, k: int) -> DataFrame:
    """The hits of each query up to where ``k`` different files have been seen."""
    w = Window.partitionBy("query_id").orderBy("rank")
    fresh = hits.withColumn("fresh", (F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank")) == 1).cast("int"))
    before = F.coalesce(F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return fresh.withColumn("before", before).filter(F.col("before") < k).drop("fresh", "before")


def rerank_head(hits: DataFrame, reranked: DataFrame, depth: int) -> DataFrame:
    """Hits with the first ``depth`` in the order of ``reranked (query_id, item, score)``
    and the others behind them as they were."""
    head = hits.filter(F.col("rank") <= depth).join(reranked.select("query_id", "item", F.col("score").alias("rerank")), ["query_id", "item"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank").desc_nulls_last(), F.col("rank"))
    head = head.withColumn("new_rank", F.row_number().over(order))
    tail = hits.filter(F.col("rank") > depth).withColumns({"rerank": F.lit(None).cast("double"), "new_rank": F.col("rank")})
    return head.unionByName(tail).withColumn("rank", F.col("new_rank")).drop("new_rank")


def boosted_by_rank(hits: DataFrame, other: DataFrame, item: str = "item", k: int = 60) -> DataFrame:
    """Hits ``(query_id, item, rank)`` in the order of ``1 / (k + rank)`` plus the same of
    their rank in ``other``; items that it lacks keep their own share."""
    far = other.select("query_id", item, F.col("rank").alias("other_rank"))
    score = F.round(1 / (k + F.col("rank")) + F.coalesce(1 / (k + F.col("other_rank")), F.lit(0.0)), 10)
    scored = hits.join(far, ["query_id", item], "left").withColumn("score", score)
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).drop("other_rank")


def without_self(hits: DataFrame) -> DataFrame:
    """Hits but those whose item is the query itself, ranked anew."""
    kept = hits.filter(F.col("item").cast("string") != F.col("query_id").cast("string"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def of_type(hits: DataFrame, endings: Sequence[str], k: int) -> DataFrame:
    """Of the first ``k`` hits those with one of the extensions: fewer than ``k`` may be
    left, since the cut comes first."""
    from harrier.functions import text as T

    return hits.filter(F.col("rank") <= k).filter(T.suffix("path").isin(*endings))


def shown(hits: DataFrame, chars: int = 400) -> DataFrame:
    """What a caller sees of a hit: its place, and the beginning of its text."""
    return hits.withColumn("text", F.when(F.char_length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit(" ..."))).otherwise(F.col("text")))


def rrf_first_seen(lists: DataFrame, n: int, k: int = 60, item: str = "item") -> DataFrame:
    """The ``n`` best of each query by RRF over ``(query_id, list_no, rank, item)``; of equal
    scores the item that was seen first stands first: in the earliest list, at the best rank."""
    seen = F.min(F.struct("list_no", "rank")).alias("first")
    fused = lists.groupBy("query_id", item).agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 10).alias("rrf"), seen)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("first")


def append_unseen(lists: DataFrame, n: int, item: str = "item") -> DataFrame:
    """The items of the first list of each query, then those of each further one that were
    not seen before, in their order: ``(query_id, item, rank)``, ``n`` at most."""
    first = lists.groupBy("query_id", item).agg(F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", item)
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("first")


def path_lists(hits: DataFrame, n: int = 100, nth: int = 10) -> DataFrame:
    """``(query_id, paths, hits_to_nth)``: the first ``n`` different paths of the hits, and
    the rank of the hit that brought the ``nth`` (null if there are fewer)."""
    first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
    placed = first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path"))).filter(F.col("at") <= n)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"])
    return placed.groupBy("query_id").agg(paths.alias("paths"), F.max(F.when(F.col("at") == nth, F.col("first"))).alias("hits_to_nth"))
