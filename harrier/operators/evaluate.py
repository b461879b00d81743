"""Ranking quality: metrics by query, means, intervals, agreement and gates.

Ranked lists are ``(query_id, item, rank)`` with ranks from 1; judgements are
``qrels (query_id, item, grade)``. Queries without a relevant item score 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUNDED = 8


def metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, recall, mrr, ndcg)`` at ``k`` with binary gains, a row for each query."""
    relevant = qrels.filter("grade > 0").select("query_id", "item").distinct()
    size = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = hits.filter(F.col("rank") <= k).join(relevant, ["query_id", "item"], "left_semi")
    sums = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    rows = queries.select("query_id").distinct().join(size, "query_id", "left").join(sums, "query_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.coalesce(F.round(F.col("n") / F.col("n_rel"), ROUNDED), zero).alias("recall"),
        F.coalesce(F.round(1 / F.col("first"), ROUNDED), zero).alias("mrr"),
        F.coalesce(F.when(F.col("n_rel") > 0, F.round(F.col("dcg") / ideal, ROUNDED)), zero).alias("ndcg"),
    )


def graded_ndcg(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, ndcg)`` with the grades as gains; the ideal list has the largest first."""
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item")
    ideal = qrels.filter("grade > 0").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("at") + 1)).alias("ideal"))
    got = hits.filter(F.col("rank") <= k).join(qrels.filter("grade > 0"), ["query_id", "item"]).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.round(F.col("dcg") / F.col("ideal"), ROUNDED), F.lit(0.0)).alias("ndcg"))


def random_baseline(hits: DataFrame, n_items: Column | int, k: int = 10, depth: int = 50) -> DataFrame:
    """``(query_id, unique_items, baseline)``: what a random list of as many items as the
    first ``depth`` hits hold would recall at ``k``."""
    unique = hits.filter(F.col("rank") <= depth).groupBy("query_id").agg(F.count_distinct("item").alias("unique_items"))
    n = n_items if isinstance(n_items, Column) else F.lit(n_items)
    return unique.select("query_id", "unique_items", F.round(F.least(F.lit(k), F.col("unique_items")) / n, ROUNDED).alias("baseline"))


def means(scores: DataFrame, category: str = "category", names: tuple[str, ...] = ("recall", "mrr", "ndcg")) -> DataFrame:
    """The means over all queries (null category) and by category, from one expansion."""
    grouped = scores.groupingSets([[], [category]], category)
    return grouped.agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in names))


def latencies(timings: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """``(stage, n, mean, p50, p95)``; percentiles interpolate linearly."""
    return timings.groupBy(stage).agg(
        F.count(ms).alias("n"), F.round(F.avg(ms), 6).alias("mean"), F.round(F.percentile(ms, 0.5), 6).alias("p50"), F.round(F.percentile(ms, 0.95), 6).alias("p95")
    )


def nearest_rank(values: DataFrame, p: float, value: str = "value", by: str = "stage") -> DataFrame:
    """The value at position ``round(p / 100 * (n - 1))``, half to even. Equal values are
    counted first and then walked in order; nulls don't count."""
    counted = values.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    n = counted.groupBy(by).agg(F.bround(F.lit(p / 100) * (F.sum("c") - 1)).cast("long").alias("at"))
    placed = counted.withColumn("upto", upto).join(n, by)
    return placed.filter((F.col("upto") - F.col("c") <= F.col("at")) & (F.col("at") < F.col("upto"))).select(by, "value")


def split_alternate(rows: DataFrame, category: str, order: str) -> DataFrame:
    """``rows`` with ``part`` 0 or 1, in turn within each category."""
    w = Window.partitionBy(category).orderBy(order)
    return rows.withColumn("part", (F.row_number().over(w) - 1) % 2)


def bootstrap_indices(spark: SparkSession, n: int, samples: int = 2000, seed: int = 0) -> DataFrame:
    """``(b, idx)``: ``samples`` draws of ``n`` positions from a fixed random stream; at
    most a few million rows, made on the driver since the stream is sequential."""
    drawn = np.random.RandomState(seed).randint(0, n, size=(samples, n))
    import pyarrow as pa

    table = pa.table({"b": np.repeat(np.arange(samples), n), "idx": drawn.ravel().astype(np.int64)})
    return spark.createDataFrame(table)


def interval(scores: DataFrame, indices: DataFrame, value: str = "value") -> DataFrame:
    """``(mean, low, high)`` of ``scores (pos, value)``: percentiles 2.5 and 97.5 of the
    means of the resampled positions."""
    drawn = indices.join(scores, F.col("idx") == F.col("pos")).groupBy("b").agg(F.avg(value).alias("m"))
    edges = drawn.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return scores.agg(F.round(F.avg(value), ROUNDED).alias("mean")).select("mean", F.round(edges.select("low").scalar(), ROUNDED).alias("low"), F.round(edges.select("high").scalar(), ROUNDED).alias("high"))


def paired_interval(a: DataFrame, b: DataFrame, indices: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """The interval of the differences ``a - b`` of each query, in the order of the key."""
    both = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    w = Window.orderBy(key)  # one row for each query of an evaluation
    return interval(both.select((F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("va") - F.col("vb")).alias("value")), indices)


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, agreement, expected, kappa)`` of two label columns; where the expected
    agreement is 1, kappa is 1 if the labels agree throughout and else 0."""
    n = F.sum("c").alias("n")
    pairs = labels.groupBy(a, b).agg(F.count("*").alias("c"))
    totals = pairs.agg(n, F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("c")).otherwise(0)).alias("same"))
    left = pairs.groupBy(F.col(a).alias("label")).agg(F.sum("c").alias("ca"))
    right = pairs.groupBy(F.col(b).alias("label_b")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, F.col("label").eqNullSafe(F.col("label_b"))).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("by_chance"))
    po, pe = F.col("same") / F.col("n"), chance.select("by_chance").scalar() / (F.col("n") * F.col("n"))
    out = totals.select("n", po.alias("agreement"), pe.alias("expected"))
    value = F.when(F.col("expected") == 1, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - F.col("expected")) / (1 - F.col("expected")))
    return out.select("n", F.round("agreement", ROUNDED).alias("agreement"), F.round("expected", ROUNDED).alias("expected"), F.round(value, ROUNDED).alias("kappa"))


def jury_vote(votes: DataFrame, tie: str = "partial") -> DataFrame:
    """``(question, label)``: the label of the most votes; a tie at the top is ``partial``."""
    counts = votes.groupBy("question", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("question").agg(F.max("c").alias("most"))
    best = counts.join(top, "question").filter("c = most").groupBy("question").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    return best.select("question", F.when(F.col("n") > 1, tie).otherwise(F.col("label")).alias("label"))


def confusion(labels: DataFrame, truth: str, said: str, values: list[str]) -> DataFrame:
    """``(truth, said, n)`` for each pair of values, with zeros."""
    spark = labels.sparkSession
    grid = spark.createDataFrame([(t, s) for t in values for s in values], "truth string, said string")
    counts = labels.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("c"))
    return grid.join(counts, ["truth", "said"], "left").select("truth", "said", F.coalesce("c", F.lit(0)).alias("n"))


def gate(before: DataFrame, after: DataFrame, drop: float = 0.002) -> DataFrame:
    """``(config, metric, before, after, verdict)``: regression if a metric falls by more
    than ``drop``; missing values are their own verdicts."""
    keys = ["config", "metric"]
    both = before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys, "full")
    delta = F.round(F.col("after") - F.col("before"), 10)
    verdict = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "missing").when(delta < -drop, "regression").when(delta > drop, "improvement").otherwise("same")
    return both.withColumn("verdict", verdict)


def overlap_metrics(rows: DataFrame) -> DataFrame:
    """Of ``(id, question, answer, context, retrieved, relevant)``: faithfulness,
    relevancy, context precision at 10 and recall at 50."""
    from harrier.functions import text as T

    answer, question, context = T.tokens("answer"), T.tokens("question"), T.tokens("context")
    top10, top50 = F.slice("retrieved", 1, 10), F.slice("retrieved", 1, 50)
    precision = F.when(F.size(top10) == 0, 0.0).otherwise(F.size(F.filter(top10, lambda p: F.array_contains("relevant", p))) / F.size(top10))
    recall = F.when(F.size("relevant") == 0, 0.0).otherwise(F.size(F.array_intersect("relevant", top50)) / F.size(F.array_distinct("relevant")))
    return rows.select(
        "id",
        F.round(T.containment(answer, context), 6).alias("faithfulness"),
        F.round(T.containment(answer, question), 6).alias("answer_relevancy"),
        F.round(precision, 6).alias("context_precision"),
        F.round(recall, 6).alias("context_recall"),
    )


def metadata_union(rows: DataFrame) -> DataFrame:
    """``(item, metadata)`` of ``(item, list_no, rank, metadata map)``: of each key the value
    that occurs first, by list and rank."""
    pairs = rows.select("item", F.struct("list_no", "rank").alias("at"), F.explode("metadata").alias("key", "value"))
    first = pairs.groupBy("item", "key").agg(F.min_by("value", "at").alias("value"))
    return first.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def top_lists(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, top)``: the first ``k`` items of each query as an array."""
    by = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("l"))
    return by.select("query_id", F.transform("l", lambda x: x["item"]).alias("top"))


def changed_lists(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, changed)``: do the first ``k`` items of two runs differ?"""
    both = top_lists(a, k).withColumnRenamed("top", "a").join(top_lists(b, k).withColumnRenamed("top", "b"), "query_id", "full")
    return both.select("query_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def list_changes(before: DataFrame, after: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(query_id, dropped, gained)``: relevant items that only one run has among its
    first ``k``."""
    cut = lambda run: run.filter(F.col("rank") <= k).select("query_id", "item").join(relevant.select("query_id", "item"), ["query_id", "item"], "left_semi")
    a, b = cut(before).withColumn("a", F.lit(1)), cut(after).withColumn("b", F.lit(1))
    both = a.join(b, ["query_id", "item"], "full")
    return both.groupBy("query_id").agg(F.count_if(F.col("b").isNull()).alias("dropped"), F.count_if(F.col("a").isNull()).alias("gained"))


def load_summary(attempts: DataFrame) -> DataFrame:
    """``(phase, n, ok, error_rate, users, p50, p95)`` of ``(phase, success, user, ms)``."""
    by = attempts.groupBy("phase").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_distinct("user").alias("users"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.95).alias("p95"))
    return by.select("phase", "n", "ok", F.round(1 - F.col("ok") / F.col("n"), 6).alias("error_rate"), "users", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def paired_by_route(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(route, n, delta, better, worse)`` of two runs ``(query_id, route, value)``."""
    both = a.join(b.select("query_id", F.col("value").alias("other")), "query_id")
    delta = F.col("other") - F.col("value")
    return both.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg(delta), 6).alias("delta"), F.count_if(delta > 0).alias("better"), F.count_if(delta < 0).alias("worse"))
