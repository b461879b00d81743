"""Rerankers: by overlap, by learned features, and by a listwise reply."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.shipping import ship

FEATURES = ("dense_cosine", "bm25_score", "rrf_score", "rrf_rank", "jaccard", "exact_overlap", "path_depth", "recency", "is_yaml", "is_log", "is_code", "is_csv", "is_md")
#: The extensions behind the five flags.
KINDS = {"is_yaml": ("yaml", "yml"), "is_log": ("out", "log"), "is_code": ("py", "js", "java", "sbatch", "sh"), "is_csv": ("csv", "jsonl", "json"), "is_md": ("md", "txt")}


def exact_share(query: Column, text: Column) -> Column:
    """The share of the query's tokens, repeats counted, that the text has."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.filter(query, lambda t: F.array_contains(text, t))) / F.size(query))


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """Pairs ``(query_id, item, query, path, text, rrf)`` with ``score``: exact share and
    Jaccard similarity, .25 for a path whose name the query holds, and .05 of the fused score."""
    # columns of their own, so that each row is tokenised once
    cut = pairs.withColumns({"_q": T.tokens("query"), "_d": F.array_distinct(T.tokens("text"))})
    q, d = F.col("_q"), F.col("_d")
    named = F.when(F.lower("query").contains(F.lower(T.basename("path"))), 0.25).otherwise(0.0)
    score = exact_share(q, d) + T.jaccard(q, d) + named + F.lit(0.05) * F.coalesce("rrf", F.lit(0.0))
    return cut.withColumn("score", F.round(score, 10)).drop("_q", "_d")


def features(pairs: DataFrame) -> DataFrame:
    """Pairs ``(query_id, item, query, path, text, mtime, dense, bm25, rrf, rank)`` with the
    thirteen features; missing scores are 0, and recency is the time by the query's latest."""
    q, d = T.tokens("query"), T.tokens("text")
    latest = F.max("mtime").over(Window.partitionBy("query_id"))
    end = F.regexp_replace(T.suffix("path"), r"^\.", "")
    zero = F.lit(0.0)
    columns = {
        "dense_cosine": F.coalesce(F.col("dense"), zero),
        "bm25_score": F.coalesce(F.col("bm25"), zero),
        "rrf_score": F.coalesce(F.col("rrf"), zero),
        "rrf_rank": F.coalesce(F.col("rank").cast("double"), zero),
        "jaccard": F.round(T.jaccard(q, d), 10),
        "exact_overlap": F.round(exact_share(q, d), 10),
        "path_depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double"),
        "recency": F.when((latest > 0) & (F.col("mtime") != 0), F.round(F.col("mtime") / latest, 10)).otherwise(zero),
    } | {name: F.when(end.isin(*ends), 1.0).otherwise(0.0) for name, ends in KINDS.items()}
    return pairs.select("query_id", "item", *(c.alias(name) for name, c in columns.items()))


def model_scores(pairs: DataFrame, score: Callable[[list[tuple[str, str]]], Sequence[float]] | None, allow_fallback: bool = False, batch: int = 64) -> DataFrame:
    """``(query_id, item, score, backend)`` by a function over batches of ``(query, text)``:
    a cross-encoder, say, that workers load when it is first called. Scores are squashed to
    (0, 1). Without a function it is an error, unless the overlap may stand in; ``backend``
    tells which it was."""
    if score is None:
        if not allow_fallback:
            raise ValueError("no model is given; allow the fallback to rerank by overlap")
        return overlap_scores(pairs).select("query_id", "item", "score", F.lit("overlap").alias("backend"))
    ship(pairs.sparkSession)
    types = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "item")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                asked = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([float(x) for x in score(asked)], pa.float64())], names=["query_id", "item", "raw"])

    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("query", "text")]
    raw = pairs.select("query_id", "item", *texts).mapInArrow(run, f"query_id {types['query_id']}, item {types['item']}, raw double")
    return raw.select("query_id", "item", F.round(sigmoid(F.col("raw")), 10).alias("score"), F.lit("model").alias("backend"))


def listwise_prompts(pairs: DataFrame, depth: int = 20) -> DataFrame:
    """``(query_id, n, prompt)``: each query's first passages, numbered from 1, with the
    question which order they should have, as a chain of numbers."""
    head = pairs.filter(F.col("rank") <= depth)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    by = head.groupBy("query_id").agg(F.first("query").alias("query"), F.count("*").alias("n"), lines.alias("lines"))
    asked = F.concat(F.lit("Question: "), F.coalesce("query", F.lit("")), F.lit("\nPassages:\n"), F.array_join("lines", "\n"), F.lit("\nOrder all passages by how well they answer the question, best first, as [2] > [1]. Give the order alone."))
    return by.select("query_id", "n", asked.alias("prompt"))


def fit_student(examples: DataFrame, label: str = "teacher"):
    """Least squares of the teacher's score on the features, with an intercept; needs
    eight examples."""
    if examples.limit(8).count() < 8:
        raise ValueError("a student needs eight examples")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples)
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0).fit(rows)


def fit_trees(examples: DataFrame, label: str = "teacher", trees: int = 20, depth: int = 3, seed: int = 0):
    """Boosted trees of the teacher's score on the features; needs eight examples."""
    if examples.limit(8).count() < 8:
        raise ValueError("a student needs eight examples")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples)
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(rows)


def student_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)).withColumnRenamed("prediction", "score").drop("features")


def read_permutation(replies: DataFrame) -> DataFrame:
    """Replies ``(query_id, reply, n)`` with ``order array<int>`` (from 0) and ``status``:
    a chain like ``[2] > [1]`` that names each of the n passages once, else the order as it was."""
    text = F.trim(F.coalesce("reply", F.lit("")))
    ids = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) - 1)
    chain = text.rlike(r"^\[\d+\](?:\s*>\s*\[\d+\])*$")
    status = (
        F.when(text == "", "no_completion").when(~chain, "not_a_chain").when(F.exists(ids, lambda i: (i < 0) | (i >= F.col("n"))), "out_of_range").when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_id").when(F.size(ids) < F.col("n"), "partial").otherwise("permutation")
    )
    as_it_was = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return replies.withColumn("status", status).withColumn("order", F.when(F.col("status") == "permutation", ids).otherwise(as_it_was)).select("query_id", "order", "status")


def sigmoid(score: Column) -> Column:
    """The logistic function, in the branch that doesn't overflow."""
    return F.when(score >= 0, 1 / (1 + F.exp(-score))).otherwise(F.exp(score) / (1 + F.exp(score)))


def choose(scores: DataFrame, settings: list[str], rounded: int = 8) -> DataFrame:
    """The setting with the best mean on part 0 of ``scores (settings..., query_id, part,
    value)``, of equals the first in order, with its mean there and on part 1, which took
    no part in the choice: ``(settings..., chosen_by, held_out)``."""
    by = scores.groupBy(*settings).agg(F.round(F.avg(F.when(F.col("part") == 0, F.col("value"))), rounded).alias("chosen_by"), F.round(F.avg(F.when(F.col("part") == 1, F.col("value"))), rounded).alias("held_out"))
    return by.orderBy(F.desc("chosen_by"), *settings).limit(1)
