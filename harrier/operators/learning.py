"""Pieces of reinforcement learning on search: trajectories, masks and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trajectories(rows: DataFrame) -> DataFrame:
    """``rows (id, text)`` with ``searches``, ``informations`` and ``answer`` from the tags."""
    get = lambda tag: F.regexp_extract_all("text", F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return rows.select("id", F.transform(get("search"), lambda x: F.trim(x)).alias("searches"), F.transform(get("information"), lambda x: F.trim(x)).alias("informations"), F.trim(F.coalesce(F.try_element_at(get("answer"), F.lit(1)), F.lit(""))).alias("answer"))


def advantages(rewards: DataFrame) -> DataFrame:
    """``rewards (group, id, reward)`` with ``advantage``: the distance from the group's mean
    by its deviation; 0 in a group of one."""
    of = Window.partitionBy("group")
    value = (F.col("reward") - F.avg("reward").over(of)) / (F.stddev_pop("reward").over(of) + 1e-8)
    return rewards.withColumn("advantage", F.round(F.when(F.count("*").over(of) > 1, value).otherwise(0.0), 6))


def masked_nll(tokens: DataFrame) -> DataFrame:
    """``(id, nll)``: the mean of the negative log probabilities where ``mask`` is set."""
    return tokens.groupBy("id").agg(F.round(F.coalesce(-F.avg(F.when(F.col("mask"), F.col("logprob"))), F.lit(0.0)), 8).alias("nll"))


def rewards(rows: DataFrame) -> DataFrame:
    """``rows (id, exact, ndcg, jury, n_search, uncited)`` with ``reward``."""
    value = F.col("exact") + 0.5 * F.col("ndcg") + 0.3 * F.col("jury") - 0.1 * F.col("n_search") - F.col("uncited")
    return rows.withColumn("reward", F.round(value, 8))
