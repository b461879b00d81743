"""Windows, limits and streams over events."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.catalog.base import Catalog, table
from harrier.scratch import fresh_folder
from harrier.streaming import cache
from harrier.streaming import events as E

CATALOG = Catalog()


@CATALOG.add("SELECT event_id, date_trunc('minute', ts) AS minute, CAST(row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS BIGINT) AS turn, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rate_limited(table(spark, sf_dir, "events"), 1).select("event_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "turn", "allowed")


@CATALOG.add("WITH s AS (SELECT event_id, CAST(ts AS DATE) AS day, round(sum(coalesce(value, 0)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id), 6) AS spent FROM events) SELECT event_id, day, spent, spent <= 100 AS within FROM s")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.daily_budget(table(spark, sf_dir, "events"), 100.0).select("event_id", "day", "spent", "within")


@CATALOG.add("WITH w AS (SELECT event_type, value, unnest(range(4)) AS k, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events) SELECT b - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sliding_counts(table(spark, sf_dir, "events"))


@CATALOG.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"))


@CATALOG.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = fresh_folder(spark, "stream")
    counts = E.streamed_counts(E.stream_of(spark, f"{sf_dir}/events.parquet"))
    return E.run_updates(counts, f"{place}/out", f"{place}/state", ["start", "event_type"])


@CATALOG.add("SELECT event_id, event_type FROM events")
def streamed_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = fresh_folder(spark, "stream")
    return E.run_once(E.streamed_distinct(E.stream_of(spark, f"{sf_dir}/events.parquet")), f"{place}/out", f"{place}/state").select("event_id", "event_type")


@CATALOG.add()
def semantic_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("question_id"), (F.col("vec_id") % 4).alias("shard"), F.col("vec_id").cast("double").alias("at"), F.col("embedding").alias("vector"))
    again = asked.withColumns({"question_id": F.col("question_id") + 1_000_000, "at": F.col("at") + 40.0})
    return cache.replay(asked.unionByName(again))
