"""The semantic cache as keyed state of a stream, against the replay of the table."""

import time

import numpy as np
from pyspark.errors import AnalysisException

from harrier.streaming import cache


def questions(n=120, seed=4):
    """Vectors around twelve centres in three shards: many are near enough to be served."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    return [(i, i % 3, float(10 * i + rng.integers(0, 9)), (centres[rng.integers(0, 12)] + rng.normal(size=6) * 0.08).tolist()) for i in range(n)]


SCHEMA = "question_id long, shard long, at double, vector array<double>"


def rows(df):
    return sorted((r.shard, r.question_id, r.served_by) for r in df.collect())


def streamed(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_restarted_stream_serves_what_the_replay_serves(spark, tmp_path):
    made = questions()
    limits = dict(similarity=0.95, ttl=600.0, size=5)  # entries expire and are evicted
    for part in range(4):
        spark.createDataFrame(made[30 * part : 30 * part + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (1, 3):  # two micro-batches, then a restart and two more
            cache.serve(streamed(spark, tmp_path), f"{tmp_path}/out", f"{tmp_path}/check", **limits)
            seen = spark.createDataFrame(made[: 30 * part + 30], SCHEMA)
            want = rows(cache.replay(seen, 3, **limits))
            assert rows(spark.read.parquet(f"{tmp_path}/out")) == want
    assert 20 < sum(s is not None for *_, s in want) < 110
    once = rows(cache.replay(spark.createDataFrame(made, SCHEMA), 3, similarity=0.95, ttl=1e9, size=1000))
    assert once != want


def waited(spark, path, n):
    """The rows of a table that is being written, once there are ``n``."""
    for _ in range(60):
        time.sleep(0.5)
        try:
            found = rows(spark.read.schema("shard long, question_id long, served_by long").parquet(path))
        except AnalysisException:  # not there yet
            continue
        if len(found) >= n:
            return {q: s for _, q, s in found}
    raise AssertionError("nothing was written")


def test_a_timer_forgets_an_idle_shard(spark, tmp_path):
    vector, found = [1.0, 0.0], {}
    for name, idle in (("kept", 3_600_000), ("lost", 1)):
        spark.createDataFrame([(0, 0, 0.0, vector)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/in")
        query = cache.serving(streamed(spark, f"{tmp_path}/{name}"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/check", idle_ms=idle, processingTime="1 second")
        try:
            waited(spark, f"{tmp_path}/{name}/out", 1)
            time.sleep(4)  # batches without questions let timers fire
            spark.createDataFrame([(1, 0, 1.0, vector)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            found[name] = waited(spark, f"{tmp_path}/{name}/out", 2)[1]
        finally:
            query.stop()
    assert found == {"kept": 0, "lost": None}
