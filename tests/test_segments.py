"""The segmented index against an index built anew from what is alive."""

import os
import random

import pytest
from support import rows_of

from harrier.operators import lexical as L
from harrier.streaming.segments import SegmentedIndex, index_stream

WORDS = "red green blue fox dog cat the of".split()
SCHEMA = "item long, text string, deleted boolean"


def asked(spark):
    return L.query_terms(spark.createDataFrame([(1, "red fox"), (2, "the dog dog"), (3, "cat of none")], "query_id long, text string"))


def anew(spark, alive, k=5):
    docs = spark.createDataFrame(sorted(alive.items()), "doc_id long, text string")
    return rows_of(L.bm25_top_k(docs, asked(spark), k))


def changes(rng, alive, n):
    """Inserts, changes, deletions (of unknown items too), and items that change twice in the batch."""
    rows = []
    for _ in range(n):
        item, gone = rng.randrange(30), rng.random() < 0.25
        text = None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))
        rows.append((item, text, gone, len(rows)))
    for item, text, gone, _ in rows:
        alive.pop(item, None)
        if not gone:
            alive[item] = text or ""
    return rows


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_are_those_of_a_new_index(spark, tmp_path, seed):
    rng, alive, index = random.Random(seed), {}, SegmentedIndex(spark, f"{tmp_path}/i", buckets=3, fanout=3)
    assert index.top_k(asked(spark), 5).count() == 0 and index.head().version == -1
    for batch in range(7):
        before, head = files(f"{tmp_path}/i/data"), index.head()
        commit = index.apply(spark.createDataFrame(changes(rng, alive, 12), f"{SCHEMA}, turn int"), batch, "turn")
        assert {f: t for f, t in files(f"{tmp_path}/i/data").items() if f in before} == before  # nothing is rewritten
        assert rows_of(index.top_k(asked(spark), 5)) == anew(spark, alive)
        assert (commit.n, commit.total) == (len(alive), sum(len(t.split()) for t in alive.values())) and index.verify().count() == 0
        # an old commit still answers as it did
        if head.version >= 0 and batch == 3:
            assert index.top_k(asked(spark), 5, commit=head).count() > 0
    assert max(s.level for s in index.head().segments) >= 1 and len(index.head().segments) <= 4
    assert index.vacuum() and index.vacuum() == []
    assert rows_of(index.top_k(asked(spark), 5)) == anew(spark, alive) and index.verify().count() == 0


def test_a_batch_that_comes_again_does_nothing(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/i", buckets=2)
    rows = spark.createDataFrame([(1, "red fox", False), (2, "dog", None), (None, "cat", False)], SCHEMA)
    first = index.apply(rows, 0)
    assert index.apply(rows, 0) == first and first.n == 2
    last = index.apply(spark.createDataFrame([(1, None, True), (7, None, True)], SCHEMA), 1)
    assert (last.n, last.total) == (1, 1) and {r["item"] for r in index.items().collect()} == {2}
    again = index.apply(spark.createDataFrame([(1, "red", False)], SCHEMA), 2)
    assert again.n == 2 and {r["item"] for r in index.top_k(asked(spark), 5).collect()} == {1, 2}
    empty = index.apply(rows.limit(0), 3)
    assert empty.n == 2 and index.verify().count() == 0


def test_a_second_writer_fails(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/i", buckets=2)
    head = index.apply(spark.createDataFrame([(1, "red", False)], SCHEMA), 0)
    with pytest.raises(Exception, match="(?i)exist"):
        index._commit(head)


def test_damage_is_found(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/i", buckets=2)
    commit = index.apply(spark.createDataFrame([(1, "red fox", False), (2, "dog", False)], SCHEMA), 0)
    folder = commit.segments[0].folder
    kept = spark.read.parquet(f"{folder}/postings").filter("item = 1").collect()
    spark.createDataFrame(kept).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    assert {(r.check, r.expected, r.found) for r in index.verify().collect()} == {("segment 0 postings", 3, 2), ("uneven", 0, 1)}


def test_a_stream_is_indexed_and_restarted(spark, tmp_path):
    rng, alive, index = random.Random(5), {}, SegmentedIndex(spark, f"{tmp_path}/i", buckets=2, fanout=3)
    for part in range(5):
        rows = changes(rng, alive, 10)
        spark.createDataFrame(rows, f"{SCHEMA}, turn int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if part in (1, 4):  # two files each time, one micro-batch for each
            stream = spark.readStream.schema(f"{SCHEMA}, turn int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            index_stream(stream, index, f"{tmp_path}/check", "turn")
            assert rows_of(index.top_k(asked(spark), 5)) == anew(spark, alive) and index.head().batch == part
    assert index.verify().count() == 0
