"""The routed index against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from harrier.operators import dense as D
from harrier.operators import routed as G


@pytest.fixture(scope="module")
def clustered(spark):
    """Sixty clusters of forty vectors, nulls, an item twice, and a zero vector."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24)) * 3
    rows = [(i, (centres[i % 60] + rng.normal(size=24)).tolist()) for i in range(2400)]
    return spark.createDataFrame([*rows, (9000, None), rows[7], (9001, [0.0] * 24)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("routed") / "i")
    G.write_routed(clustered, place, cell_rows=60, shard_rows=100)
    return G.read_routed(spark, place)


def asked(vectors):
    return vectors.filter("vec_id % 100 = 0 or vec_id is null").select(F.col("vec_id").alias("query_id"), "embedding")


def recall(found, exact):
    return D.tie_aware_recall(found, exact, 10).agg(F.avg("recall")).first()[0]


def test_few_shards_hold_the_nearest(clustered, index):
    q = asked(clustered)
    exact = D.exact_top_k(clustered.dropDuplicates(["vec_id"]), q, 10)
    for ef in (40, None):
        assert recall(G.routed_top_k(index, q, 10, ef, probes=4), exact) >= 0.95
    r = G.shards_read(index, q, probes=4).agg(F.max("read"), F.max("shards")).first()
    assert r[0] < 0.4 * r[1] and r[1] > 40
    assert {x.query_id for x in G.routed_top_k(index, q, 3, probes=4).collect()} == {x.query_id for x in q.filter("embedding is not null").collect()}


def test_every_vector_is_indexed(clustered, index):
    items = index.shards.select(F.explode("items").alias("item")).groupBy("item").count()
    assert items.count() == 2401 and items.filter(f"count <> {G.SPILL}").count() == 0
    q = asked(clustered)
    whole = G.routed_top_k(index, q, 10, None, probes=10_000).collect()
    exact = D.exact_top_k(clustered.dropDuplicates(["vec_id"]), q, 10).collect()
    assert {(r.query_id, r["rank"], r["item"], round(r.score, 6)) for r in whole} == {(r.query_id, r["rank"], r["item"], round(r.score, 6)) for r in exact}


def test_only_probed_folders_are_read(index, clustered):
    plan = G.routed_top_k(index, asked(clustered).filter("query_id = 100"), 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ IN \(\d+,\d+\)", plan)


def test_blocks_of_queries_and_nothing_broadcast_by_cell(clustered, index, monkeypatch):
    """Queries with their vectors, once for each cell that they look into, were a broadcast table in the driver."""
    q = asked(clustered)
    for ef in (20, None):
        monkeypatch.setattr(D, "QUERY_BLOCK", 4_096)
        whole = {tuple(r) for r in G.routed_top_k(index, q, 5, ef, probes=4).collect()}
        monkeypatch.setattr(D, "QUERY_BLOCK", 7)
        found = G.routed_top_k(index, q, 5, ef, probes=4)
        assert {tuple(r) for r in found.collect()} == whole and len(whole) > 100
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("MapInArrow") >= 3


def test_layers_and_the_walk():
    rng = np.random.default_rng(2)
    own = D.unit_rows(rng.normal(size=(900, 8))).astype(np.float32)
    layers = G.build_layers(own, 12, 0)
    assert [len(m) for m, _ in layers] == [3, 56, 900] or [len(m) for m, _ in layers] == [56, 900]
    assert all(set(a.tolist()) <= set(b.tolist()) for (a, _), (b, _) in zip(layers, layers[1:]))
    queries = D.unit_rows(rng.normal(size=(50, 8))).astype(np.float32)
    exact = np.argsort(-(queries @ own.T), axis=1)[:, :10]
    hits = [[len(set(a) & set(b)) for a, b in zip(G.beam_search(own, layers, queries, ef)[:, :10].tolist(), exact.tolist())] for ef in (10, 40, 900)]
    assert np.mean(hits[0]) <= np.mean(hits[1]) and np.mean(hits[1]) >= 9.5 and np.mean(hits[2]) >= 9.9
    start = np.einsum("qd,qd->q", own[G.descend(own, layers, queries)], queries)
    assert np.median(start) > np.median(queries @ own[0])


def test_nothing_to_find(spark, clustered, index, tmp_path):
    q = asked(clustered)
    assert G.routed_top_k(index, q.limit(0), 3).count() == 0
    G.write_routed(clustered.limit(0), f"{tmp_path}/none")
    assert G.routed_top_k(G.read_routed(spark, f"{tmp_path}/none"), q, 3).count() == 0
    G.write_routed(clustered.filter("vec_id = 5"), f"{tmp_path}/one")
    assert {r["item"] for r in G.routed_top_k(G.read_routed(spark, f"{tmp_path}/one"), q, 3).collect()} == {5}


def test_recall_of_the_table(spark):
    import __spark_entry__

    rows = {r.ef: r for r in __spark_entry__.queries()["routed_recall"](spark, f"{DATA}/sf0.1").collect()}
    assert all(r.recall >= 0.9 and r.shards_read < 0.6 for r in rows.values()) and rows[10].recall <= rows[160].recall <= rows[0].recall
