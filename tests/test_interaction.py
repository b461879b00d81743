"""Late interaction from an index against all pairs."""

import numpy as np
from pyspark.sql import functions as F
from support import DATA

from harrier.operators import dense as D
from harrier.operators import interaction as I
from harrier.operators.ranking import top_k


def made(spark):
    """Two hundred items with one to five token vectors near thirty topics, and a null."""
    rng = np.random.default_rng(3)
    topics = rng.normal(size=(30, 12)) * 2
    rows = [(i, (topics[(i + 7 * k) % 30] + rng.normal(size=12)).tolist()) for i in range(200) for k in range(1 + i % 5)]
    tokens = spark.createDataFrame([*rows, (900, None)], "item long, vec array<double>")
    asked = [(q, p, (topics[(5 * q + 7 * p) % 30] + rng.normal(size=12) * 0.5).tolist()) for q in range(8) for p in range(3)]
    return tokens, spark.createDataFrame([*asked, (0, 9, None), (77, 0, None)], "query_id long, pos int, vec array<double>")


def test_all_probes_are_exact_and_few_find_most(spark):
    tokens, asked = made(spark)
    index = I.index_tokens(tokens, 24)
    exact = D.maxsim(tokens.filter("vec is not null"), asked.filter("vec is not null"))
    whole = {(r.query_id, r["item"]): r.score for r in I.late_interaction(index, asked, 24, None).collect()}
    assert whole == {(r.query_id, r["item"]): r.score for r in exact.collect()} and len(whole) == 8 * 200
    few = I.late_interaction(index, asked, 6, 30)
    assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] == 30
    recall = D.tie_aware_recall(top_k(few, 5), top_k(exact, 5), 5).agg(F.avg("recall"), F.count("*")).first()
    assert recall[0] >= 0.9 and recall[1] == 8
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_are_not_shuffled(spark):
    """A task hands on the best of each query only, and the cut is that of a plain ranking."""
    tokens, asked = made(spark)
    index = I.index_tokens(tokens, 24)
    whole = D.maxsim(tokens, asked)
    best = {(r.query_id, r["item"], r.score) for r in top_k(whole, 5).collect()}
    cut = D.maxsim(tokens, asked, 5)
    assert {(r.query_id, r["item"], r.score) for r in top_k(cut, 5).collect()} == best
    assert cut.count() <= 9 * 5 * cut.rdd.getNumPartitions() < whole.count() == 9 * 201
    wanted = {x for x in best if x[0] != 77 and x[2] is not None}
    assert {(r.query_id, r["item"], r.score) for r in top_k(I.late_interaction(index, asked, 24, None, 5), 5).collect()} == wanted and len(wanted) == 40
    every = I.late_interaction(index, asked, 6, 10**6).groupBy("query_id").count().collect()
    for keep in (1, 17, 120):
        few = I.late_interaction(index, asked, 6, keep).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in few} == {r.query_id: min(keep, r["count"]) for r in every}
    # with all centroids probed, the estimate ranks as the score does
    ranked = {(r.query_id, r["item"]) for r in top_k(whole.filter("query_id <> 77 and score is not null"), 9).collect()}
    assert len(ranked & {(r.query_id, r["item"]) for r in I.late_interaction(index, asked, 24, 9).collect()}) >= len(ranked) - 2


def test_nothing_to_meet(spark):
    tokens, asked = made(spark)
    for some in (tokens.limit(0), tokens.filter("item = 900")):
        assert I.late_interaction(I.index_tokens(some), asked).count() == 0
    index = I.index_tokens(tokens.filter("item = 3"), 5)
    assert {r["item"] for r in I.late_interaction(index, asked, 5).collect()} == {3}
    assert I.late_interaction(index, asked.limit(0)).count() == 0


def test_recall_of_the_table(spark):
    import __spark_entry__

    found = [r.recall for r in __spark_entry__.queries()["late_interaction_recall"](spark, f"{DATA}/sf0.1").collect()]
    assert len(found) == 20 and sum(found) / len(found) >= 0.9
