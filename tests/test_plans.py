"""What the plans must look like."""

from support import DATA

import __spark_entry__
from harrier.operators import graph, lexical
from harrier.plans.engine import Config, Engine
from harrier.sources import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned(spark):
    text = plan(__spark_entry__.queries()["split_alternate"](spark, f"{DATA}/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_filter_reaches_the_scan(spark):
    text = plan(__spark_entry__.queries()["anti_join"](spark, f"{DATA}/sf0.001"))
    assert "EqualTo(o_orderstatus,F)" in text


def test_bm25_shuffles_no_tokens(spark):
    text = plan(__spark_entry__.queries()["bm25_topk"](spark, f"{DATA}/sf0.001"))
    assert "MapInArrow" in text and "Generate" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bm25_by_joins_drops_tokens_in_the_scan(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    terms = lexical.query_terms(spark.createDataFrame([(1, "the thing")], "query_id int, text string"))
    text = plan(lexical.bm25_scores(docs, terms))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "CartesianProduct" not in text
    joined, blocks = lexical.bm25_scores(docs, terms), lexical.bm25_top_k(docs, terms, 1000)
    assert sorted(map(tuple, joined.select("item", "score").collect())) == sorted(map(tuple, blocks.select("item", "score").collect()))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(__spark_entry__.queries()["top_customers"](spark, f"{DATA}/sf0.001"))


def test_a_loaded_engine_reads_no_text_to_search(spark, tmp_path):
    chunks = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").selectExpr("doc_id as chunk_id", "concat(source, '/', doc_id) as path", "text", "1.0D as mtime")
    engine = Engine(spark, chunks)
    engine.save(f"{tmp_path}/index")
    loaded = Engine.load(spark, f"{tmp_path}/index")
    terms = lexical.query_terms(spark.createDataFrame([(1, "the thing of"), (2, "qqqq"), (3, "")], "query_id int, text string"))
    hits = loaded.lexical_hits(terms, Config())
    text = plan(hits)
    assert "text:string" not in text and "MapInArrow" not in text and "PartitionFilters" in text and "bucket" in text and "CartesianProduct" not in text
    want = engine.lexical_hits(terms, Config())
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))
    queries = spark.createDataFrame([(7, "the thing of")], "query_id long, text string")
    assert [r.chunk_id for r in loaded.retrieve(queries).orderBy("rank").collect()] == [r.chunk_id for r in engine.retrieve(queries).orderBy("rank").collect()]


def test_page_rank_by_joins_is_that_of_the_matrix(spark):
    rows = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("c", "b", 2.0), ("d", "e", 1.0), ("e", "d", 1.0)]
    weights = spark.createDataFrame(rows, "a string, b string, weight double")
    seeds = spark.createDataFrame([(1, "a", 1.0), (1, "zzz", 5.0), (2, "", 0.0), (3, "b", 0.5), (3, "d", 1.5)], "query_id long, node string, mass double")
    got = [{(r.query_id, r.node): r.mass for r in graph.page_rank(weights, seeds, matrix_edges=n).collect()} for n in (100, 0)]
    assert got[0].keys() == got[1].keys() and len(got[0]) == 15
    assert all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])


def test_upserts_keep_the_last_change(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "path string, at int, v string")
    changes = spark.createDataFrame([("b", 3, "y"), ("b", 2, "z"), ("c", 1, "p"), ("c", 1, "q")], "path string, at int, v string")
    assert {tuple(r) for r in corpus.upsert(table, changes, order="at").collect()} == {("a", 1, "x"), ("b", 3, "y"), ("c", 1, "q")}


def test_page_rank_of_many_edges_shuffles_no_mass(spark, monkeypatch):
    """A quarter of a million edges still go out as a matrix: the mass of a query stays in its task."""
    monkeypatch.setattr(graph, "_page_rank_joined", None)
    n = 125_000
    one = spark.range(n).selectExpr("concat('a', id) AS a", "concat('b', id div 2) AS b", "1.0D AS weight")
    weights = one.unionByName(one.selectExpr("b AS a", "a AS b", "weight"))
    seeds = spark.createDataFrame([(1, "a4", 1.0), (2, "nowhere", 1.0)], "query_id long, node string, mass double")
    ranks = graph.page_rank(weights, seeds)
    assert {r.node for r in ranks.filter("query_id = 1 AND mass > 0").collect()} == {"a4", "a5", "b2"}
    assert ranks.filter("query_id = 2 AND mass > 0").count() == n + n // 2
