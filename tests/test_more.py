"""Bits and cosines, ranks, singular axes, probes of caches, slides, trees and plans of charts."""

import zipfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from support import DATA

import __spark_entry__
from harrier.catalog.base import docs
from harrier.functions import embedders
from harrier.operators import dense, evaluate, graph, rerank, tabular
from harrier.plans.engine import Config, Engine
from harrier.sources import judgements
from harrier.streaming import cache

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("parts", [1, 5])
def test_hamming_rescored(spark, parts):
    rng = np.random.default_rng(3)
    own = np.round(rng.normal(size=(300, 16)), 1)
    own[5], own[6] = own[4], 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)] + [(1000, None)], "vec_id long, embedding array<double>").repartition(parts)
    queries = rows.filter("vec_id % 50 = 4 OR vec_id = 1000").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r.rank): (r.item, r.score) for r in dense.hamming_rescored(rows, queries, 5, 3).collect()}
    want = {}
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    for q in range(4, 300, 50):
        near = sorted(range(300), key=lambda i: (int(((own[i] >= 0) != (own[q] >= 0)).sum()), i))[:15]
        best = sorted(((-round(float(unit[i] @ unit[q]), 10), i) for i in near))[:5]
        want |= {(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {k: (i, round(s, 9)) for k, (i, s) in got.items()} == {k: (i, round(s, 9)) for k, (i, s) in want.items()}
    assert dense.hamming_rescored(rows, queries.limit(0), 5).count() == 0
    assert dense.exact_top_k(rows, queries, 3).filter("query_id = 1000 OR item = 1000").count() == 0


@pytest.mark.parametrize("p", [0, 50, 90, 95, 100])
def test_nearest_rank(spark, p):
    stages = {"a": [3.0, 1.0, 1.0, 2.0, 9.0, 9.0], "b": [4.0], "c": [float(i % 7) for i in range(40)]}
    rows = spark.createDataFrame([(s, v) for s, vs in stages.items() for v in vs] + [("b", None)], "stage string, value double")
    got = {r.stage: r.value for r in evaluate.nearest_rank(rows, p).collect()}
    assert got == {s: sorted(vs)[round(p / 100 * (len(vs) - 1))] for s, vs in stages.items()}


def test_singular_axes(spark):
    model, rows = embedders.tfidf(docs(spark, SF), features=200)
    vectors = model.transform(rows).select("doc_id", "features").persist()
    axes = embedders.principal(vectors, 8)
    dense_rows = vectors.select("doc_id", vector_to_array("features").alias("x")).collect()
    x = np.array([r.x for r in dense_rows])
    top = np.linalg.svd(x, full_matrices=False)[2][:8].T
    assert np.allclose(axes @ axes.T, top @ top.T, atol=1e-6)
    got = {r.doc_id: np.array(r.embedding) for r in embedders.reduced(vectors, axes).select("doc_id", "embedding").collect()}
    for r in dense_rows:
        want = np.array(r.x) @ axes
        assert np.allclose(got[r.doc_id], want / max(np.linalg.norm(want), 1e-12), atol=1e-9)
    vectors.unpersist()


def test_probes_are_looked_up_and_not_added(spark):
    schema = "question_id long, shard int, at double, vector array<double>"
    asked = spark.createDataFrame([(1, 0, 0.0, [1.0, 0.0]), (2, 0, 1.0, [0.0, 1.0]), (3, 1, 2.0, [1.0, 1.0])], schema)
    probes = spark.createDataFrame([(11, 0, 5.0, [1.0, 0.01]), (12, 0, 6.0, [1.0, 1.0]), (13, 0, 7.0, [1.0, 1.0]), (14, 2, 8.0, [1.0, 0.0]), (15, 0, 9.0, [0.01, 1.0])], schema)
    found = cache.probed(asked, probes)
    assert {r.question_id: r.served_by for r in found.collect()} == {11: 1, 12: None, 13: None, 14: None, 15: 2}
    assert [r.similarity for r in found.collect() if r.question_id == 14] == [None]
    sources = spark.createDataFrame([(11, 1), (12, 1), (13, 2), (14, 1), (15, 1)], "question_id long, source_id long")
    counts = cache.probe_counts(found, sources).first()
    assert (counts.n, counts.from_source, counts.from_other, counts.misses) == (5, 1, 1, 3)
    assert counts.least_margin == pytest.approx(0.07995, abs=1e-4)
    row = __spark_entry__.queries()["cache_probes"](spark, SF).first()
    assert row.n == row.from_source + row.from_other + row.misses > 0


def test_slides(spark, tmp_path):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    page = lambda *ps: f"<x {ns}>" + "".join(f"<a:p>{''.join(f'<a:r><a:t>{r}</a:t></a:r>' for r in p)}</a:p>" for p in ps) + "</x>"
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        z.writestr("ppt/slides/slide10.xml", page(["last"]))
        z.writestr("ppt/slides/slide2.xml", page(["Tit", "le"], [], [" second é "]))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<R><r Target="../notesSlides/notesSlide7.xml"/></R>')
        z.writestr("ppt/notesSlides/notesSlide7.xml", page(["say this"]))
    (tmp_path / "b.pptx").write_bytes(b"no archive")
    rows = sorted((r.path.rsplit("/", 1)[1], r.slide or 0, r.text, r.notes) for r in judgements.read_slides(spark, f"{tmp_path}/*.pptx").collect())
    assert rows == [("a.pptx", 2, "Title\nsecond é", "say this"), ("a.pptx", 10, "last", None), ("b.pptx", 0, None, None)]


def test_trees_learn_what_a_line_cannot(spark):
    names = list(rerank.FEATURES)
    rng = np.random.default_rng(1)
    rows = [[float(x) for x in rng.random(len(names))] for _ in range(400)]
    df = spark.createDataFrame([(*r, 1.0 if (r[0] > 0.5) != (r[1] > 0.5) else 0.0) for r in rows], [*names, "teacher"])
    error = {}
    for name, fit in (("line", rerank.fit_student), ("trees", rerank.fit_trees)):
        error[name] = rerank.student_scores(fit(df), df).select(F.avg(F.pow(F.col("score") - F.col("teacher"), 2))).first()[0]
    assert error["trees"] < 0.5 * error["line"]
    with pytest.raises(ValueError, match="eight"):
        rerank.fit_trees(df.limit(7))


@pytest.mark.parametrize(("question", "chart", "baseline"), [
    ("mean rmse by encoder against the 0.05 baseline", "dot", 0.05), ("distribution of rmse", "histogram", None), ("rmse over time", "line", None), ("rmse by encoder", "bar", None), ("target-free", "dot", None),
])
def test_charts(spark, question, chart, baseline):
    rows = spark.createDataFrame([("a", "0.5"), ("a", "0.7"), ("b", "x"), ("b", "1"), ("b", "2")], "encoder string, rmse string").filter("rmse <> 'x'")
    p = tabular.propose(rows, question)
    assert (p.group, p.value, p.chart, p.baseline, p.operation, p.slug) == ("encoder", "rmse", chart, baseline, "mean", "mean-rmse-by-encoder")
    assert {tuple(r) for r in p.rows.collect()} == {("a", 0.6, 2), ("b", 1.5, 2)}


def test_named_chart(spark):
    rows = spark.createDataFrame([("a", "0.5")], "encoder string, rmse string")
    p = tabular.propose(rows, "the trend", chart="bar")
    assert (p.chart, p.alternatives) == ("bar", ("line", "dot"))


def test_expansion_in_the_order_of_seeds(spark):
    edges = spark.createDataFrame([("a", "m", "x"), ("b", "a", "x"), ("c", "z", "x"), ("c", "y", "x"), ("c", "q", "other")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "c", 3), (2, "a", 1), (2, "b", 2), (3, "lonely", 1)], "query_id int, seed string, rank int")
    rows = graph.expanded(seeds, edges, 1, ["x"]).orderBy("position").collect()
    assert {q: [r.node for r in rows if r.query_id == q] for q in (1, 2, 3)} == {1: ["c", "y", "z", "a", "b", "m"], 2: ["a", "b", "m"], 3: ["lonely"]}


def test_samples(spark):
    rows = spark.createDataFrame([(3, "c", None), (1, "a", None), (2, "a", ""), (4, "d", None), (5, "b", None), (6, "e", None)], "at int, x string, y string")
    assert {r.column: r.sample for r in tabular.samples(rows, "at").collect()} == {"x": ["a", "c", "d", "b"], "y": []}
    assert {r.column: r.sample for r in tabular.samples(rows.limit(0), "at").collect()} == {"x": [], "y": []}


def _chunks(spark):
    return spark.createDataFrame([(1, "src/a.py", "alpha beta gamma", 1.0), (2, "src/b.py", "alpha alpha", 1.0), (3, "notes.md", "beta", 1.0)], "chunk_id long, path string, text string, mtime double")


def test_engine_takes_legs_and_rerankers(spark):
    queries = spark.createDataFrame([(1, "where do alpha and beta meet in the notes")], "query_id long, text string")
    only = Engine(spark, _chunks(spark)).retrieve(queries, Config(legs=("bm25",), reranked=False)).collect()
    assert {r.chunk_id for r in only} == {1, 2, 3} and all(r.dense is None and r.bm25 is not None and r.rerank is None and r.degraded == [] for r in only)
    with pytest.raises(ValueError, match="legs"):
        Config(legs=("sparse",))
    with pytest.raises(ValueError, match="legs"):
        Config(legs=())
    shortest = Engine(spark, _chunks(spark), reranker=lambda pairs: [-float(len(t)) for _, t in pairs]).retrieve(queries).orderBy("rank").collect()
    assert [r.chunk_id for r in shortest] == [3, 2, 1] and shortest[0].degraded == []
    lost = Engine(spark, _chunks(spark), reranker_error="no weights")
    assert {tuple(r.degraded) for r in lost.retrieve(queries).collect()} == {("rerank: no weights",)}
    assert {tuple(r.degraded) for r in lost.retrieve(queries, Config(reranked=False)).collect()} == {()}
