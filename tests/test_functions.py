"""Functions and operators against literal cases and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.functions import vectors as V
from harrier.functions.porter import Stemmer
from harrier.operators import chunking, dense, evaluate, evidence, graph, lexical, ranking, versions
from harrier.streaming.cache import SemanticCache


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")])
def test_porter(word, stem):
    assert Stemmer()(word) == stem


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="see --num_pairs=3 in configs/run_047.yaml") == ["see", "--num_pairs", "3", "in", "configs/run_047.yaml"]
    assert one(spark, T.lexical_query("t"), t="Current learning-rate for run_047!") == "current or learning or rate or for or run_047"
    assert one(spark, T.tokens("t"), t=None) == []
    assert one(spark, T.word_runs("t"), t="über straße año") == ["über", "straße", "año"]


def test_paths(spark):
    assert [one(spark, f("p"), p="a/b.c/d.tar.GZ") for f in (T.basename, T.parent, T.suffix, T.stem)] == ["d.tar.GZ", "a/b.c", ".gz", "d.tar"]
    assert [one(spark, f("p"), p=".env") for f in (T.suffix, T.stem)] == ["", ".env"]
    assert one(spark, T.run_id("p"), p="configs/run_047.yaml") == "47" and one(spark, T.run_id("p"), p="x") is None
    assert one(spark, T.glob_match("p", "a/*.[ch]"), p="a/b.c") and not one(spark, T.glob_match("p", "a/?.c"), p="a/bb.c")


def test_literal_within(spark):
    assert one(spark, T.literal_within(F.col("v"), F.col("t")), v="0.055", t="is 0.055,") and not one(spark, T.literal_within(F.col("v"), F.col("t")), v="0.055", t="is 0.0559")


def test_bm25_ties(spark):
    texts = ["star cell", "heart", "cell star", "star cell", "star cell", "fibre", "star cell"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    terms = lexical.query_terms(spark.createDataFrame([(1, "cell star cell")], "query_id int, text string"))
    rows = sorted(lexical.bm25_top_k(docs, terms, 3).collect(), key=lambda r: r.rank)
    assert [r.item for r in rows] == [0, 2, 3] and len({r.score for r in rows}) == 1
    nothing = lexical.query_terms(spark.createDataFrame([(1, "absent")], "query_id int, text string"))
    assert lexical.bm25_top_k(docs, nothing, 3).count() == 0


def test_bm25_ignores_partitions(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(60)], "doc_id int, text string")
    terms = lexical.query_terms(spark.createDataFrame([(1, "a b c"), (2, "h h")], "query_id int, text string"))
    runs = [sorted(map(tuple, lexical.bm25_top_k(docs.repartition(n), terms, 10).collect())) for n in (1, 7, 20)]
    assert runs[0] == runs[1] == runs[2]


def test_rrf(spark):
    a, b = (spark.createDataFrame([(1, x, i) for i, x in enumerate(items, 1)], "query_id int, item string, rank int") for items in ("ab", "bc"))
    got = {r.item: r.rrf for r in ranking.weighted_rrf([a, b], [2, 0.5]).collect()}
    assert got == {"a": round(2 / 61, 10), "b": round(2 / 62 + 0.5 / 61, 10), "c": round(0.5 / 62, 10)}
    for weights in ([0, 1], [1], [float("nan"), 1], [float("inf"), 1]):
        with pytest.raises(ValueError):
            ranking.weighted_rrf([a, b], weights)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd", 1)], "query_id int, item string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "x", 1), (2, "b", 1)], "query_id int, item string, grade int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: (r.recall, r.mrr) for r in evaluate.metrics(hits, qrels, queries, 1).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_intervals(spark):
    n = 100
    scores = spark.createDataFrame([(i, 0.5) for i in range(n)], "pos long, value double")
    row = evaluate.interval(scores, evaluate.bootstrap_indices(spark, n, 50)).first()
    assert (row["mean"], row.low, row.high) == (0.5, 0.5, 0.5)
    a = spark.createDataFrame([(i, 0.1 + i) for i in range(n)], "query_id long, value double")
    b = spark.createDataFrame([(i, float(i)) for i in range(n)], "query_id long, value double")
    row = evaluate.paired_interval(a, b, evaluate.bootstrap_indices(spark, n, 50)).first()
    assert round(row["mean"], 6) == round(row.low, 6) == round(row.high, 6) == 0.1


def test_kappa_of_identical_labels(spark):
    same = spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")
    one_label = spark.createDataFrame([("x", "x")], "a string, b string")
    assert evaluate.kappa(same, "a", "b").first().kappa == 1.0 and evaluate.kappa(one_label, "a", "b").first().kappa == 1.0


def test_exact_search_equals_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    m[5] = m[9]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    q = rows.filter("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit[:10] @ unit.T, 10)
    want = {(i, k + 1): int(j) for i in range(10) for k, j in enumerate(np.lexsort((np.arange(200), -scores[i]))[:7])}
    for n in (1, 5):
        got = {(r.query_id, r.rank): r.item for r in dense.exact_top_k(rows.repartition(n), q, 7).collect()}
        assert got == want


def test_graph_search_recall(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(600)], "vec_id long, embedding array<float>")
    q = rows.filter("vec_id < 30").withColumnRenamed("vec_id", "query_id")
    recall = dense.tie_aware_recall(dense.graph_top_k(rows, q, 10), dense.exact_top_k(rows, q, 10), 10)
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9


def test_half_precision(spark):
    row = spark.createDataFrame([([0.1, 1.0, 70000.0],), (None,)], "v array<float>").select(V.to_half("v").alias("h")).collect()
    assert row[0].h[0] == float(np.float16(0.1)) and math.isinf(row[0].h[2]) and row[1].h is None


def test_chunkers():
    text = "intro\n# A\nx\n~~~\n# no\n~~~~\n# B\n"
    assert [text[a:b] for a, b, *_ in chunking.markdown(text)] == ["intro\n", "# A\nx\n~~~\n# no\n~~~~\n", "# B\n"]
    code = "import os\n\n@d\ndef f():\n    pass\n\nclass C:\n    x = 1\n\ny = 2\n"
    assert [(kind, code[a:b].splitlines()[0]) for a, b, kind, _ in chunking.python_blocks(code)] == [("ast", "import os"), ("ast", "@d"), ("ast", "class C:"), ("ast", "y = 2")]
    sheet = 'a,b\n1,"x\ny"\n2,z\n'
    assert [sheet[a:b] for a, b, *_ in chunking.csv_rows(sheet)] == ["a,b\n", '1,"x\ny"\n', "2,z\n"]
    assert [c[4] for c in chunking.chunks_of("t.csv", sheet)] == ["a,b\n", 'a,b\n1,"x\ny"\n', "a,b\n2,z\n"]
    assert list(chunking.chunks_of("t.md", "")) == [] and list(chunking.chunks_of("t.md", "  \n ")) == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 974, 975, 2000])
def test_windows_equal_python(spark, n):
    text = "".join(random.Random(n).choice("ab \n") for _ in range(n))
    rows = chunking.fixed_chunks(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert sorted((r.start, r.end, r.text) for r in rows) == sorted((a, b, text[a:b]) for a, b, *_ in chunking._fixed(text) if text[a:b].strip())


def test_prefer_current(spark):
    chunks = spark.createDataFrame([("archive/a_v1.yaml", 1.0), ("a.yaml", 9.0), ("b.md", 2.0)], "path string, mtime double")
    found = versions.clusters(chunks)
    hits = spark.createDataFrame([(1, "value", "archive/a_v1.yaml", 1), (1, "value", "a.yaml", 2), (2, "between", "archive/a_v1.yaml", 1), (2, "between", "a.yaml", 2)], "query_id int, query string, path string, rank int")
    assert sorted((r.query_id, r.path, r.rank) for r in versions.prefer_current(hits, found).collect()) == [(1, "a.yaml", 1), (2, "a.yaml", 2), (2, "archive/a_v1.yaml", 1)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in graph.connected(edges).collect()}
    assert len(got) == 63 and {v for k, v in got.items() if k.startswith("n")} == {"n000"} and got["y"] == "x"


def test_components_that_still_move_are_an_error(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "a string, b string")
    with pytest.raises(RuntimeError, match="did not settle in 2 rounds"):
        graph.connected(edges, rounds=2)


def test_claims(spark):
    answers = spark.createDataFrame([(1, "Run 47 has val_rmse 0.055 [a.md:0-99]. Tiny. The file is configs/run_1.yaml now.")], "id int, answer string")
    found = evidence.claims(answers)
    assert sorted((r.value or "", r.cited_path or "") for r in found.collect()) == [("0.055", "a.md"), ("1", "configs/run_1.yaml"), ("47", "a.md")]
    held = evidence.verified(found, spark.createDataFrame([(1, "a.md", "run 47: 0.0559")], "id int, path string, text string"))
    assert {(r.value, r.verified, r.missing_path) for r in held.collect()} == {("47", True, False), ("0.055", False, False), ("1", False, True)}


def test_cache():
    c = SemanticCache(0.9, 10, 2)
    a, b, d = np.array([1.0, 0, 0]), np.array([0, 1.0, 0]), np.array([0, 0, 1.0])
    assert c.get(a, 0) is None
    c.put("a", a, 0)
    assert c.get(a, 5) == "a" and c.get(a, 50) is None and c.evictions == 1
    for k, v in (("a", a), ("b", b)):
        c.put(k, v, 60)
    assert c.get(a, 61) == "a"
    c.put("d", d, 62)
    assert c.get(b, 63) is None and c.get(a, 63) == "a"
