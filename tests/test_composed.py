"""Answers' values, caches, hooks, budgets and fields, on literal cases."""

import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from support import DATA

import __spark_entry__
from harrier.operators import lexical, probes, ranking, rerank, scoring, tabular
from harrier.plans.budget import Deadline, OutOfTime, retried, waits
from harrier.sources import ingest, judgements
from harrier.streaming import cache


@pytest.mark.parametrize(("gold", "want"), [
    ("0.055", ["0.055"]), ("dinov2; clip", ["dinov2", "clip"]), ("3 vs 4", ["3", "4"]), ("file a/b.py, c", ["a/b.py", "c"]),
    ("a whole sentence", None), ("Yes", None), (" ", None), (None, None), (";;", None),
])
def test_gold_parts(spark, gold, want):
    assert spark.createDataFrame([(gold,)], "g string").select(scoring.gold_parts(F.col("g"))).first()[0] == want


@pytest.mark.parametrize(("answer", "value", "cited", "want"), [
    ("It is 0.0550 [S1].", "0.055", [], True),
    ("version v2 of 2024-05-01", "2", [], False),
    ("a 3x3 grid", "3", [], False),
    ("1.2.3", "1.2", [], False),
    ("run_047 did it", "47", [], True),
    ("lr 3e-4", "0.0003", [], True),
    ("see configs/run_1.yaml.", "configs/run_1.yaml", [], True),
    ("see xconfigs/run_1.yaml", "configs/run_1.yaml", [], False),
    ("nothing", "configs/run_1.yaml", ["configs/run_1.yaml"], True),
    ("nothing", "configs/", ["configs/a"], True),
    ("in configs/a", "configs/", [], True),
    ("ResNet-50 wins", "resnet50", [], True),
    ("resnet501", "resnet50", [], False),
    ("a+b (c)", "b", [], True),
    ("anything", "", [], False),
    (None, "x", [], False),
    ("[S1]", "1", [], False),
])
def test_states_value(spark, answer, value, cited, want):
    row = spark.createDataFrame([(answer, value, cited)], "a string, v string, c array<string>")
    assert row.select(scoring.states_value(F.col("a"), F.col("v"), F.col("c"))).first()[0] is want


def test_ties_go_to_what_was_seen_first(spark):
    lists = spark.createDataFrame([(1, 0, 1, "z"), (1, 0, 2, "b"), (1, 1, 1, "a"), (1, 1, 2, "b")], "query_id int, list_no int, rank int, item string")
    assert [r.item for r in ranking.rrf_first_seen(lists, 9).orderBy("rank").collect()] == ["b", "z", "a"]
    assert [r.item for r in ranking.append_unseen(lists, 9).orderBy("rank").collect()] == ["z", "b", "a"]
    assert ranking.append_unseen(lists.limit(0), 9).count() == 0


def test_reranking_by_a_function(spark):
    pairs = spark.createDataFrame([(1, "a", "q", "p", "long text", 0.1), (1, "b", "q", "p", None, 0.1)], "query_id int, item string, query string, path string, text string, rrf double")
    found = {r.item: (r.score, r.backend) for r in rerank.model_scores(pairs, lambda rows: [float(len(t)) for _, t in rows], batch=1).collect()}
    assert found["b"] == (0.5, "model") and found["a"][0] > 0.99
    assert {r.backend for r in rerank.model_scores(pairs, None, allow_fallback=True).collect()} == {"overlap"}
    with pytest.raises(ValueError):
        rerank.model_scores(pairs, None)


def test_documents_with_all_terms(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (2, 2, "c")], "query_id int, item int, term string")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "query_id int, term string")
    assert {tuple(r) for r in lexical.all_terms(rows, terms).collect()} == {(1, 1), (2, 2)}


def test_cached_results_follow_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    made = []

    def make(d):
        made.append(1)
        return d.select("doc_id")

    for d in (docs, docs.orderBy(F.desc("doc_id")), docs):
        assert ingest.cached(spark, d, make, str(tmp_path), "v1").count() == 2
    assert len(made) == 1
    ingest.cached(spark, docs.filter("doc_id = 1"), make, str(tmp_path), "v1")
    ingest.cached(spark, docs, make, str(tmp_path), "v2")
    assert len(made) == 3


def test_lines_and_stored_texts(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "x"), ("q2", "y")], "question string, text string")
    ingest.write_lines(rows, f"{tmp_path}/lines", "question")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert sorted(x["question"] for x in lines) == ["q1", "q2"]
    assert ingest.stored_texts(spark.createDataFrame([("q2",)], "question string"), rows).first().text == "y"
    with pytest.raises(PySparkException):
        ingest.stored_texts(spark.createDataFrame([("q3",)], "question string"), rows).collect()


def test_ingest_is_checked_after_the_write(spark):
    files = spark.createDataFrame([("a.md", bytearray(b"# A\nx\n# B\ny\n"), 1.0, 14), ("b.exe", bytearray(b"x"), 1.0, 1), ("c.txt", bytearray(b"# A\nx\n# B\ny\n"), 1.0, 14)], "path string, content binary, mtime double, size long")
    manifest = spark.createDataFrame([("a.md", 9.0)], "path string, mtime double")
    chunks, report = ingest.load_chunks(files, manifest)
    assert {(r.path, r.reason, r.n_chunks) for r in report.collect()} == {("a.md", None, 2), ("b.exe", "unsupported_type", 0), ("c.txt", "duplicate_content", 0)}
    assert [(r.start_byte, r.end_byte, r.mtime) for r in chunks.orderBy("start_byte").collect()] == [(0, 6, 9.0), (6, 12, 9.0)]
    assert ingest.checked_ingest(report, chunks).count() == 0
    assert ingest.checked_ingest(report, chunks.limit(1)).first().found == 1


def test_deadlines_and_retries(spark):
    budget = Deadline(spark, 60)
    assert budget.run("count", lambda: spark.range(10).count()) == 10
    slow = Deadline(spark, 1.5)
    with pytest.raises(OutOfTime):
        slow.run("slow", lambda: spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id")).collect())
    with pytest.raises(OutOfTime):
        slow.run("next", lambda: 1)
    assert [w for w, _ in zip(waits(1, 5), range(5))] == [1, 2, 4, 5, 5]
    tries, slept = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "up"

    assert retried(flaky, 5, sleep=slept.append) == "up" and slept == [1, 2]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=slept.append)


def test_fields_and_operations(spark):
    columns = [("run_id", "numeric"), ("encoder", "categorical"), ("fusion", "boolean"), ("val_rmse", "numeric"), ("num_pairs", "numeric")]
    sheet = lambda cs: spark.createDataFrame([(i, *c) for i, c in enumerate(cs)], "at int, column string, kind string")
    asked = {"mean val rmse by encoder": ("encoder", "val_rmse"), "average pairs with fusion": ("fusion", "num_pairs"), "what is it": ("encoder", "val_rmse"), "val rmse": ("encoder", "val_rmse"), "by encoder and fusion": ("fusion", "val_rmse"), "": ("encoder", "val_rmse")}
    questions = spark.createDataFrame([(q,) for q in asked], "text string")
    assert {r.text: (r.group_field, r.value_field) for r in tabular.fields_asked(questions, sheet(columns)).collect()} == asked
    (only,) = tabular.fields_asked(spark.createDataFrame([(None,)], "text string"), sheet([("a", "numeric"), ("id", "numeric")])).collect()
    assert (only.group_field, only.value_field) == ("a", "a")
    rows = spark.createDataFrame([("x", "1", "7")], "a string, id string, m string")
    assert tabular.propose(rows, "anything", value="id").value == "id"
    for wrong in (dict(group="nope"), dict(value="nope"), dict(chart="pie")):
        with pytest.raises(ValueError):
            tabular.propose(rows, "x", **wrong)
    for table in (rows.select("id"), rows.selectExpr("'t' AS a", "id")):
        with pytest.raises(ValueError):
            tabular.propose(table, "x")
    asked = {"how many runs": "count", "the total": "sum", "Best run?": "min", "worst": "max", "typical counting": "mean", "minimal": "mean"}
    said = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.operation for r in said.select("q", tabular.operation_asked(F.col("q")).alias("operation")).collect()} == asked


def test_recall_of_storage(spark):
    got = {r.variant: r.recall for r in __spark_entry__.queries()["storage_recall"](spark, f"{DATA}/sf0.001").collect()}
    assert got["float"] == 1.0 and got["half"] > 0.95 and got["bits and 4 x rescored"] <= got["bits and 16 x rescored"]


def test_choice_on_one_half(spark):
    rows = [("a", 1, 0, 0.5), ("a", 2, 1, 0.1), ("b", 1, 0, 0.7), ("b", 2, 1, 0.2), ("c", 1, 0, 0.7), ("c", 2, 1, 0.9)]
    scores = spark.createDataFrame(rows, "setting string, query_id int, part int, value double")
    assert tuple(rerank.choose(scores, ["setting"]).first()) == ("b", 0.7, 0.2)


def test_judging_by_a_function(spark):
    rows = spark.createDataFrame([(1, "q", "gold", "gold"), (2, "q", "gold", None)], "id int, question string, gold string, answer string")
    found = probes.judged_by(rows, lambda asked: ["correct" if g == a else "wrong" for _, g, a in asked], batch=1)
    assert {r.id: r.score for r in found.collect()} == {1: 1.0, 2: 0.0}


def test_cache_is_forgotten_and_stored():
    kept = cache.SemanticCache(size=2)
    for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0])):
        kept.put(i, np.array(v), float(i))
    again = cache.SemanticCache.of_rows(kept.rows(), size=2)
    assert [r[0] for r in again.rows()] == [1, 2] and again.get(np.array([0.0, 1.0]), 3.0) == 1
    assert again.forget({1, 99}) == 1 and again.get(np.array([0.0, 1.0]), 3.0) is None and again.forget() == 1


def test_sheets_and_gold(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(f"{tmp_path}/t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a</t></r><r><t>nn</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c></row><row><c r="B3"><v>2</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in judgements.read_workbook(spark, f"{tmp_path}/t.xlsx").collect()] == [("ann", "1.5"), (None, "2")]
    gold = spark.createDataFrame([("g1", "what", "simple_factual", "3", ["a.py"], [], None)], "id string, question string, category string, answer string, relevant_paths array<string>, relevant_chunk_ids array<string>, notes string")
    judgements.write_gold(gold, f"{tmp_path}/gold")
    assert judgements.read_gold(spark, f"{tmp_path}/gold").first().question == "what"
