"""Evidence, cards, rollouts, snapshots and settled budgets on literal cases and plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F
from support import DATA

import __spark_entry__
from harrier.operators import research, versions
from harrier.sources import corpus, snapshot
from harrier.streaming import ledger


@pytest.mark.parametrize(("text", "want"), [
    ('{"steps": 3, "status": "ok"}', {"steps": "3", "status": '"ok"'}),
    ('{"a": {"steps": 1}, "steps" :\n2}', {"steps": "2"}),
    ('{"steps": 1, "steps": 2}', {"steps": "2"}),
    ('{"steps": 2, "x": "}{", "steps": 2}', {"steps": "2"}),
    ('{"status": "\\u00e9\\"q"}', {"status": '"é\\"q"'}),
    ('{"steps": null, "turns": [1], "status": {}, "passed": true, "falls": -1.5e3}', {"passed": "true", "falls": "-1500.0"}),
    ('{"steps": NaN, "turns": Infinity}', {}),
    ('{"status": "' + "x" * 200 + '"}', {}),
    ('[{"steps": 1}]', {}), ('{"steps": 1', {}), ("", {}), ("{}", {}), ("[" * 200_000, {}), ('{"a":' * 100_000, {}),
    ('﻿{"steps": 1}', {"steps": "1"}),
])
def test_scalars(text, want):
    found = snapshot.scalars(text)
    assert {f: v for f, v, _, _ in found} == want
    for _, answer, a, b in found:
        assert json.loads(text.encode()[a:b]) == json.loads(answer)


def test_first_standing_of_a_repeated_value():
    assert snapshot.scalars('{"steps": 2, "steps": 2}')[0][2:] == (10, 11)


FILES = [("results/a/1.json", '{"steps": 1, "status": "é"}'), ("results/a/2.json", '{"steps": 2}'), ("results/a/3.json", '{"steps": 2}'), ("results/b/1.json", '{"turns": 9}'), ("results/b/x.exe", "x"), ("results/b/e.md", ""), ("results/c/k.txt", "password: abcdefghijklm"), ("results/c/n.md", None), ("results/c/t.md", "text")]


def _files(spark, rows=FILES):
    return spark.createDataFrame([(p, None if c is None else bytearray(c.encode())) for p, c in rows], "path string, content binary")


def test_gates(spark):
    rows = {r.path: r.reason for r in snapshot.gated(_files(spark).unionByName(spark.createDataFrame([("results/c/u.md", bytearray(b"\xff\xfe"))], "path string, content binary"))).collect()}
    assert rows == {"results/a/1.json": None, "results/a/2.json": None, "results/a/3.json": "duplicate_content", "results/b/1.json": None, "results/b/x.exe": "type_or_size", "results/b/e.md": "type_or_size", "results/c/k.txt": "possible_secret", "results/c/n.md": "type_or_size", "results/c/t.md": None, "results/c/u.md": "not_utf8"}


def test_turns(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7), ("c", 1), ("c", 2)], "g string, i int")
    assert {tuple(r) for r in snapshot.in_turns(rows, "g", "i", 4).collect()} == {("a", 0), ("b", 7), ("c", 1), ("a", 1)}


def test_snapshot_holds_until_it_is_touched(spark):
    taken, asked = (df.persist() for df in snapshot.freeze(_files(spark)))
    kept = [(r.path, r.content.decode()) for r in taken.collect()]
    assert sorted(p for p, _ in kept) == ["results/a/1.json", "results/a/2.json", "results/b/1.json", "results/c/t.md"]
    assert {(r.path, r.field) for r in asked.collect()} == {("results/a/1.json", "steps"), ("results/a/1.json", "status"), ("results/a/2.json", "steps"), ("results/b/1.json", "turns")}
    assert snapshot.findings(taken, asked, _files(spark, kept)).collect() == []
    n_dev = asked.filter("split = 'dev'").count()
    assert {(r.part, r.want, r.have) for r in snapshot.shortage(taken, asked, 4, 5, 4 - n_dev).collect()} == {("dev", 5, n_dev)}
    assert {r.part for r in snapshot.shortage(taken, asked, 9, 9, 9).collect()} == {"files", "dev", "test"}
    touched = [(p, c.replace('"turns": 9', '"turns": 8')) for p, c in kept if p != "results/c/t.md"] + [("new.md", "n")]
    found = {tuple(r) for r in snapshot.findings(taken, asked, _files(spark, touched)).collect()}
    turns = asked.filter("field = 'turns'").first().id
    assert found == {("changed file", "results/b/1.json"), ("missing file", "results/c/t.md"), ("extra file", "new.md"), ("answer not in its bytes", turns)}
    wrong = asked.withColumn("answer", F.when(F.col("id") == turns, '"9').otherwise(F.col("answer")))
    assert {tuple(r) for r in snapshot.findings(taken, wrong, _files(spark, kept)).collect()} == {("answer not in its bytes", turns)}
    leaked = asked.unionByName(asked.filter(F.col("id") == turns).withColumn("split", F.when(F.col("split") == "dev", "test").otherwise("dev")))
    assert {tuple(r) for r in snapshot.findings(taken, leaked, _files(spark, kept)).collect()} == {("id used twice", turns), ("family in both splits", "results/b")}
    taken.unpersist()
    asked.unpersist()


def _plain_ledger(rows, limit):
    out, totals, held = {}, {}, {}
    for day, seq, request, kind, usd in sorted(rows, key=lambda r: (r[0], r[1])):
        total = totals.get(day, 0)
        if kind == "reserve":
            micros = max(1, int(usd * 1_000_000) + 1)
            fits = total + micros <= limit
            if fits:
                totals[day], held[day, request] = total + micros, micros
        else:
            fits, micros = None, held.pop((day, request), None)
            if micros is not None and usd is not None:
                totals[day] = total - micros + int(usd * 1_000_000)
        out[day, seq] = (fits, totals.get(day, 0))
    return out


def test_settled_budget(spark):
    rng = random.Random(5)
    rows = []
    for day in range(4):
        for i in range(60):
            rows.append((day, 2 * i, i, "reserve", rng.choice([0.0, 0.01, 0.05, 0.2])))
            if rng.random() < 0.8:
                rows.append((day, 2 * i + 2 * rng.randrange(1, 6) + 1, i, "settle", rng.choice([None, 0.0, 0.01, 0.3])))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "day int, seq int, request int, kind string, usd double").repartition(7)
    got = {(r.day, r.seq): (r.fits, r.spent) for r in ledger.settled(df, 0.5).collect()}
    assert got == _plain_ledger(rows, 500_000)
    assert {f for f, _ in got.values()} == {True, False, None}
    assert ledger.settled(df.limit(0), 0.5).count() == 0


def test_settled_budget_over_the_events(spark):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").collect()
    rows = [(r.ts.date(), 2 * r.event_id, r.event_id, "reserve", (r.value or 0.0) / 1000) for r in e] + [(r.ts.date(), 2 * r.event_id + 5, r.event_id, "settle", (r.value or 0.0) / 2000 if r.event_type != "error" else None) for r in e]
    got = {(r.day, r.seq): (r.fits, r.spent) for r in __spark_entry__.queries()["settled_budget"](spark, f"{DATA}/sf0.001").collect()}
    assert got == _plain_ledger(rows, 1_000_000)


def test_pending_steps(spark):
    files = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "version int, name string, checksum string")
    none = spark.createDataFrame([], "version int, checksum string")
    assert {(r.version, r.status) for r in corpus.pending_steps(files, none).collect()} == {(1, "pending"), (2, "pending"), (3, "pending")}
    some = spark.createDataFrame([(1, "other"), (3, "z"), (9, "q")], "version int, checksum string")
    assert {(r.version, r.status) for r in corpus.pending_steps(files, some).collect()} == {(1, "edited"), (2, "gap"), (3, "applied"), (9, "unknown")}


CHUNKS = [(1, "configs/run_007.yaml", "encoder: clip", 5.0), (2, "src/fuse.py", "def fusion(): pass", 5.0), (3, "src/enc.py", None, 5.0), (4, "src/encoder.py", "x", 5.0), (5, "paper/draft_v1.md", "old encoder", 1.0), (6, "paper/draft_v2.md", "new encoder", 9.0), (7, "logs/run_7.out", "done", 5.0), (8, "notes.txt", "about the rate", 5.0)]


def test_research_evidence(spark):
    chunks = spark.createDataFrame(CHUNKS, "item int, path string, text string, mtime double")
    queries = spark.createDataFrame([(1, "the rate of Run 007"), (2, None), (3, "rate"), (4, "compare the drafts")], "query_id int, query string")
    base = spark.createDataFrame([(1, 8, 1), (1, 5, 2), (1, 6, 3), (2, 8, 1), (3, 8, 1), (3, 2, 2), (4, 5, 1), (4, 6, 2)], "query_id int, item int, rank int")
    rows = research.research_evidence(queries, base, chunks, versions.clusters(chunks)).collect()
    got = {q: [r.item for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2, 3, 4)}
    # run 7's settings first, the current draft, code that holds the term, the log, the rest
    assert got == {1: [1, 6, 4, 7, 8], 2: [8], 3: [2, 8], 4: [5, 6, 4]}
    assert research.research_evidence(queries, base.limit(0), chunks, versions.clusters(chunks)).filter("query_id > 1").count() == 0


def test_spec_cards(spark):
    queries = spark.createDataFrame([(1, " plot fusion "), (2, None), (3, "learning-rate test")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "b", 0, 2, "y", 2), (1, "a", 0, 1, "x", 1), (1, "c", 0, 1, "z", 5), (2, "a", 0, 1, "x", 1)], "query_id int, path string, start_byte int, end_byte int, chunk_id string, rank int")
    rows = {r.query_id: r for r in research.spec_cards(queries, hits).collect()}
    assert [c.path for c in rows[1].citations] == ["a", "b"] and rows[1].ready and rows[1].goal == "plot fusion" and rows[1].template == "jupyter-analysis" and len(rows[1].tests) == 2
    assert (rows[2].goal, rows[2].template, rows[2].ready) == ("", "python-lib", False)
    assert (rows[3].template, rows[3].citations, rows[3].ready, rows[3].file_path, len(rows[3].tests)) == ("pytest", [], False, "artifacts/test_artifact.py", 1)


def test_unsupported_claims(spark):
    code = spark.createDataFrame([(1, "fusion = true\nencoder: vit\nlearning_rate=3e-4 learning_rate=1"), (2, None), (3, 'ENCODER = "clip"'), (4, 'ENCODER = "clip"')], "id int, text string")
    hits = spark.createDataFrame([(1, "TRUE and VIT"), (1, None), (4, "CLIP wins")], "id int, text string")
    got = {tuple(r) for r in research.unsupported_claims(code, hits).collect()}
    assert got == {(1, "learning_rate", "3e-4", 0), (1, "learning_rate", "1", 1), (3, "encoder literal", "clip", 0)}


def test_rollouts(spark):
    hits = spark.createDataFrame([(1, 2, "b", 0, 3, "bbb"), (1, 1, "a", 5, 9, "x" * 500), (1, 3, "a", 9, 10, None)], "id int, rank int, path string, start_byte int, end_byte int, text string")
    questions = spark.createDataFrame([(1, "why"), (2, None)], "id int, question string")
    answers = spark.createDataFrame([(1, "so"), (2, "no")], "id int, answer string")
    rows = {r.id: r for r in research.rollouts(questions, hits, answers).collect()}
    assert rows[1].text == f"<search>why</search>\n<information>a [5:9] {'x' * 400}\nb [0:3] bbb\na [9:10] </information>\n<answer>so</answer>"
    assert (rows[1].paths, rows[1].cited) == (["a", "b"], True)
    assert (rows[2].text, rows[2].paths, rows[2].cited) == ("<search></search>\n<information></information>\n<answer>no</answer>", [], False)


def test_fusion_changes(spark):
    schema = "query_id int, item int, path string, rank int"
    bm25 = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2)], schema)
    dense = spark.createDataFrame([(1, 3, "c", 1), (1, 2, "b", 2), (1, 4, "d", 3)], schema)
    relevant = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b"), (1, "zz")], "query_id int, path string")
    got = {r.path: (r.change, r.dense_rank, r.bm25_rank, r.chunk_rank, r.kept, r.tied) for r in research.fusion_changes(bm25, dense, relevant, keep=2, depth=2).collect()}
    # b leads; a and c tie, and a was seen first
    assert got == {"c": ("dropped", 1, None, 3, False, True), "a": ("gained", None, 1, 2, True, True)}
