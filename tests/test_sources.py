"""Sources, sinks, the engine and streams over small files."""

import json

import pytest

from harrier.plans.engine import Config, Engine
from harrier.sources import corpus, judgements
from harrier.streaming import events


def test_scan_of_a_folder(spark, tmp_path):
    for name, data in {"a.txt": b"one", "sub/b.txt": b"one", "c.exe": b"x", "d.md": b" \n", "e.md": b"\xff\xfe", "f.py": b"x" * 50, ".git/g.md": b"hidden", "sub/__pycache__/h.py": b"hidden"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    scan = corpus.gate(corpus.list_files(spark, str(tmp_path)), max_bytes=40)
    got = {r.path: r.reason for r in scan.collect()}
    assert got == {"a.txt": None, "sub/b.txt": "duplicate_content", "c.exe": "unsupported_type", "d.md": "empty", "e.md": "undecodable", "f.py": "too_large"}
    counts = {r.reason: r.n for r in corpus.reject_counts(scan).collect()}
    assert counts == {"outside_root": 0, "unsupported_type": 1, "too_large": 1, "undecodable": 1, "empty": 1, "duplicate_content": 1}


def test_collection(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "a"}\n{"_id": "q2", "text": "b"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq2\td2\t0\n")
    docs, queries, qrels = judgements.read_collection(spark, str(tmp_path))
    assert {tuple(r) for r in docs.collect()} == {("d1", "T x"), ("d2", "y")}
    assert [tuple(r) for r in queries.collect()] == [("q1", "a")] and [tuple(r) for r in qrels.collect()] == [("q1", "d1", 2)]


def test_gold(spark, tmp_path):
    row = {"id": "1", "question": "q", "category": "semantic", "answer": "a", "relevant_paths": ["p"], "relevant_chunk_ids": [], "notes": ""}
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps(row))
    bad.write_text(json.dumps(row | {"category": "other"}))
    assert judgements.read_gold(spark, str(good)).first().category == "semantic"
    with pytest.raises(Exception, match="unknown category"):
        judgements.read_gold(spark, str(bad)).collect()


def test_trec_files(spark, tmp_path):
    hits = spark.createDataFrame([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25)], "query_id string, item string, rank int, score double")
    judgements.write_trec(hits, "run", str(tmp_path / "run"))
    assert sorted(map(tuple, judgements.read_trec(spark, str(tmp_path / "run")).collect())) == [("q1", "d1", 1, 0.5, "run"), ("q1", "d2", 2, 0.25, "run")]
    with pytest.raises(Exception, match="white space"):
        judgements.trec_lines(hits.replace("d1", "d 1"), "run").collect()


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name,n\n"x\ny",1\n')
    rows = judgements.read_sheet(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["name", "n"] and tuple(rows.first()) == ("x\ny", "1")


def test_engine(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(1, "configs/run_1.yaml", "learning rate 0.1", 9.0), (2, "configs/archive/run_1_v1.yaml", "learning rate 0.2", 1.0), (3, "notes.md", "star fusion encoder notes", 5.0), (4, "x.md", "", 5.0)],
        "chunk_id long, path string, text string, mtime double",
    )
    queries = spark.createDataFrame([(1, "learning rate"), (2, "open configs/run_1.yaml"), (3, "what changed: learning rate old and older"), (4, "")], "query_id long, text string")
    engine = Engine(spark, chunks)
    engine.save(str(tmp_path / "index"))
    for own in (engine, Engine.load(spark, str(tmp_path / "index"))):
        got = {}
        for r in sorted(own.retrieve(queries, Config(k=3)).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r)
        assert got[1][0].path == "configs/run_1.yaml" and "configs/archive/run_1_v1.yaml" not in [r.path for r in got[1]]
        assert got[2][0].path == "configs/run_1.yaml" and got[2][0].route == "lexical_path" and got[2][0].dense is None
        assert "configs/archive/run_1_v1.yaml" in [r.path for r in got[3]]
        assert all([r["rank"] for r in rows] == list(range(1, len(rows) + 1)) for rows in got.values())


def test_upserts_by_batch(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    kind = "path string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], kind).coalesce(1).write.mode("append").parquet(str(source))
    read = lambda: spark.readStream.schema(kind).parquet(str(source))
    events.upsert_files(read(), table, str(tmp_path / "state"))
    spark.createDataFrame([("b", 2), ("c", 2)], kind).coalesce(1).write.mode("append").parquet(str(source))
    events.upsert_files(read(), table, str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(f"{table}/version=1").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_rate_limit_and_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:01', 7, 1.0), (2, TIMESTAMP'2024-01-01 00:00:59', 7, 2.0), (3, TIMESTAMP'2024-01-01 00:01:00', 7, 3.0), (4, TIMESTAMP'2024-01-01 02:00:00', 7, NULL) AS v(event_id, ts, user_id, value)")
    assert [r.allowed for r in events.rate_limited(rows, 1).orderBy("event_id").collect()] == [True, False, True, True]
    assert [r.n for r in events.sessions(rows).orderBy("start").collect()] == [3, 1]
    assert [r.within for r in events.daily_budget(rows, 3.0).orderBy("event_id").collect()] == [True, True, False, False]
