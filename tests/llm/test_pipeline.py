"""The pipeline against plain versions of its stages."""

import os
from collections import Counter

from support import rows_of, rows_of_sql
from test_operators import LIBRARY, components_brute, fold, hits_brute, kept_brute, measures_brute, prints_brute, sha

import corpus_pipeline
from harrier.llm import common, queries

SF = "/root/testdata/sf0.001"


def dropped_lines(rows):
    holders = {}
    for d, t in rows:
        for line in t.split("\n"):
            if len(k := fold(line.strip(" \t\n\x0b\x0c\r"))) >= 20:
                holders.setdefault(k, set()).add(d)
    gone = lambda d, x: len(k := fold(x.strip(" \t\n\x0b\x0c\r"))) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != d
    return [(d, "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in rows]


def brute(rows, items):
    """What is left of ``rows (doc_id, text, source)``, as ``(doc_id, text)``."""
    good = kept_brute([(d, source, measures_brute(t or "")) for d, t, source in rows])
    rows = [(d, t or "") for d, t, _ in rows if d in good]
    rows = dropped_lines(rows)
    roots, best = components_brute([prints_brute(t) for _, t in rows]), {}
    for (d, t), r in zip(rows, roots):
        best[r] = min(best.get(r, (d, t)), (d, t))
    rows = sorted(best.values())
    clean = {k[0] for k in hits_brute(rows, items) if not k[5]}
    return [(d, t) for d, t in rows if d in clean]


def bad_host(docs):
    """``docs`` with a host whose documents mostly end in symbols, and some that don't."""
    words = [" ".join(f"{w}{i}{k}" for k in range(70)) for i, w in enumerate(["oak", "elm", "ash", "fir", "yew"] * 8)]
    rows = [(900_000 + i, w + (" ### $$$ %%%" * 20 if i % 10 else ""), "bad.example", "en") for i, w in enumerate(words)]
    return docs.unionByName(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string, lang string"), allowMissingColumns=True)


def scratch_tables(spark):
    folder = f"{common.shared_dir(spark)}/harrier"
    return os.listdir(folder) if os.path.isdir(folder) else []


def test_pipeline(spark, tmp_path):
    """On the smallest tables, as they are and with a planted bad host, whose clean documents go too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad_host(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for sf_dir in (SF, str(tmp_path)):
        rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
        want = Counter((d, len(ids := LIBRARY.encode_ordinary(t)), sha(" ".join(map(str, ids))), sha(t)) for d, t in brute(rows, items))
        before = set(scratch_tables(spark))
        got = corpus_pipeline.run(spark, sf_dir)
        assert len(set(scratch_tables(spark)) - before) == 1  # what the last stage reads
        assert Counter(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
        assert not [k for k in want if k[0] >= 900_000]


def test_stages_keep_columns_of_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert all(r[c] == "mine" for r in out.collect() for c in odd.columns[4:]), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, none, SF).count() == 0 and stage(spark, odd, SF).count() == odd.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_equals_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(duck, sql), name
