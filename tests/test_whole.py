"""Queries over whole tables. Those with SQL are held against it in test_catalog; here are
the others, and what shows that no row is left out."""

from collections import defaultdict

from support import DATA

import __spark_entry__
from harrier.functions.embedders import hash_vector

SF = f"{DATA}/sf0.001"


def run(spark, name, sf_dir=SF):
    return __spark_entry__.queries()[name](spark, sf_dir)


def tables(tmp_path, spark, **rows):
    """Tables of a few rows: ``name=(schema, rows)``."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_components_of_all_edges(spark, duck, tmp_path):
    def brute(edges):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return {(x, root(x)) for x in parent}

    few = [(1, 10, 100), (2, 11, 100), (3, 11, 101), (40, 12, 102), (41, 13, 103), (42, 13, 102)]
    made = tables(tmp_path, spark, lineitem=("l_orderkey long, l_suppkey long, l_partkey long", few))
    whole = duck.execute("SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem").fetchall()
    for sf_dir, rows in ((made, few), (SF, whole)):
        got = [tuple(r) for r in run(spark, "components", sf_dir).collect()]
        assert len(got) == len(set(got)) and set(got) == brute((f"s{s}", f"p{p}") for _, s, p in rows)


def test_hops_from_all_customers_over_all_orders(spark, duck):
    of = defaultdict(set)
    for customer, order in duck.execute("SELECT o_custkey, o_orderkey FROM orders").fetchall():
        of[customer].add(order)
    seeds = [c for (c,) in duck.execute("SELECT c_custkey FROM customer").fetchall()]
    # an order has one customer, so the second hop finds nothing new
    want = {(f"c{c}", f"c{c}", 0) for c in seeds} | {(f"c{c}", f"o{o}", 1) for c in seeds for o in of[c]}
    got = [tuple(r) for r in run(spark, "k_hop").collect()]
    assert len(got) == len(want) and set(got) == want


def test_fields_of_all_events(spark, duck):
    (n,) = duck.execute("SELECT count(*) FROM events WHERE len(json_keys(props)) > 0").fetchone()
    assert run(spark, "json_fields").select("event_id").distinct().count() == n


def test_dense_queries_are_all_ids_divisible_by_100(spark, duck):
    (n,) = duck.execute("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchone()
    asked = {i for (i,) in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    texts = {i for (i,) in duck.execute("SELECT doc_id FROM documents WHERE doc_id % 100 = 0").fetchall()}
    assert n > 1
    for name in ("ann_recall", "halfvec_topk", "dense_topk", "hamming_rescore", "maxsim"):
        assert {r.query_id for r in run(spark, name).select("query_id").collect()} == asked, name
    for name in ("rrf_hybrid", "weighted_rrf_grid"):
        assert {r.query_id for r in run(spark, name).select("query_id").collect()} == asked | texts, name


def test_no_document_is_left_out(spark, duck):
    n, long, worded = duck.execute("SELECT count(*), count(*) FILTER (length(text) > 40), count(*) FILTER (regexp_matches(text, '\\S')) FROM documents").fetchone()
    for name, want in (("hash_embed", n), ("heuristic_judge", n), ("rag_overlap_metrics", n), ("cited_spans", long), ("rebuilt_files", worded)):
        assert run(spark, name).count() == want > 100, name


def test_ids_are_no_bound(spark, tmp_path):
    few = [(i, f"line {i} of a text that is long enough\nand another line of it", "en", "s") for i in (3, 250, 10_000)]
    made = tables(tmp_path, spark, documents=("doc_id long, text string, lang string, source string", few))
    assert run(spark, "line_chunks", made).select("path").distinct().count() == 3
    assert {r.query_id: r.top for r in run(spark, "top_lists", made).collect()} == {3: [3], 5: [250], 4: [10_000]}


def test_texts_are_whole(spark, tmp_path):
    """What lies behind the first 500 characters counts."""
    head = "the same beginning " * 40
    few = [(1, head + "alpha beta", "en", "s"), (2, head + "gamma", "en", "s"), (3, None, "en", "s")]
    made = tables(tmp_path, spark, documents=("doc_id long, text string, lang string, source string", few))
    vectors = {r.doc_id: r.embedding for r in run(spark, "hash_embed", made).collect()}
    assert vectors[1] != vectors[2] and vectors[1] == hash_vector(few[0][1]).tolist() and not any(vectors[3])
    assert {r.doc_id: r.jaccard for r in run(spark, "jaccard_overlap", made).collect()} == {1: 0.5, 2: 0, 3: 0}
    assert {r.search_text.split("\n\n", 1)[1] for r in run(spark, "contextual_text", made).collect()} == {t or "" for _, t, *_ in few}


def test_claims_read_each_text_once(spark):
    """The texts aren't worked out anew for each side and phrase."""
    from pyspark.sql import functions as F

    from harrier.operators.versions import claim_conflicts

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = ["We say: fusion **does** help!", "Fusion does not help.", None, "nothing", "FUSION, helps", "fu_sion does-not matter", "do*es~ help"]
    rows = [(q, f"p{i}", t) for q in (1, 2) for i, t in enumerate(texts)]
    hits = spark.createDataFrame(rows, "query_id long, path string, text string").mapInArrow(counted, "query_id long, path string, text string")
    found = {(r.query_id, r.path_a, r.path_b, r.said) for r in claim_conflicts(hits).collect()}
    one = {("p0", "p1", "does help"), ("p1", "p6", "does help"), ("p1", "p4", "fusion helps"), ("p4", "p5", "fusion helps")}
    assert found == {(q, *x) for q in (1, 2) for x in one}
    assert read.value == len(rows)


def test_questions_and_files_of_documents_with_few_words(spark, tmp_path):
    """Where words are missing, the made texts have empty headings, blanks at their ends and equal parts."""
    import duckdb
    from support import rows_of, rows_of_sql

    texts = [None, "", "one", "same same same same", "a b", "a b c d e"]
    few = [(40 * i + k, t, "en", "s", len(t or "")) for i, t in enumerate(texts) for k in range(20)]
    made = tables(tmp_path, spark, documents=("doc_id long, text string, lang string, source string, n_chars long", few))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{made}/documents.parquet/*.parquet'")
    for name in ("chunk_formats", "decompose_queries", "expand_queries"):
        assert rows_of(run(spark, name, made)) == rows_of_sql(con, __spark_entry__.oracle_sql()[name]), name
