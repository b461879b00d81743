"""Block-max search against the search that reads everything."""

import random
import re

import pytest

from harrier.operators import blockmax as B
from harrier.operators import lexical as L


def rows(df):
    return sorted((r.query_id, r["rank"], r["item"], round(r.score, 7)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Forty groups of ten neighbours, each with words of its own; frequent words everywhere, ties, empty texts."""
    rng = random.Random(6)
    made = []
    for i in range(400):
        words = [f"own{i // 10}"] * rng.randrange(1, 4) + [rng.choice(["the", "of", "and", "rare" + str(rng.randrange(300))]) for _ in range(rng.randrange(4, 30))]
        made.append((i * 3, " ".join(words)))
    made += [(5000, "the of"), (5001, "the of"), (5002, None), (5003, "")]
    return spark.createDataFrame(made, "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    texts = [f"the own{i} and rare{i}" for i in range(0, 40, 3)] + ["the", "own1 own1 own2", "nothing known", "the of"]
    return L.query_terms(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "query_id long, text string"))


@pytest.mark.parametrize("span", [10, 64, 10_000])
def test_blocks_give_the_same_rows(spark, corpus, asked, tmp_path, span):
    B.write_blocks(corpus, f"{tmp_path}/i", span=span, buckets=4)
    index = B.read_blocks(spark, f"{tmp_path}/i")
    for k in (1, 3, 500):
        want = rows(L.bm25_top_k(corpus, asked, k))
        assert rows(B.block_top_k(index, asked, k)) == want == rows(B.block_top_k(index, asked, k, one_pass=0))


def test_few_blocks_are_read(spark, corpus, asked, tmp_path):
    """Queries with words of one neighbourhood read a small part of the blocks of their frequent words."""
    B.write_blocks(corpus, f"{tmp_path}/i", span=10, buckets=4)
    index, seen = B.read_blocks(spark, f"{tmp_path}/i"), B.Reads()
    own = asked.filter("query_id < 114")
    found = B.block_top_k(index, own, 5, one_pass=0, reads=seen)
    assert rows(found) == rows(L.bm25_top_k(corpus, own, 5))
    assert seen.passes == ["pruned"] and seen.read < 0.3 * seen.asked and seen.blocks_read < seen.asked
    whole = B.Reads()
    B.block_top_k(index, own, 5, reads=whole)
    assert whole.passes == ["whole"] and whole.read == whole.asked == seen.asked and whole.blocks == whole.blocks_read == seen.blocks


def test_batches_and_other_weights(spark, corpus, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BATCH", 3)
    monkeypatch.setattr(B, "_BROADCAST_BLOCKS", 2)
    monkeypatch.setattr(B, "BROADCAST_TERMS", 7)
    B.write_blocks(corpus, f"{tmp_path}/i", span=20, buckets=3, k1=0.9, b=0.4)
    index = B.read_blocks(spark, f"{tmp_path}/i")
    want = rows(L.bm25_top_k(corpus, asked, 4, 0.9, 0.4))
    assert rows(B.block_top_k(index, asked, 4)) == want == rows(B.block_top_k(index, asked, 4, one_pass=0))


def test_ids_that_are_not_spread_evenly(spark, asked, tmp_path):
    docs = spark.createDataFrame([(i if i < 90 else 10**12 + i * 10**9, f"the own{i % 5}") for i in range(100)], "doc_id long, text string")
    B.write_blocks(docs, f"{tmp_path}/i", span=10, buckets=2)
    index = B.read_blocks(spark, f"{tmp_path}/i")
    assert index.blocks.groupBy("span", "term").count().count() > 10
    assert rows(B.block_top_k(index, asked, 3, one_pass=0)) == rows(L.bm25_top_k(docs, asked, 3))


def test_no_documents_and_no_queries(spark, corpus, asked, tmp_path):
    B.write_blocks(corpus.limit(0), f"{tmp_path}/none", buckets=2)
    B.write_blocks(corpus, f"{tmp_path}/i", buckets=2)
    index = B.read_blocks(spark, f"{tmp_path}/i")
    for one_pass in (0, 10**9):
        assert B.block_top_k(index, asked.limit(0), 3, one_pass=one_pass).count() == 0
    assert B.block_top_k(B.read_blocks(spark, f"{tmp_path}/none"), asked, 3).count() == 0


def test_no_posting_is_shuffled(spark, corpus, asked, tmp_path, monkeypatch):
    """Texts are shuffled once, to their spans; a row for each posting or block went through three shuffles."""
    def shuffles():
        """Of the plans that wrote blocks."""
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        plans = [runs.apply(i).physicalPlanDescription() for i in range(seen, runs.size())]
        return [p.split("== Initial Plan ==")[0].count("ENSURE_REQUIREMENTS") for p in plans if re.search(r"Arguments: file:\S*/blocks, ", p)]

    seen = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    monkeypatch.setattr(B, "_TOKENS", 40)
    monkeypatch.setattr(B, "_BLOCKS_OUT", 7)
    twice = corpus.unionByName(corpus.filter("doc_id = 9"))
    for docs, n in ((corpus, 1), (twice, 2)):
        B.write_blocks(docs, f"{tmp_path}/{n}", span=50, buckets=3)
        index = B.read_blocks(spark, f"{tmp_path}/{n}")
        assert rows(B.block_top_k(index, asked, 4, one_pass=0)) == rows(B.block_top_k(index, asked, 4))
        if n == 1:
            assert rows(B.block_top_k(index, asked, 4)) == rows(L.bm25_top_k(docs, asked, 4))
            assert index.blocks.groupBy("term", "span").count().filter("count > 1").count() > 0
        else:  # a row that is there twice has its words twice
            held = index.blocks.selectExpr("term", "inline(arrays_zip(items, tfs))").filter("items = 9")
            assert {r.tfs % 2 for r in held.collect()} == {0}
    assert shuffles() == [0, 0]
