"""Singular axes of TF-IDF over blocks, against counting and numpy."""

import random
import re
from collections import Counter

import __spark_entry__
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrier.catalog import plans
from harrier.functions import text as T
from harrier.operators import singular


def _texts(n, letters="ab", seed=5, most=30):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4)))
    texts = ["".join(word() + rng.choice([" ", " ", "\n", " é", "\0", "K", ", ", "İ "]) for _ in range(rng.randrange(0, most))) for _ in range(n)]
    return texts + [None, "", " ", "é", "A", "a", "aé", "Ka", "\U0001f600B\U0001f600", "x/y_z.-9 X/Y_Z.-9", texts[0], texts[0]]


def _words(text):
    return [w.lower() for w in re.findall(T.TOKEN, text or "")]


def _grams(text):
    words = _words(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _ordered(texts, features):
    total = Counter(g for t in texts for g in _grams(t))
    return sorted(total, key=lambda g: (-total[g], " " in g, g))[:features]


def _svd(texts, features, dim):
    place = {g: i for i, g in enumerate(_ordered(texts, features))}
    x = np.zeros((len(texts), len(place)))
    for i, t in enumerate(texts):
        for g in _grams(t):
            if g in place:
                x[i, place[g]] += 1
    x *= np.log((len(texts) + 1) / ((x > 0).sum(axis=0) + 1))
    y = x @ np.linalg.svd(x, full_matrices=False)[2][:dim].T
    y[np.linalg.norm(y, axis=1) < 1e-9] = 0  # at right angles to the axes
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_words_of_pieces(monkeypatch, size):
    texts = [(t or "").encode() for t in _texts(80, "aBc")]
    monkeypatch.setattr(singular, "_BYTES", size)
    for texts in (texts, texts[::-1], [b"", b""], []):
        found = []
        for at, words, ends in singular._words(pa.array([b"skipped", *texts], pa.binary()).slice(1)):
            assert at == len(found)
            words.validate(full=True)
            found += [words[a:b].to_pylist() for a, b in zip([0, *ends[:-1]], ends)]
        assert found == [_words(t.decode()) for t in texts]


@pytest.mark.parametrize("features", [1, 4, 25, 5000])
def test_vocabulary_is_the_most_frequent_grams_with_ties_settled(spark, features):
    texts = _texts(60, "aBc")
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    words, grams, codes = singular.vocabulary(rows, "id", features=features)
    assert [" ".join(words[i] for i in g) for g in grams] == _ordered(texts, features)
    stored = {r.item: np.frombuffer(r.codes, np.int32) for r in codes.collect()}
    for i, t in enumerate(texts):  # known words in order, one -1 at most for those between
        line = "".join(chr(words.index(w) + 65) if w in words else " " for w in _words(t))
        assert "".join(chr(c + 65) if c >= 0 else " " for c in stored[i]).split() == line.split()
        assert stored[i][-1] == -1


def test_texts_without_words_have_no_vocabulary(spark):
    with pytest.raises(ValueError, match="no word"):
        singular.embedded(spark.createDataFrame([(1, ""), (2, None), (3, "é")], "id long, text string"), "id")


def test_embedding_is_the_svd(spark):
    texts = _texts(150, "abcd")
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string").repartition(5)
    df = singular.embedded(rows, "id", features=60, dim=8)
    assert df.dtypes == [("id", "string"), ("embedding", "array<double>")]
    found = {r.id: r.embedding for r in df.collect()}
    x, want = np.array([found[f"k{i}"] for i in range(len(texts))]), _svd(texts, 60, 8)
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-9)
    assert not x[-12].any() and np.allclose(np.linalg.norm(x[0]), 1)


def test_query_with_equal_counts_at_the_end_of_its_vocabulary(spark, tmp_path):
    """Hundreds of grams are found twice: which of them are features is settled by alphabet."""
    texts = _texts(400, "abcdefghij", most=14)
    total = Counter(g for t in texts for g in _grams(t))
    edge = total[_ordered(texts, 1024)[-1]]
    assert len(_ordered(texts, 1025)) == 1025 and sum(n == edge for n in total.values()) > 100
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.embedding for r in __spark_entry__.queries()["tfidf_svd_embed"](spark, str(tmp_path)).collect()}
    x, want = np.array([found[i] for i in range(len(texts))]), _svd(texts, 1024, 64)
    assert np.allclose(x @ x.T, want @ want.T, atol=2e-5)


def test_query_reads_texts_twice(spark, monkeypatch):
    read, plain = spark.sparkContext.accumulator(0), plans.docs

    def seen(text):
        read.add(1)
        return text

    counted = F.udf(seen, "string").asNondeterministic()
    monkeypatch.setattr(plans, "docs", lambda *a: plain(*a).withColumn("text", counted("text")))
    n = len(__spark_entry__.queries()["tfidf_svd_embed"](spark, "/root/testdata/sf0.001").collect())
    assert read.value == 2 * n > 0
