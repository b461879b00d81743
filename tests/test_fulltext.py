"""Cover density against all stretches of a text."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrier.operators import fulltext as X


def part(alternative, words, negated=False):
    return {"alternative": alternative, "negated": negated, "words": words}


def holds(words, parts, negations=False):
    """Does a stretch of words have all wanted parts of some alternative (and none it bars)?"""
    has = lambda p: any(words[i : i + len(p["words"])] == p["words"] for i in range(len(words)))
    for a in {p["alternative"] for p in parts}:
        own = [p for p in parts if p["alternative"] == a]
        wanted = [p for p in own if not p["negated"]]
        if wanted and all(map(has, wanted)) and not (negations and any(has(p) for p in own if p["negated"])):
            return True
    return False


def density_plain(words, parts):
    if not holds(words, parts, True):
        return None
    n = len(words)
    whole = {(a, b) for a in range(n) for b in range(a, n) if holds(words[a : b + 1], parts)}
    least = [(a, b) for a, b in whole if (a + 1, b) not in whole and (a, b - 1) not in whole]
    asked = {w for p in parts for w in p["words"]}
    return sum(0.1 / (1 + sum(w not in asked for w in words[a : b + 1])) for a, b in least)


def places(words, parts):
    asked = {w for p in parts for w in p["words"]}
    out = {}
    for i, w in enumerate(words):
        if w in asked:
            out.setdefault(w, []).append(i)
    return out


some_parts = st.lists(st.builds(part, st.integers(0, 2), st.lists(st.sampled_from("abcd"), min_size=1, max_size=3), st.booleans()), min_size=1, max_size=5)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("abcdxyz"), max_size=16), some_parts)
def test_density_equals_all_stretches(words, parts):
    want = density_plain(words, parts)
    got = X.density(parts, places(words, parts))
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("text", "mode", "want"), [
    ('fast "red fox" or dog -cat', "web", [(0, False, ["fast"]), (0, False, ["red", "fox"]), (1, False, ["dog"]), (1, True, ["cat"])]),
    ('-"a b" c', "web", [(0, False, ["c"]), (0, True, ["a", "b"])]),
    ('or x OR or y or', "web", [(1, False, ["x"]), (3, False, ["y"])]),
    ('"open to the end', "web", [(0, False, ["open", "to", "the", "end"])]),
    ('"" ?! ""x', "web", [(0, False, ["x"])]),
    ("b a b", "all", [(0, False, ["a"]), (0, False, ["b"])]),
    ("b a", "any", [(0, False, ["b"]), (1, False, ["a"])]),
    ("b a b", "phrase", [(0, False, ["b", "a", "b"])]),
])
def test_queries_are_read(spark, text, mode, want):
    (row,) = X.parsed(spark.createDataFrame([(1, text)], "query_id int, text string"), mode).collect()
    assert [(p.alternative, p.negated, p.words) for p in row.parts] == want


def test_search(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g the of".split()) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = ["a b", '"a b" c', "a or b -c", 'the "of the" or "g g"', "zz or a", "zz a", "-a", "", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    for mode in ("web", "all", "any", "phrase"):
        parts = X.parsed(queries, mode)
        got = {(r.query_id, r["item"]): r.score for r in X.full_text(X.positions(docs), parts).collect()}
        want = {}
        for r in parts.collect():
            own = [part(p.alternative, p.words, p.negated) for p in r.parts]
            for i, t in enumerate(texts):
                if (score := density_plain((t or "").split(), own)) is not None:
                    want[r.query_id, i] = round(score, 8)
        assert got == pytest.approx(want) and len(want) > 20
    with pytest.raises(ValueError):
        X.parsed(queries, "none")
    assert X.full_text(X.positions(docs.limit(0)), X.parsed(queries)).count() == 0


def test_dropped_words_keep_their_places(spark):
    docs = spark.createDataFrame([(1, "house of cards"), (2, "house cards")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "house of cards")], "query_id int, text string")
    found = X.full_text(X.positions(docs, dropped=("of",)), X.parsed(queries, "all", dropped=("of",)))
    assert {r["item"]: r.score for r in found.collect()} == {1: 0.05, 2: 0.1}
