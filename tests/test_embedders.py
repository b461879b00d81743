"""Embedders over batches against the plain one."""

import random

import numpy as np

from harrier.functions import embedders as E


def test_hash_vectors_of_a_batch(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc dÉ😀İß") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    texts += [None, "", "ab", "abc", "abcd", "a\ud800bcd", "\ud83d", "\ude00xyz", "aaaaaaa", "word " * 500]
    monkeypatch.setattr(E, "_CHARS", 400)
    spots: dict = {}
    found = E._hashed(texts, 64, spots)
    assert len(found) == len(texts)
    assert all(np.array_equal(x, E.hash_vector(t, 64)) for x, t in zip(found, texts))
    # grams that cross the texts' borders aren't looked up
    assert set(spots) == {f[i : i + n] for t in texts for f in [(t or "").lower()] for n in (3, 4) for i in range(len(f) - n + 1)}
