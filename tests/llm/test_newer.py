"""Whitening, periodic runs and mixing, each against a plain version."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import measures_brute

from harrier.llm import mixing, periodic, whitening

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def whitened_brute(rows, k=16):
    """``(vec_id, deviation, component, size of the whitened entry)``, n and the explained shares, of ``(vec_id, list)``."""
    good = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = Counter(len(x) for x in {x for _, x in good})
    d = max(lengths, key=lambda n: (lengths[n], n))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-values)[:k]
    out = Counter()
    for i, x in good:
        m = [n * c - s for c, s in zip(x, sums)]
        w = (np.array(m, float) / n) @ vectors[:, order] / np.sqrt(values[order])
        out.update((i, sum(c * c for c in m), c + 1, round(abs(float(v)), 6)) for c, v in enumerate(w))
    return out, n, values[order] / values.sum()


def held_against(df, rows, k=16):
    found = whitening.whitening_digest(df).collect()
    want, n, explained = whitened_brute(rows, k)
    assert Counter((r.vec_id, r.deviation, r.component, round(abs(r.whitened), 6)) for r in found) == want
    assert all(r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    held_against(df, [(r.vec_id, r.embedding) for r in df.collect()])


ODD_VECTORS = [(1, None), (2, [None, 1.0, 2.0]), (3, [float("nan"), 0.0, 1.0]), (4, [float("inf"), 0.0, 1.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0])]


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    fine = [(100 + i, [float(x) for x in rng.normal(size=3) * [1, 4, 9]]) for i in range(40)]
    rows = [*ODD_VECTORS, *fine, fine[0], (None, fine[1][1]), *((900 + i, fine[2][1]) for i in range(30))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'mine' AS x", "'own' AS whitening")
    held_against(df.fillna({"vec_id": -1}), [(-1 if i is None else i, v) for i, v in rows], 3)
    out, model, error = whitening.whiten(df, into="w")
    assert out.columns == [*df.columns, "w"] and {(r.x, r.whitening) for r in out.collect()} == {("mine", "own")} and error < 1e-9
    assert out.count() == len(rows) - len(ODD_VECTORS)


def test_whitening_without_rows_or_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], ODD_VECTORS[:5]):
        assert whitening.whitening_digest(spark.createDataFrame(rows, schema)).count() == 0
    (a, b) = whitening.whitening_digest(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert (a.n, a.deviation, a.whitened, a.explained, a.identity_error, b.component) == (1, 0, None, 0.0, None, 2)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)  # one direction only
    found = whitening.whitening_digest(line).collect()
    assert len(found) == 27 and all((r.whitened is not None) == (r.component == 1) and r.identity_error < 1e-9 for r in found)


def test_whitening_in_blocks_of_pairs_and_in_doubles(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.withColumn("x", whitening.whole_numbers(F.col("embedding")))
    fit = whitening.fit_list(rows, "x")
    n, sums, matrix = whitening.covariance(fit)
    monkeypatch.setattr(whitening, "PAIRS", 700)
    assert (whitening.covariance(fit)[2] == matrix).all()
    centre = [round(s / n) for s in sums]
    assert np.allclose(whitening.pair_sums(fit, "x", centre, "double"), whitening.pair_sums(fit, "x", centre, "bigint").astype(float), rtol=1e-9)


def test_whitening_of_huge_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=2) * [1e12, 1e9]]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whitening_digest(df).collect()
    assert len(found) == 100 and all(r.deviation is None and r.identity_error < 1e-4 for r in found)
    far = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 1.0]), (3, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert whitening.whitening_digest(far).count() == 6


# 12


def runs_brute(ids, least=6, exponent=4):
    n, out = len(ids), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i < n - p:
            if ids[i] != ids[i + p]:
                i += 1
                continue
            s = i
            while i < n - p and ids[i] == ids[i + p]:
                i += 1
            stretch = ids[s : i + p]
            if len(stretch) >= max(least, exponent * p) and not any(stretch[:-q] == stretch[q:] for q in range(1, p)):
                out.append((s, len(stretch), p))
    return sorted(out)


words = st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abc"), max_size=40)
powers = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 7)), max_size=6).map(lambda parts: [w for stretch, k in parts for w in stretch * k])


@settings(max_examples=1500, deadline=None)
@given(words | powers)
def test_runs_equal_all_stretches(found):
    assert periodic.periodic_runs(periodic.numbered(found)) == runs_brute(found)


def test_runs_in_small_blocks_and_other_bounds(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 7)
    ids = periodic.numbered("ab" * 9 + "c" * 8 + "abcabcabcabcab" + "x" + "abababab" * 3)
    for least, exponent in ((6, 4), (4, 2), (9, 3)):
        assert periodic.periodic_runs(ids, least, exponent) == runs_brute(ids.tolist(), least, exponent)


def test_colliding_hashes_do_not_change_runs(monkeypatch):
    """Hashes that call nearly all stretches equal are found out by the words; other numbers are tried."""

    class Weak(periodic.PrefixHashes):
        def __init__(self, ids, seed):
            super().__init__(ids if seed > 2 else ids // 2, seed)

    monkeypatch.setattr(periodic, "PrefixHashes", Weak)
    for text in ("abababacacacacabababab", "aaaaaaabaaaaaaab" * 5, "abcabcabcabdabcabcabcabc"):
        assert periodic.periodic_runs(periodic.numbered(text)) == runs_brute(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 100_000 + "c" + "ab" * 50_000])
def test_long_runs_take_no_square(text):
    found = periodic.periodic_runs(periodic.numbered(text))
    assert found[0][:2] == (0, len(text)) if "c" not in text else [(s, p) for s, _, p in found] == [(0, 2), (200_001, 2)]


def digest_brute(rows):
    out = Counter()
    for d, text in rows:
        ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(ws)
        if d is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        runs = periodic.periodic_runs(periodic.numbered(ws)) if n > 400 else runs_brute(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        out[d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))] += 1
    return out


def test_run_query(spark, odd, none):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (odd, small):
        got = Counter(map(tuple, periodic.run_digest(df).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
        assert got == digest_brute([(r.doc_id, r.text) for r in df.collect()])
    assert periodic.run_digest(none).count() == 0
    (r,) = periodic.find_runs(odd.filter("doc_id = 10")).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (300, [(0, 300, 1)], "word")


# 13


def targets_brute(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def mix_brute(rows):
    held = []
    for d, source, text in rows:
        m = measures_brute(text or "")
        n, chars, symbols, lines, repeated = m
        failed = (n < 50) + (100 * repeated > 50 * n) + (10 * symbols > n) + (n > 0 and (chars < 2 * n or chars > 20 * n)) + (10 * lines > n)
        u = (int(hashlib.md5(f"{'' if d is None else d}/{n}/mix".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        held.append((source, -math.log(u) * (1 + failed), d is not None, d or 0, n))
    total = Counter()
    for source, *_, n in held:
        total[source] += n
    target, before, out = targets_brute(total), Counter(), Counter()
    for source, _, has, d, n in sorted(held, key=lambda h: (h[0] is None, h[0] or "", *h[1:])):
        budget = math.floor(target[source] + 0.5)
        epochs = budget // total[source] if total[source] else 0
        part = max(0, min(n, budget - epochs * total[source] - before[source]))
        before[source] += n
        out[d if has else None, n, total[source], round(target[source], 6), epochs * n + part] += 1
    return out


def test_mixing(spark, odd, none):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (odd, small):
        found = mixing.mix_digest(df).collect()
        assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found) == mix_brute([(r.doc_id, r.source, r.text) for r in df.collect()])
        assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    assert mixing.mix_digest(none).count() == 0
    empty = mixing.mix_digest(odd.filter("text is null or text = ''")).collect()
    assert [(r["size"], r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


@settings(max_examples=10, deadline=None)
@given(sizes=st.dictionaries(st.none() | st.text("abĀ😀z", max_size=3), st.integers(0, 5000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets_brute(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_running_sums_of_one_group_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("id % 7 = 0 AS g", "cast(id * 7919 % 5000 as int) AS k", "id % 11 AS v").withColumn("part", F.lit("mine"))
    got = mixing.running_sum(df, ["g"], ["k"], "v", "upto")
    assert got.columns == [*df.columns, "upto"]
    sums, want = Counter(), {}
    for r in sorted(df.collect(), key=lambda r: r.k):
        want[r.k] = sums[r.g]
        sums[r.g] += r.v
    assert {r.k: r.upto for r in got.collect()} == want


def test_better_documents_are_drawn_first(spark):
    """Of one source at a target of its half, with as many poor documents as good ones, most taken are good."""
    good = [(i, f"s{i % 3}", " ".join(f"word{i}x{k}" for k in range(60))) for i in range(0, 600, 2)]
    poor = [(i, f"s{i % 3}", " ".join(f"word{i}x{k}" for k in range(50)) + " # $ % & | < > * # $") for i in range(1, 600, 2)]
    rows = mixing.mix_digest(spark.createDataFrame(good + poor, "doc_id long, source string, text string")).filter("target < source_size").collect()
    taken = Counter()
    for r in rows:
        taken[r.doc_id % 2] += r.taken
    assert taken[0] > 1.2 * taken[1] > 0


def test_the_mix_itself(spark, odd, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(none).count() == 0
    plan, words = Counter(), Counter()
    for r in mixing.mix_digest(odd).collect():
        plan[r.doc_id] += r.taken
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
        assert {r[c] for c in odd.columns[4:]} == {"mine"}
    assert words == +plan
