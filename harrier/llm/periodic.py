"""Periodic run detection on a harmonic grid with vectorised prefix hashes.

A *run* is a stretch of consecutive words with smallest period q, of at least
``least`` words and ``exponent`` periods, that no neighbouring word extends keeping q.
A stretch of period p and length L holds L - p places whose word returns p later, so
every run of period p is met by a grid whose points lie max(least, exponent * p) - p
apart. Over all periods that is a harmonic sum: n log n pairs (period, grid point).

Pairs whose words differ go at once. For all others together the longest common
extension, forwards and backwards, is found by binary search on prefix hashes (two
primes below 2^31, so products fit 64 bits): a bit of the length at a time, for all
pairs in one numpy step. Extensions that are long enough are deduplicated, the least
period of a stretch is its own, and its words are then compared. Words that differ, or
a period that isn't a multiple of the least one, tell of a hash collision; the text is
searched again with other numbers. So what is returned is right, whatever the hashes.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs;
texts of any length are searched whole (pairs in blocks of ``BLOCK``, so memory is that
of the words). Repeated rows are searched alike; runs are ordered by start, then period;
empty tables give no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import map_rows, text_of

LEAST = 6
EXPONENT = 4
#: Pairs of period and grid point that are looked at together.
BLOCK = 1 << 20
#: The primes of the two hashes.
PRIMES = (2_147_483_647, 2_147_483_629)


class PrefixHashes:
    """Hashes of all prefixes of a sequence of numbers, under two primes."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.sides = []
        values = int(ids.max(initial=0)) + 1
        for prime in PRIMES:
            value_of = rng.integers(1, prime, values)
            powers = self._powers(int(rng.integers(1 << 20, prime)), len(ids) + 1, prime)
            terms = value_of[ids] * powers[:-1] % prime
            self.sides.append((prime, powers, np.concatenate([[0], np.cumsum(terms) % prime])))

    @staticmethod
    def _powers(base: int, n: int, prime: int) -> np.ndarray:
        out = np.ones(n, np.int64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * (int(out[done - 1]) * base % prime) % prime
            done += step
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Are the stretches of ``length`` at ``a`` and at ``b >= a`` the same?"""
        same = np.ones(len(a), bool)
        for prime, powers, sums in self.sides:
            left = (sums[a + length] - sums[a]) % prime * powers[b - a] % prime
            same &= left == (sums[b + length] - sums[b]) % prime
        return same


def extensions(hashes: PrefixHashes, at: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs at once: how far the words from ``at`` and from ``at + period`` agree,
    and how far those before them do."""
    reach = []
    for forwards in (True, False):
        room = n - at - period if forwards else at
        found = np.zeros(len(at), np.int64)
        bit = 1 << int(room.max(initial=0)).bit_length()
        while bit:
            ask = np.flatnonzero(found + bit <= room)
            start = at[ask] + found[ask] if forwards else at[ask] - found[ask] - bit
            found[ask[hashes.equal(start, start + period[ask], bit)]] += bit
            bit >>= 1
        reach.append(found)
    return reach[0], reach[1]


def grid_pairs(n: int, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(points, periods)`` of the harmonic grid, in blocks."""
    periods = np.arange(1, n // exponent + 1, dtype=np.int64) if n >= least else np.zeros(0, np.int64)
    steps = np.maximum(least, exponent * periods) - periods
    counts = -(-(n - periods) // steps)
    upto = np.concatenate([[0], np.cumsum(counts)])
    first = 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + BLOCK, "right")) - 1)
        part = slice(first, last)
        turn = np.arange(upto[last] - upto[first]) - np.repeat(upto[first:last] - upto[first], counts[part])
        yield turn * np.repeat(steps[part], counts[part]), np.repeat(periods[part], counts[part])
        first = last


def periodic_runs(ids: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of numbers, by start, then period."""
    seed = 0
    while (found := _search(ids, least, exponent, seed)) is None:
        seed += 1
    return found


def _search(ids: np.ndarray, least: int, exponent: int, seed: int) -> list[tuple[int, int, int]] | None:
    """The runs; None where words don't bear out what the hashes say."""
    n, hashes, kept = len(ids), None, []
    for at, period in grid_pairs(n, least, exponent):
        same = ids[at] == ids[at + period]
        at, period = at[same], period[same]
        if not len(at):
            continue
        hashes = hashes or PrefixHashes(ids, seed)
        on, back = extensions(hashes, at, period, n)
        start, end = at - back, at + period + on
        long = end - start >= np.maximum(least, exponent * period)
        kept.append(np.unique(np.stack([start[long], end[long], period[long]]), axis=1))
    if not kept:
        return []
    start, end, period = np.unique(np.concatenate(kept, axis=1), axis=1)
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    own = period[first][np.cumsum(first) - 1]
    if (period % own).any():
        return None
    out = []
    for s, e, p in zip(start[first].tolist(), end[first].tolist(), period[first].tolist()):
        if not np.array_equal(ids[s : e - p], ids[s + p : e]):
            return None
        out.append((s, e - s, p))
    return sorted((s, length, p) for s, length, p in out)


def numbered(words: Sequence) -> np.ndarray:
    """Equal words get equal numbers."""
    number: dict = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def repeats(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] > 0


def find_runs(
    docs: DataFrame,
    least: int = LEAST,
    exponent: int = EXPONENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_of: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed string)``, a row
    for each row: ``collapsed`` has the words outside repeats, joined by a space.
    ``words_of`` may put other words (of the id and the text's words) in place of a text's."""

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        for key, text in values:
            words = text.encode("utf-8", "surrogatepass").split()
            words = words_of(key, words) if words_of else words
            n = len(words)
            runs = periodic_runs(numbered(words), least, exponent) if n >= least else []
            if runs:
                words = [w for w, gone in zip(words, repeats(runs, n).tolist()) if not gone]
            yield key, n, [{"start": s, "length": length, "period": p} for s, length, p in runs], b" ".join(words).decode("utf-8", "surrogatepass")

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [docs[id_col].alias("doc_id"), text_of(text_col)], rows, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_run(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's words: in a tenth of the documents, by the checksum of the id, the tail
    repeats a stretch. A null id has no checksum and its words stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)``."""
    found = find_runs(docs, words_of=with_planted_run)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.shorter")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
