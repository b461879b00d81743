"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the test items: each run of ``window`` words, or the
whole item where it has fewer. Patterns of one length share a table:

* the *shift table* says for a block (the last two words under the probe; one word
  for patterns of one) how far the probe can move on: past every place where no
  pattern can end;
* where the shift is zero, a *bucket*, chosen by the hash of that suffix block, holds
  the patterns that end in it, keyed by the hash of their first block;
* a *direct comparison* of all words confirms the occurrence.

Words are bytes: A-Z lower-cased, everything outside ``[0-9a-z]`` and ASCII dropped,
characters beyond ASCII kept. Nulls and empty texts have no words and no hits; an
item without words has no window; an item without an id is named ``null``. Repeated
rows each get their row; empty documents give no rows, and without test items nothing
is hit. Texts of any length are searched whole. Columns that aren't carried are left
out; carried ones may have any name but those of the results.

The test items are dealt into blocks of bounded size; each block is broadcast and
searched in one narrow pass, and a pass hands the intervals it found to the next. So
memory is bounded for any number of items, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from harrier.llm.common import map_rows, ship, slices, text_of

WINDOW = 10
#: Most windows in a block of test items that is broadcast at once (about 25 MB).
BLOCK_WINDOWS = 100_000

#: Bytes of words to themselves, A-Z to a-z, all others to a space.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    """The item's windows: a shorter item is one window, an empty one has none."""
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


class WuManber:
    """The search for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.furthest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[int, dict[int, list[tuple[tuple[bytes, ...], list[int]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), length - end)
            suffix, prefix = hash(pattern[-self.block :]), hash(pattern[: self.block])
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The ends of all occurrences, and the items of their patterns."""
        shift, furthest, length, n = self.shift.get, self.furthest, self.length, len(words)
        end = length
        if self.block == 2:
            while end <= n:
                move = shift((words[end - 2], words[end - 1]), furthest)
                if move:
                    end += move
                else:
                    yield from self._confirm(words, end)
                    end += 1
        else:
            for end in range(1, n + 1):
                if not shift((words[end - 1],), furthest):
                    yield from self._confirm(words, end)

    def _confirm(self, words: list[bytes], end: int) -> Iterator[tuple[int, list[int]]]:
        start = end - self.length
        here = tuple(words[start:end])
        for pattern, items in self.buckets.get(hash(here[-self.block :]), {}).get(hash(here[: self.block]), ()):
            if pattern == here:
                yield end, items


class Searcher:
    """All patterns of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        patterns: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for number, text in items:
            for pattern in windows_of(words_of(text), window):
                known = patterns.setdefault(len(pattern), {}).setdefault(pattern, [])
                if number not in known:
                    known.append(number)
        self.tables = [WuManber(length, found) for length, found in sorted(patterns.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The intervals of words hit (joined, ascending) and the numbers of the items."""
        spans, items = [], set()
        for table in self.tables:
            for end, found in table.search(words):
                spans.append((end - table.length, end))
                items.update(found)
        return joined(spans), items


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, ascending."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


_searchers: dict[tuple[int, int], Searcher] = {}


def _searcher(key: tuple[int, int], block: Broadcast) -> Searcher:
    """The worker's tables for a block; two at most are kept."""
    if key not in _searchers:
        if len(_searchers) >= 2:
            _searchers.clear()
        _searchers[key] = Searcher([(i, text) for i, (_, text) in enumerate(block.value)], key[1])
    return _searchers[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``most`` windows (one item at least)."""
    held, size = [], 0
    for item, text in benchmark.select(id_col, text_of(text_col)).toLocalIterator(prefetchPartitions=False):
        n = len(text) // 2 + 1  # at least its windows
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    carry: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The carried columns with ``n_words, spans array<struct<start, end>>`` (word
    positions hit) ``, items array<string>`` (ids of items that occur, as sorted strings)."""
    spark = docs.sparkSession
    if clash := {"n_words", "spans", "items"} & {c.lower() for c in carry}:
        raise ValueError(f"carried columns have the names of results: {sorted(clash)}")
    # the carried columns travel under names of their own
    kept = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    schema = f"{kept}, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    out, columns = docs, [*(docs[c] for c in carry), text_of(text_col).alias("text"), F.lit(0).cast("long"), F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")]
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    ahead = next(blocks)
    while ahead is not None:
        block, ahead = ahead, next(blocks, None)
        out = _search(out, columns, spark.sparkContext.broadcast(block), window, schema, len(carry), last=ahead is None)
        columns = [F.col(f"`{c}`") for c in out.columns]
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(carry)), "n_words", "spans", "items")


def _search(docs: DataFrame, columns: list[Column], block: Broadcast, window: int, schema: str, n_carried: int, last: bool) -> DataFrame:
    key = (block._jbroadcast.id(), window)

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        names = ["null" if item is None else str(item) for item, _ in block.value]
        search = _searcher(key, block).search
        for *carried, text, _, spans, items in values:
            words = words_of(text)
            new, found = search(words)
            if spans:
                new = joined([*new, *((s["start"], s["end"]) for s in spans)])
            if found:
                items = sorted({*items, *(names[i] for i in found)})
            yield *carried, (None if last else text), len(words), [{"start": a, "end": b} for a, b in new], items

    return map_rows(docs, columns, rows, schema)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, a row for each row."""
    found = find_contamination(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns: one narrow pass for
    each block of test items."""
    ship(docs.sparkSession)
    for block in _blocks(benchmark, "item_id", "text", window, BLOCK_WINDOWS):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.filter(_is_clean(shared, window)(text_of(text_col)))
    return docs


def _is_clean(block: Broadcast, window: int):
    key = (block._jbroadcast.id(), window)

    @F.arrow_udf(BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        search = _searcher(key, block).search
        return pa.array([not search(words_of(t))[0] for part in slices(texts) for t in part.to_pylist()], pa.bool_())

    return clean
