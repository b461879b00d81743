"""Token counts by a two-tier, map-side lookup of pre-token lengths.

Tier 1 is a compact table of frequent pre-tokens and their lengths in tokens, made
from a bounded sample and broadcast: of ``SAMPLE_SPLITS`` splits, evenly dealt over the
table, a few texts each, ``sample_docs`` in all. They are counted where they lie; only
counts are moved. Tier 2 is a cache in each worker, filled by encoding the pre-tokens
that tier 1 lacks. The pre-tokens of the texts are never shuffled; the sample changes
only the speed, since every length comes from the tokenizer itself.

Nulls count as the empty text: 0 bytes, 0 tokens. A special string inside a text is
one token, as the tokenizer's file says. Texts of any length are counted whole;
repeated rows are counted alike; empty tables give no rows; other columns aren't read,
whatever their names.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrier.llm.common import map_rows, text_of

#: Bounds of tier 1: texts sampled, splits they come from, entries, and UTF-8 bytes of an entry.
SAMPLE_DOCS = 2_000
SAMPLE_SPLITS = 200
TABLE_ENTRIES = 65_536
ENTRY_BYTES = 32
#: Bounds of tier 2 in each worker.
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64


class PretokenLengths(dict):
    """Lengths of pre-tokens in tokens: known ones, then what the tokenizer says."""

    def __init__(self, tokenizer, frequent: dict[str, int], entries: int = CACHE_ENTRIES):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.limit = tokenizer, frequent, len(frequent) + entries

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


class Counters:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, definition: str, pattern: str, frequent: dict[str, int]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self.split = regex.compile(pattern).findall
        self.lengths = PretokenLengths(self.tokenizer, frequent)

    def count(self, text: str) -> int:
        """Tokens of a text: its parts between special strings, and one for each."""
        if self.special is None or not self.special.search(text):
            return sum(map(self.lengths.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.lengths.__getitem__, self.split(p))) for p in parts)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent_lengths(docs: DataFrame, definition: str, pattern: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> pa.Table:
    """Tier 1: ``word, n``, at most ``entries`` rows of at most ``ENTRY_BYTES`` bytes,
    counted over about ``sample_docs`` texts."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    texts = docs.select(text_of(text_col).alias("text"))
    n_splits = max(1, texts._jdf.queryExecution().toRdd().getNumPartitions())
    every = -(-n_splits // SAMPLE_SPLITS)
    quota = -(-sample_docs // -(-n_splits // every))

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        if TaskContext.get().partitionId() % every:
            return
        own, seen = Counters(shared.value, pattern, {}), Counter()
        for (text,) in islice(values, quota):
            seen.update(own.split(text))
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(2 * entries)))
        special = own.special
        short = ((w, c) for w, c in seen.most_common() if len(w.encode()) <= ENTRY_BYTES and not (special and special.search(w)))
        for _, (word, count) in zip(range(entries), short, strict=False):
            yield word, own.lengths[word], count

    counted = map_rows(texts, ["text"], rows, "word string, n int, seen long").groupBy("word").agg(F.max("n").alias("n"), F.sum("seen").alias("seen"))
    return counted.orderBy(F.desc("seen"), "word").limit(entries).select("word", "n").toArrow()


_counters: dict[int, Counters] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row for each row of ``docs``.

    ``pattern`` is what the tokenizer's byte-level pre-tokenizer splits by.
    """
    context = docs.sparkSession.sparkContext
    definition = read_definition(path)
    table = frequent_lengths(docs, definition, pattern, text_col)
    shared = context.broadcast((definition, table))  # at most 65,536 entries of 32 bytes, and the vocabulary file
    number = shared._jbroadcast.id()

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        if number not in _counters:
            text, known = shared.value
            _counters.clear()
            _counters[number] = Counters(text, pattern, dict(zip(known["word"].to_pylist(), known["n"].to_pylist(), strict=True)))
        count = _counters[number].count
        for key, text in values:
            n = count(text)
            yield key, len(text.encode("utf-8", "surrogatepass")), n, n > limit

    return map_rows(docs, [docs[id_col].alias("doc_id"), text_of(text_col)], rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
