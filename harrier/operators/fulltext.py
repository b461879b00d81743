"""Full-text search by positions: words, phrases, alternatives and exclusions, ranked by
cover density.

A query is alternatives (``or``) of conjunctions of parts; a part is a word or a quoted
phrase, and one with ``-`` before it must be absent. ``positions`` is the index: the
places of each term in each item. Terms that no query asks for are dropped in its scan.

A *cover* is a stretch of an item in which some alternative has all its parts, and that
holds no smaller such stretch. Each cover counts 0.1, divided by one and the number of
its words that aren't the query's; an item's score is the sum. Covers are found by one
sweep over the merged places: for each place where a part ends, the largest start from
which an alternative is whole; where that start moves on, a cover ends. As in ranked
full-text search of databases, exclusions decide which items match but not their score.

Null texts have no terms. A part without terms is left out, an alternative without a
wanted part selects nothing. Repeated items are one item. Ties are broken by the item.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.lexical import BROADCAST_TERMS
from harrier.operators.ranking import small
from harrier.shipping import ship

#: Fixed value: what a cover of the query's words alone counts.
COVER = 0.1
#: Queries that are broadcast, at most; more are joined by a shuffle.
BROADCAST_QUERIES = 20_000

Tokenizer = Callable[[Column | str], Column]


def positions(docs: DataFrame, text: Column | str = "text", tokenize: Tokenizer = T.tokens, item: str = "doc_id", dropped: tuple[str, ...] = ()) -> DataFrame:
    """``(item, term, at array<int>)``: the places of each term, from 0. Dropped terms (stop
    words) keep their places."""
    cut = docs.select(F.col(item).alias("item"), tokenize(text).alias("tokens"))
    each = cut.select("item", F.posexplode("tokens").alias("at", "term"))
    kept = each.filter(~F.col("term").isin(*dropped)) if dropped else each
    return kept.groupBy("item", "term").agg(F.array_sort(F.collect_set("at")).alias("at"))


def parsed(queries: DataFrame, mode: str = "web", tokenize: Tokenizer = T.tokens, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``(query_id, parts array<struct<alternative, negated, words>>)`` of ``queries (query_id, text)``.

    ``web``: quotes, ``or`` and ``-`` are read; ``all``: each word is a part of one alternative;
    ``any``: each is an alternative; ``phrase``: all words are one part. An ``or`` without a
    part on either side says nothing.
    """
    q = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    if mode == "web":
        raw = q.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(r'-?"[^"]*"?|[^\s"]+'), F.lit(0))).alias("turn", "raw"))
        is_or = F.lower("raw") == "or"
        counted = raw.withColumn("alternative", F.sum(is_or.cast("int")).over(Window.partitionBy("query_id").orderBy("turn")).cast("int"))
        cut = counted.filter(~is_or).withColumns({"negated": F.col("raw").startswith("-"), "words": tokenize(F.regexp_replace("raw", '^-|"', ""))})
    elif mode in ("all", "any", "phrase"):
        whole = q.withColumn("words", tokenize("text"))
        each = whole.select("query_id", F.posexplode("words").alias("turn", "word"))
        cut = whole.withColumn("turn", F.lit(0)) if mode == "phrase" else each.withColumn("words", F.array("word"))
        cut = cut.withColumns({"alternative": (F.col("turn") if mode == "any" else F.lit(0)).cast("int"), "negated": F.lit(False)})
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if dropped:
        cut = cut.withColumn("words", F.filter("words", lambda w: ~w.isin(*dropped)))
    parts = cut.filter(F.size("words") > 0).groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("alternative", "negated", "words"))).alias("parts"))
    return parts


def occurrences(words: list[str], at: dict[str, list[int]]) -> list[int]:
    """Where the words stand one after the other."""
    if len(words) == 1:
        return at.get(words[0], [])
    rest = [set(at.get(w, ())) for w in words[1:]]
    return [p for p in at.get(words[0], ()) if all(p + i in s for i, s in enumerate(rest, 1))]


def covers(parts: list[dict], at: dict[str, list[int]]) -> list[tuple[int, int]] | None:
    """The covers ``(start, end)`` of an item in their order; None, if it doesn't match."""
    wanted: dict[int, list[tuple[list[int], int]]] = {}
    barred: set[int] = set()
    for part in parts:
        found = occurrences(part["words"], at)
        if part["negated"]:
            if found:
                barred.add(part["alternative"])
        else:
            wanted.setdefault(part["alternative"], []).append((found, len(part["words"])))
    whole = {a: own for a, own in wanted.items() if all(found for found, _ in own)}
    if not set(whole) - barred:
        return None
    ends = sorted({p + n - 1 for own in whole.values() for found, n in own for p in found})
    out, last = [], -1
    for end in ends:
        start = -1
        for own in whole.values():
            # of each part the last occurrence that ends here or before
            turns = [(found, bisect_right(found, end - n + 1)) for found, n in own]
            if all(i for _, i in turns):
                start = max(start, min(found[i - 1] for found, i in turns))
        if start > last:
            out.append((start, end))
            last = start
    return out


def density(parts: list[dict], at: dict[str, list[int]]) -> float | None:
    """The item's score; None, if it doesn't match."""
    found = covers(parts, at)
    if found is None:
        return None
    places = sorted({p for own in at.values() for p in own})
    own = lambda a, b: bisect_right(places, b) - bisect_left(places, a)
    return sum(COVER / (1 + (b - a + 1) - own(a, b)) for a, b in found)


def full_text(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, item, score)`` of the matching items, of ``postings (item, term, at)`` and
    ``queries (query_id, parts)``."""
    ship(postings.sparkSession)
    words = F.flatten(F.transform("parts", lambda p: p["words"]))
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
    met = postings.join(small(asked, BROADCAST_TERMS), "term")
    # an alternative whose terms aren't all there needn't be looked at
    by_item = met.groupBy("query_id", "item").agg(F.collect_list("term").alias("terms"), F.collect_list("at").alias("places"))
    rows = by_item.join(small(queries.select("query_id", "parts"), BROADCAST_QUERIES), "query_id")
    alternatives = F.array_distinct(F.transform(F.filter("parts", lambda p: ~p["negated"]), lambda p: p["alternative"]))
    needs = lambda a: F.flatten(F.transform(F.filter("parts", lambda p: (p["alternative"] == a) & ~p["negated"]), lambda p: p["words"]))
    possible = F.exists(alternatives, lambda a: F.size(F.array_except(needs(a), F.col("terms"))) == 0)

    @F.arrow_udf("double")
    def score(parts: pa.Array, terms: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(parts.to_pylist(), terms.to_pylist(), places.to_pylist())
        return pa.array([density(p, dict(zip(t, a))) for p, t, a in rows], pa.float64())

    scored = rows.filter(possible).select("query_id", "item", score("parts", "terms", "places").alias("score"))
    return scored.filter("score is not null").withColumn("score", F.round("score", 8))
