"""The lexical index and its searches.

The index is relations: ``postings (doc_id, term, tf)``, ``doc_stats (doc_id, dl)``,
``term_stats (term, df)`` and the two numbers ``n`` and ``avgdl``. A batch of queries
is a relation too, ``(query_id, term, qtf)``: a search is a join of terms, a sum, and
a top-k for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from harrier.functions import text as T
from harrier.operators.dense import CELLS, Running
from harrier.operators.ranking import small, top_k
from harrier.shipping import ship

#: Query terms that are broadcast: a few megabytes.
BROADCAST_TERMS = 100_000


def token_frequencies(docs: DataFrame, text: Column | str = "text", tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id") -> DataFrame:
    """``(item, term, tf)``."""
    return exploded(docs.select(item, tokenize(text).alias("tokens"))).groupBy(item, "term").agg(F.count("*").alias("tf"))


def exploded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``term`` in place of ``tokens``. The outer form is cheaper here: for
    the inner one Spark adds a filter on the array's size, which makes the array twice."""
    return rows.withColumn("term", F.explode_outer("tokens")).filter("term is not null").drop("tokens")


def document_lengths(docs: DataFrame, text: Column | str = "text", tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id") -> DataFrame:
    """``(item, dl)``, with the documents that have no token: a narrow pass."""
    return docs.select(item, token_count(text, tokenize).alias("dl"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row ``(n, avgdl, total)``; the average of no documents is 0."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select("n", F.when(F.col("n") == 0, 0.0).otherwise(F.col("total") / F.col("n")).alias("avgdl"), "total")


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_statistics(postings: DataFrame) -> DataFrame:
    """``(term, df)``."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, tokenize: Callable[[Column | str], Column] = T.tokens, most: int | None = None) -> DataFrame:
    """``(query_id, term, qtf)`` of ``queries (query_id, text)``; of each, the first ``most`` tokens."""
    cut = tokenize("text") if most is None else F.slice(tokenize("text"), 1, most)
    return exploded(queries.select("query_id", cut.alias("tokens"))).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: Column | float, b: Column | float) -> Column:
    """A term's share in the score, without its idf."""
    k1 = F.lit(k1) if isinstance(k1, float) else k1
    b = F.lit(b) if isinstance(b, float) else b
    length = F.when(avgdl > 0, dl / avgdl).otherwise(dl.cast("double"))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))


def bm25_scores(docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, text: Column | str = "text", tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id") -> DataFrame:
    """``(query_id, item, score)`` of all documents with a query term.

    Tokens that no query asks for are dropped, by a semi-join in the scan while the
    batch's terms are few enough to broadcast, before anything is counted or shuffled.
    The corpus' two numbers are one scalar subquery.
    """
    terms = terms.select("query_id", "term", "qtf")
    asked = small(terms.select("term").distinct(), BROADCAST_TERMS)
    # the tokens become a column first: beside an explode, their number would be found anew for each of them
    cut = docs.select(item, tokenize(text).alias("tokens"))
    tokens = exploded(cut.select(item, F.size("tokens").cast("long").alias("dl"), "tokens"))
    tf = tokens.join(asked, "term", "left_semi").groupBy(item, "dl", "term").agg(F.count("*").alias("tf"))
    # a sum over tf keeps that column, so that this side reads the exchange of the other
    df = tf.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))
    lengths = docs.select(token_count(text, tokenize).alias("dl"))
    corpus = corpus_statistics(lengths).select(F.struct("n", "avgdl")).scalar()
    n, avgdl = corpus.getField("n"), corpus.getField("avgdl")
    share = idf(n, F.col("df")) * bm25_weight(F.col("tf"), F.col("dl"), avgdl, k1, b) * F.col("qtf")
    scored = tf.join(small(terms, BROADCAST_TERMS), "term").join(df, "term").groupBy("query_id", F.col(item).alias("item")).agg(F.round(F.sum(share), 8).alias("score"))
    return scored.filter("score > 0")


def token_count(text: Column | str, tokenize: Callable[[Column | str], Column]) -> Column:
    """The number of tokens; the default analyser's are counted without being made."""
    if tokenize is T.tokens:
        return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(T.TOKEN)).cast("long")
    return F.size(tokenize(text)).cast("long")


def bm25_top_k(docs: DataFrame, terms: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, text: Column | str = "text", tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id") -> DataFrame:
    """``(query_id, item, score, rank)``: the best documents of each query.

    Scoring by joins makes a row for each query, posting and common term. Here the
    queries go out in blocks of bounded size instead, many at once, and two narrow passes meet
    them: the first counts documents by term, the second scores each Arrow batch for all
    blocks and hands on ``k`` rows for each query and task, which is all that is shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[item].dataType
    if not isinstance(kind, (LongType, IntegerType)):
        return top_k(bm25_scores(docs, terms, k1, b, text, tokenize, item), k)
    ship(spark)
    rows = docs.select(F.col(item).cast("long").alias("item"), tokenize(text).alias("tokens"))
    out = None
    for blocks in _together(_term_blocks(terms)):
        words = spark.sparkContext.broadcast(blocks[0].words)

        def count(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            seen, n, total = np.zeros(len(words.value), np.int64), 0, 0
            for batch in batches:
                _, term, _, lengths = postings_of(batch.column(1), words.value)
                seen += np.bincount(term, minlength=len(seen))
                n, total = n + len(lengths), total + int(lengths.sum())
            yield pa.RecordBatch.from_pydict({"term": np.arange(-2, len(seen)), "n": np.concatenate([[n, total], seen])})

        # a row for each of the blocks' terms
        found = {r.term: r.n for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = found.get(-2, 0), found.get(-1, 0)
        df = np.array([found.get(i, 0) for i in range(len(blocks[0].words))], np.float64)
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast([block.weighted(weights) for block in blocks])
        average = total / n if n else 0.0

        def score(batches: Iterator[pa.RecordBatch], shared=shared, average=average) -> Iterator[pa.RecordBatch]:
            best = [Running(len(block.ids), k) for block in shared.value]
            most = max(1, *(len(block.ids) for block in shared.value))
            for batch in batches:
                for part in _slices(batch, max(1, CELLS // most)):
                    items, found = part.column(0).to_numpy(zero_copy_only=False), postings_of(part.column(1), shared.value[0].words)
                    for block, held in zip(shared.value, best):
                        held.add(block.scored(found, average, k1, b), items, 8, positive=True)
            for block, held in zip(shared.value, best):
                yield from held.batches(block.ids)

        part = rows.mapInArrow(score, "query_id long, item long, score double")
        out = part if out is None else out.unionByName(part)
    q = terms.schema["query_id"].dataType
    return top_k(out, k).select(F.col("query_id").cast(q).alias("query_id"), F.col("item").cast(kind).alias("item"), "score", "rank")


def postings_of(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's token lists: row, word and frequency of each pair of a row and one of
    ``words`` in it, and the rows' lengths."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    known = at >= 0
    pair, tf = np.unique(row[known] * max(1, len(words)) + at[known], return_counts=True)
    return pair // max(1, len(words)), pair % max(1, len(words)), tf, lengths


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@dataclass
class QueryBlock:
    """A block of queries: their ids, their words, and (word, query, qtf) by word."""

    ids: np.ndarray
    words: pa.Array
    word: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    def weighted(self, idf: np.ndarray) -> QueryBlock:
        return QueryBlock(self.ids, self.words, self.word, self.query, self.weight * idf[self.word] if len(self.word) else self.weight)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.searchsorted(self.word, np.arange(len(self.words) + 1))

    def scored(self, postings: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], average: float, k1: float, b: float) -> np.ndarray:
        """Scores of queries (rows) and the documents (columns) that the postings are of, not rounded."""
        row, term, tf, lengths = postings
        starts = self.starts
        asked = starts[1:] > starts[:-1]
        row, term, tf = (x[asked[term]] for x in (row, term, tf))
        length = lengths[row] / average if average > 0 else lengths[row].astype(np.float64)
        share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
        many = (starts[1:] - starts[:-1])[term]
        at = np.repeat(starts[:-1][term] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many, many) + np.arange(int(many.sum()))
        code = self.query[at] * len(lengths) + np.repeat(row, many)
        flat = np.bincount(code, np.repeat(share, many) * self.weight[at], len(self.ids) * len(lengths))
        return flat.reshape(len(self.ids), len(lengths))

    def best(self, held: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of what is held and what is new, for each query."""
        many = np.broadcast_to(items, scores.shape)
        if held is not None:
            scores, many = np.hstack([held[0], scores]), np.hstack([held[1], many])
        if scores.shape[1] > 4 * k:  # all that reach the k-th score, ties included, before they are sorted
            edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            wanted = scores >= edge
            most = int(wanted.sum(axis=1).max())
            if most < scores.shape[1] // 2:
                pick = np.argsort(~wanted, axis=1, kind="stable")[:, :most]
                scores, many = np.take_along_axis(scores, pick, 1), np.take_along_axis(many, pick, 1)
        order = np.lexsort((many, -scores), axis=1)[:, :k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(many, order, 1)


def _term_blocks(terms: DataFrame, most: int = 1_024) -> Iterator[QueryBlock]:
    """Blocks of at most ``most`` queries; there is one, if empty, for no queries."""
    held: dict[int, list[tuple[str, int]]] = {}
    sent = False
    for q, term, qtf in terms.select("query_id", "term", "qtf").repartition(1, "query_id").sortWithinPartitions("query_id", "term").toLocalIterator():
        if q not in held and len(held) == most:
            yield _block(held)
            held, sent = {}, True
        held.setdefault(q, []).append((term, qtf))
    if held or not sent:
        yield _block(held)


#: Blocks that a pass over the texts meets at once; a task keeps ``k`` rows for each of their queries.
BLOCKS_AT_ONCE = 32


def _together(blocks: Iterator[QueryBlock]) -> Iterator[list[QueryBlock]]:
    """Blocks in groups; those of a group have all its words."""
    while group := list(islice(blocks, BLOCKS_AT_ONCE)):
        words = sorted({w for block in group for w in block.words.to_pylist()})
        number, shared = {w: i for i, w in enumerate(words)}, pa.array(words, pa.string())
        place = [np.array([number[w] for w in block.words.to_pylist()], np.int64) for block in group]
        # both lists of words are sorted, so a block's pairs stay in order
        yield [QueryBlock(block.ids, shared, at[block.word] if len(at) else block.word, block.query, block.weight) for block, at in zip(group, place)]


def _block(held: dict[int, list[tuple[str, int]]]) -> QueryBlock:
    ids = np.array(sorted(held), np.int64)
    words = sorted({t for own in held.values() for t, _ in own})
    number = {t: i for i, t in enumerate(words)}
    rows = sorted((number[t], i, float(n)) for i, q in enumerate(ids.tolist()) for t, n in held[q])
    word, query, weight = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return QueryBlock(ids, pa.array(words, pa.string()), word, query, weight)


@dataclass(frozen=True)
class Index:
    """A stored lexical index: ``postings (bucket, term, item, tf, dl)``, dealt by the hash
    of the term and sorted by it, ``terms (bucket, term, df)``, and the corpus' two numbers."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int


#: Folders of the postings: a search reads those of its terms only. A folder for each
#: gigabyte of postings or so is a good number.
INDEX_BUCKETS = 64


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id", text: Column | str = "text", buckets: int = INDEX_BUCKETS) -> None:
    """Tokenise ``docs`` once and write the index below ``path``."""
    cut = docs.select(F.col(item).alias("item"), tokenize(text).alias("tokens"))
    each = exploded(cut.select("item", F.size("tokens").cast("long").alias("dl"), "tokens"))
    tf = each.groupBy("item", "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # by size: small buckets share a task, one that frequent terms make large is split
    dealt = tf.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "item")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = docs.sparkSession
    terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    corpus_statistics(docs.select(token_count(text, tokenize).alias("dl"))).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> Index:
    n, avgdl, buckets = spark.read.parquet(f"{path}/corpus").select("n", "avgdl", "buckets").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n, avgdl, buckets)


def index_top_k(index: Index, terms: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query_id, item, score, rank)`` from a stored index, for ``terms (query_id, term,
    qtf)``: no text is read. The terms' side is broadcast while it is small, and prunes
    the folders of postings; each posting of an asked term is read once."""
    asked = terms.select("query_id", "term", "qtf").withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    known = asked.join(index.terms, ["bucket", "term"]).select("bucket", "term", "query_id", (idf(F.lit(float(index.n)), F.col("df")) * F.col("qtf")).alias("weight"))
    share = F.col("weight") * bm25_weight(F.col("tf"), F.col("dl"), F.lit(float(index.avgdl)), k1, b)
    met = index.postings.join(small(known, BROADCAST_TERMS), ["bucket", "term"])
    scored = met.groupBy("query_id", "item").agg(F.round(F.sum(share), 8).alias("score")).filter("score > 0")
    return top_k(scored, k)


def search_text(chunks: DataFrame, context: str = "search_context", text: str = "text") -> Column:
    """What is indexed of a chunk: its context, where it has one, a line end, and its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.concat_ws("\n", F.col(context), body) if context in chunks.columns else body


def full_text_scores(docs: DataFrame, terms: DataFrame, text: Column | str = "text", tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id") -> DataFrame:
    """``(query_id, item, score)`` of a full-text match of any of a query's terms, by cover
    density: where terms are alternatives, each of their places is a cover of its own, and
    a place counts .1. Tokens that no query asks for are dropped in the scan."""
    asked = terms.select("query_id", "term").distinct()
    tokens = exploded(docs.select(F.col(item).alias("item"), tokenize(text).alias("tokens")))
    tf = tokens.join(small(asked.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi").groupBy("item", "term").agg(F.count("*").alias("tf"))
    return tf.join(small(asked, BROADCAST_TERMS), "term").groupBy("query_id", "item").agg(F.round(F.sum("tf") * F.lit(0.1), 8).alias("score"))


def all_terms(scored_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """The ``(query_id, item)`` of ``scored_terms (query_id, item, term)`` that have every
    term of their query."""
    wanted = terms.select("query_id", "term").distinct().groupBy("query_id").agg(F.count("*").alias("wanted"))
    had = scored_terms.select("query_id", "item", "term").distinct().groupBy("query_id", "item").agg(F.count("*").alias("had"))
    return had.join(wanted, "query_id").filter("had = wanted").select("query_id", "item")


def path_scores(paths: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, path, score)`` of the paths that a query names: 5 for the name, 3
    for the whole path, 2 for the name without its extension.

    A path can only match where the query holds its stem, so candidates come from an
    equi-join of the query's substrings at word borders with the stems, not from all
    pairs.
    """
    q = queries.select("query_id", F.lower("text").alias("q"))
    pieces = F.split(F.col("q"), r"[^\p{L}\p{N}_./-]+")
    # every run of characters between the separators of a piece may be a name or a stem
    cuts = F.flatten(F.transform(pieces, lambda p: F.concat(F.array(p), _sub_pieces(p))))
    keyed = q.select("query_id", "q", F.explode(F.array_distinct(cuts)).alias("key")).filter("key <> ''")
    p = paths.select("path", F.lower("path").alias("lp")).withColumns({"name": T.basename("lp"), "key": F.lower(T.stem("lp"))})
    found = keyed.join(p, "key").select("query_id", "q", "path", "lp", "name", "key").distinct()
    score = F.when((F.col("name") != "") & F.col("q").contains(F.col("name")), 5).otherwise(0) + F.when(F.col("q").contains(F.col("lp")), 3).otherwise(0) + F.when((F.col("key") != "") & F.col("q").contains(F.col("key")), 2).otherwise(0)
    return found.select("query_id", F.col("path").alias("item"), score.cast("double").alias("score")).filter("score > 0")


def _sub_pieces(piece: Column) -> Column:
    """The parts of a piece between slashes, and each of these up to each of its dots."""
    parts = F.split(piece, "/")
    return F.flatten(F.transform(parts, lambda s: F.concat(F.array(s), F.transform(F.sequence(F.lit(1), F.size(F.split(s, r"\."))), lambda i: F.array_join(F.slice(F.split(s, r"\."), 1, i), ".")))))


def fallback_tiers(tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each query the rows of the first tier that has any: each tier is a label and
    rows ``(query_id, item, score)``; the label travels with the rows."""
    from pyspark.sql import Window

    every = None
    for i, (label, rows) in enumerate(tiers):
        part = rows.select("query_id", "item", "score", F.lit(i).alias("tier"), F.lit(label).alias("backend"))
        every = part if every is None else every.unionByName(part)
    best = F.min("tier").over(Window.partitionBy("query_id"))
    return every.withColumn("best", best).filter("tier = best").drop("tier", "best")


def visible(rows: DataFrame, allowed: list[str], private: str = "private", item: str = "doc_id") -> DataFrame:
    """Rows that aren't private, or whose id is allowed; a null flag isn't private."""
    public = F.coalesce(F.col(private) != "true", F.lit(True))
    return rows.filter(public | F.col(item).cast("string").isin(allowed) if allowed else public)
