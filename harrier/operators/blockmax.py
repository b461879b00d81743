"""Block-max search: postings in blocks with the largest share of each.

Items are dealt into *spans* of about ``span`` items. A block holds the postings of a
term in a span, as arrays, and ``top``, the largest share that any of them can have in a
score. Blocks lie in folders by the hash of their term, in a file for each task that made
some, sorted by term and span. A span of very many tokens may have several blocks of a term.

A query's score in a span can't exceed the sum of its terms' weighted tops there. So a
batch is searched in two passes. Tops alone are read first (a narrow column) and give the
bound of each query and span; the best spans of each query are scored, and the k-th score
found is its threshold. Then blocks are read of those spans only whose bound reaches the
threshold. No item that could be among the k best is left out, ties included. Where the
batch asks for few postings in all (``ONE_PASS``), they are read at once instead.

Scores are made span by span from the blocks' arrays in numpy; a task hands on ``k`` rows
for each query. Null texts have no terms; empty indexes and batches give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.lexical import BROADCAST_TERMS, INDEX_BUCKETS, QueryBlock, bm25_weight, bucket_of, corpus_statistics, token_count
from harrier.operators.ranking import top_k
from harrier.scratch import fresh_folder
from harrier.shipping import ship

#: Items of a span, about.
SPAN = 1_024
#: Postings of a batch that are read without a look at the bounds first.
ONE_PASS = 20_000_000
#: Spans of each query that give the threshold, for each of the k items wanted: the best ones
#: tend to lie in as many spans.
SEEDS = 1.0
#: Queries of a batch; one that has ``BROADCAST_TERMS`` terms takes no further query.
BATCH = 1_024
#: Tokens that are packed at once, about, and blocks that a task hands on at a time.
_TOKENS = 2_000_000
_BLOCKS_OUT = 16_384
#: Items of a task that writes blocks, about, in a table of many: each has a file in every bucket.
_TASK_ITEMS = 16_384
#: What rounding may take off a bound.
_SLACK = 1e-6
#: Rows of needed blocks that are broadcast, at most.
_BROADCAST_BLOCKS = 200_000


@dataclass(frozen=True)
class BlockIndex:
    """``blocks (bucket, term, span, n, top, items, tfs, dls)``, ``terms (bucket, term, df)``,
    and the numbers of the corpus and of the weights that the tops are made with."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int
    k1: float
    b: float


def span_of(items: DataFrame, span: int) -> Column:
    """The span of ``item``: a range of ids, so that neighbours share blocks, where ids are
    numbers spread evenly enough; by their hash otherwise."""
    kind = items.schema["item"].dataType.simpleString()
    n = items.count()
    spans = max(1, -(-n // span))
    by_hash = F.pmod(F.xxhash64("item"), F.lit(spans)).cast("int")
    if kind not in ("int", "bigint") or not n:
        return by_hash
    low, high = items.agg(F.min("item"), F.max("item")).first()
    if low is None:
        return by_hash
    by_range = F.coalesce(F.floor((F.col("item") - F.lit(low)) / F.lit((high - low + 1) / spans)), F.lit(0)).cast("int")
    fullest = items.groupBy(by_range).count().agg(F.max("count")).first()[0]
    return by_range if fullest <= 4 * span else by_hash


def write_blocks(docs: DataFrame, path: str, tokenize: Callable[[Column | str], Column] = T.tokens, item: str = "doc_id", text: Column | str = "text", span: int = SPAN, buckets: int = INDEX_BUCKETS, k1: float = 1.5, b: float = 0.75) -> None:
    """Tokenise ``docs`` and write their block index below ``path``."""
    spark = docs.sparkSession
    corpus = corpus_statistics(docs.select(token_count(text, tokenize).alias("dl")))
    corpus.select("n", "avgdl", F.lit(buckets).alias("buckets"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.lit(docs.schema[item].dataType.simpleString()).alias("item")).write.parquet(f"{path}/corpus")
    corpus_n, avgdl = spark.read.parquet(f"{path}/corpus").select("n", "avgdl").first()
    ship(spark)
    body = (F.col(text) if isinstance(text, str) else text).alias("text")
    place = span_of(docs.select(F.col(item).alias("item")), span)
    tasks = min(-(-corpus_n // span), max(spark.sparkContext.defaultParallelism, -(-corpus_n // _TASK_ITEMS)))
    near = docs.select(F.col(item).alias("item"), body).withColumn("span", place)
    # the texts of a span meet in one task, which writes its part of each bucket: postings aren't shuffled at all
    rows = near.repartition(max(1, tasks), "span").sortWithinPartitions("span", "item").select("item", "span", tokenize("text").alias("tokens"))
    kind = rows.schema["item"].dataType.simpleString()
    average, k1, b, tokens, most = float(avgdl), float(k1), float(b), _TOKENS, _BLOCKS_OUT

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_spans(batches, tokens):
            packed = _packed(table, average, k1, b)
            for at in range(0, packed.num_rows, most):
                yield packed.slice(at, most)

    packed = rows.mapInArrow(pack, f"term string, span int, n int, top double, items array<{kind}>, tfs array<int>, dls array<int>")
    blocks = packed.select(bucket_of(F.col("term"), buckets).alias("bucket"), "*")
    blocks.sortWithinPartitions("bucket", "term", "span").write.partitionBy("bucket").parquet(f"{path}/blocks")
    terms = _blocks_at(spark, path, kind).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")


def _whole_spans(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[pa.Table]:
    """Rows ``(item, span, tokens)`` in the order of their spans, in tables of about so many ``tokens`` that
    end with a span; one of more than four times as many is cut, and has a block of a term for each part."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        spans = batch.column(1).to_numpy(zero_copy_only=False)
        at = 0
        for i in range(batch.num_rows):
            have = n + int(sizes[i - 1] - (sizes[at - 1] if at else 0)) if i > at else n
            if have >= 4 * tokens or have >= tokens and spans[i] != (spans[i - 1] if i else held[-1].column(1)[-1].as_py()):
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, n, at = [], 0, i
        if at < batch.num_rows:
            held.append(batch.slice(at))
            n += int(sizes[-1] - (sizes[at - 1] if at else 0))
    if held:
        yield pa.Table.from_batches(held)


def _packed(rows: pa.Table, average: float, k1: float, b: float) -> pa.RecordBatch:
    """The blocks of the rows by term and span; rows of one item and length in a span count as one."""
    rows = rows.combine_chunks()
    tokens = rows["tokens"].combine_chunks()
    span = rows["span"].to_numpy()
    dl = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    item = pc.fill_null(pc.dictionary_encode(rows["item"].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
    order = np.lexsort((item, dl, span))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(span[order]) != 0) | (np.diff(dl[order]) != 0) | (np.diff(item[order]) != 0)
    one = np.empty(len(order), np.int64)
    one[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(order) else order
    words = pc.dictionary_encode(tokens.flatten())
    by_name = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    pair, tf = np.unique(place[words.indices.to_numpy()] * max(1, len(dl)) + np.repeat(one, dl), return_counts=True)
    term, row = pair // max(1, len(dl)), pair % max(1, len(dl))
    length = dl[row] / average if average > 0 else dl[row].astype(np.float64)
    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
    starts = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(span[row], prepend=-1)) if len(term) else np.zeros(0, np.int64)
    ends = pa.array(np.append(starts, len(term)), pa.int32())
    columns = {
        "term": words.dictionary.take(pa.array(by_name[term[starts]])),
        "span": pa.array(span[row[starts]], pa.int32()),
        "n": pa.array(np.diff(np.append(starts, len(term))), pa.int32()),
        "top": np.maximum.reduceat(share, starts) if len(starts) else share,
        "items": pa.ListArray.from_arrays(ends, rows["item"].combine_chunks().take(pa.array(row))),
        "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
        "dls": pa.ListArray.from_arrays(ends, pa.array(dl[row], pa.int32())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _blocks_at(spark: SparkSession, path: str, item: str) -> DataFrame:
    schema = f"bucket int, term string, span int, n int, top double, items array<{item}>, tfs array<int>, dls array<int>"
    return spark.read.schema(schema).parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    c = spark.read.parquet(f"{path}/corpus").first()
    terms = spark.read.schema("bucket int, term string, df long").parquet(f"{path}/terms")
    return BlockIndex(_blocks_at(spark, path, c.item), terms, c.n, c.avgdl, c.buckets, c.k1, c.b)


@dataclass
class Reads:
    """What a search read: blocks of its terms, and those of them whose postings were read;
    the same counted once for each query that a block was read for; and the postings of its terms."""

    blocks: int = 0
    blocks_read: int = 0
    asked: int = 0
    read: int = 0
    postings: int = 0
    passes: list[str] = field(default_factory=list)


def block_top_k(index: BlockIndex, terms: DataFrame, k: int = 50, one_pass: int = ONE_PASS, reads: Reads | None = None) -> DataFrame:
    """``(query_id, item, score, rank)`` of ``terms (query_id, term, qtf)``; query ids and items
    are whole numbers. ``reads`` is told how much was read, at the price of counting it."""
    out = None
    for block, words, postings in _batches(index, terms):
        if reads is not None:
            reads.postings += postings
        part = _whole(index, block, words, k, reads) if postings <= one_pass else _pruned(index, block, words, k, reads)
        out = part if out is None else out.unionByName(part)
    kinds = terms.schema["query_id"].dataType, index.blocks.schema["items"].dataType.elementType
    return top_k(out, k).select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("item").cast(kinds[1]).alias("item"), "score", "rank")


def _batches(index: BlockIndex, terms: DataFrame) -> Iterator[tuple[QueryBlock, DataFrame, int]]:
    """Batches of queries with their words' weights, ``(bucket, term, word)`` as a DataFrame of at
    most the batch's words, and the number of postings that they have."""
    spark = terms.sparkSession
    asked = terms.select("query_id", "term", "qtf").withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    known = asked.join(index.terms, ["bucket", "term"]).repartition(1, "query_id").sortWithinPartitions("query_id", "term")
    held: dict[int, list] = {}
    sent = False

    def made() -> tuple[QueryBlock, DataFrame, int]:
        ids = np.array(sorted(held), np.int64)
        df = {(r.term, r.bucket): r.df for own in held.values() for r in own}
        number = {term: i for i, (term, _) in enumerate(sorted(df))}
        of = {term: n for (term, _), n in df.items()}
        rows = sorted((number[r.term], i, r.qtf * np.log(1 + (index.n - of[r.term] + 0.5) / (of[r.term] + 0.5))) for i, q in enumerate(ids.tolist()) for r in held[q])
        word, query, weight = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        words = spark.createDataFrame([(b, t, number[t]) for t, b in sorted(df)], "bucket int, term string, word int")
        return QueryBlock(ids, pa.array(sorted(number), pa.string()), word, query, weight), words, sum(df.values())

    n_terms = 0
    for r in known.toLocalIterator():
        if r.query_id not in held and (len(held) == BATCH or n_terms >= BROADCAST_TERMS):
            yield made()
            held, sent, n_terms = {}, True, 0
        held.setdefault(r.query_id, []).append(r)
        n_terms += 1
    if held or not sent:
        yield made()


def _whole(index: BlockIndex, block: QueryBlock, words: DataFrame, k: int, reads: Reads | None) -> DataFrame:
    """All blocks of the batch's words at once."""
    rows = index.blocks.join(F.broadcast(words), ["bucket", "term"])
    if reads is not None:
        n = rows.count()
        pairs = rows.groupBy("word").count().collect()
        many = np.bincount(block.word, minlength=len(block.words))
        asked = sum(int(many[r.word]) * r["count"] for r in pairs)
        reads.blocks, reads.blocks_read, reads.asked, reads.read = reads.blocks + n, reads.blocks_read + n, reads.asked + asked, reads.read + asked
        reads.passes.append("whole")
    return _scored(index, block, rows.withColumn("asking", F.lit(None).cast("array<int>")), k)


def _pruned(index: BlockIndex, block: QueryBlock, words: DataFrame, k: int, reads: Reads | None) -> DataFrame:
    """The bounds, the best spans of each query, and then what can beat their k-th score."""
    spark = words.sparkSession
    by_word = spark.createDataFrame([(int(w), int(q), float(x)) for w, q, x in zip(block.word, block.query, block.weight)], "word int, query int, weight double")
    # a batch's words and queries: bounded by the batch
    tops = index.blocks.select("bucket", "term", "span", "top").join(F.broadcast(words), ["bucket", "term"]).join(F.broadcast(by_word), "word")
    place = fresh_folder(spark, "bounds")
    tops.groupBy("query", "span").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).write.parquet(place)
    bounds = spark.read.parquet(place)
    n_seeds = max(1, round(SEEDS * k))
    seeds = top_k(bounds, n_seeds, "bound", "span", "query").select("query", "span")
    first = _scored(index, block, _asking(index, words, by_word, seeds, len(block.ids) * n_seeds, reads), k)
    # k rows for each query of the batch
    best = top_k(first, k).collect()
    edge = {r.query_id: r.score for r in best if r["rank"] == k}
    number = {q: i for i, q in enumerate(block.ids.tolist())}
    edges = spark.createDataFrame([(number[q], s) for q, s in edge.items()], "query int, edge double")
    rest = bounds.join(F.broadcast(edges), "query", "left").filter(F.col("edge").isNull() | (F.col("bound") + F.lit(_SLACK) >= F.col("edge"))).join(F.broadcast(spark.createDataFrame(seeds.collect(), "query int, span int")), ["query", "span"], "left_anti")
    if reads is not None:
        reads.blocks += tops.select("word", "span").distinct().count()
        reads.asked += tops.count()
        reads.passes.append("pruned")
    more = _scored(index, block, _asking(index, words, by_word, rest.select("query", "span"), None, reads), k)
    return more.unionByName(spark.createDataFrame([(r.query_id, r["item"], r.score) for r in best], "query_id long, item long, score double"))


def _asking(index: BlockIndex, words: DataFrame, by_word: DataFrame, pairs: DataFrame, most: int | None, reads: Reads | None) -> DataFrame:
    """The blocks that the ``pairs (query, span)`` need, each with the queries ``asking`` for it."""
    needed = pairs.join(F.broadcast(by_word), "query").groupBy("word", "span").agg(F.collect_set("query").alias("asking")).join(F.broadcast(words), "word")
    if most is None or most > _BROADCAST_BLOCKS:
        place = fresh_folder(words.sparkSession, "needed-blocks")
        needed.write.parquet(place)
        needed = words.sparkSession.read.schema(needed.schema).parquet(place)
    n = needed.limit(_BROADCAST_BLOCKS + 1).count() if most is None else 0
    met = index.blocks.join(F.broadcast(needed) if n <= _BROADCAST_BLOCKS else needed, ["bucket", "term", "span"])
    if reads is not None:
        n, asked = met.agg(F.count("*"), F.coalesce(F.sum(F.size("asking")), F.lit(0))).first()
        reads.blocks_read, reads.read = reads.blocks_read + n, reads.read + asked
    return met


def _scored(index: BlockIndex, block: QueryBlock, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, item, score)``: the ``k`` best of each query and task, from blocks with their
    ``word`` and the queries ``asking`` (null: all that have the word)."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(block)
    average, k1, b = index.avgdl, index.k1, index.b

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, None
        for items, scores in _span_scores(batches, block, average, k1, b):
            best = block.best(best, scores, items, k)
        if best is not None:
            scores, items = best
            keep = (scores > 0).ravel()
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(block.ids, scores.shape[1])[keep], "item": items.ravel()[keep], "score": scores.ravel()[keep]})

    # a given number of tasks: few bytes hold many postings
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("span", "word", F.col("items").cast("array<long>").alias("items"), "tfs", "dls", "asking").repartition(tasks, "span").sortWithinPartitions("span")
    return dealt.mapInArrow(score, "query_id long, item long, score double")


def _span_scores(batches: Iterator[pa.RecordBatch], block: QueryBlock, average: float, k1: float, b: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each span of sorted batches: its items, and the scores (queries x items)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        spans = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)] if len(spans) else []
        for a, e in zip(edges, edges[1:]):
            if held and held[0].column(0)[0].as_py() != spans[a]:
                yield _one_span(held, block, average, k1, b)
                held = []
            held.append(batch.slice(a, e - a))
    if held:
        yield _one_span(held, block, average, k1, b)


def _one_span(parts: list[pa.RecordBatch], block: QueryBlock, average: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(parts).combine_chunks()
    flat = lambda name: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t[name].chunks])
    many = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in t["items"].chunks])
    word, tf, dl = np.repeat(t["word"].to_numpy(), many), flat("tfs").astype(np.float64), flat("dls").astype(np.float64)
    items, at = np.unique(flat("items"), return_inverse=True)
    length = dl / average if average > 0 else dl
    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length))
    # each posting meets the queries of its word
    first = np.searchsorted(block.word, np.arange(len(block.words) + 1))
    each = (first[1:] - first[:-1])[word]
    before = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(each) else each
    pick = np.repeat(first[:-1][word] - before, each) + np.arange(int(each.sum()))
    query, posting = block.query[pick], np.repeat(np.arange(len(word)), each)
    asking = t["asking"].to_pylist()
    if any(x is not None for x in asking):
        allowed = np.zeros((len(asking), len(block.ids)), bool)
        for i, queries in enumerate(asking):
            allowed[i, queries] = True
        keep = allowed[np.repeat(np.arange(len(asking)), many)[posting], query]
        query, posting, pick = query[keep], posting[keep], pick[keep]
    code = query * len(items) + at[posting]
    flat_scores = np.bincount(code, share[posting] * block.weight[pick], len(block.ids) * len(items))
    return items, np.round(flat_scores, 8).reshape(len(block.ids), len(items))
