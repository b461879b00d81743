"""The engine: an index of chunks, batches of queries, and their evaluation.

``Engine.retrieve`` is one plan for a whole batch: queries are routed first; each
route's legs are searched for its queries alone; the legs are fused in one shuffle;
superseded versions go; the head is reranked; and texts join only the hits that are
left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.functions import embedders
from harrier.operators import dense, evaluate, lexical, ranking, rerank, understand, versions
from harrier.shipping import ship


@dataclass(frozen=True)
class Config:
    """How to retrieve: the depth of the legs and of the reranking, what is cut, and which
    legs are searched (``bm25``, ``dense``, ``path``)."""

    depth: int = 50
    k: int = 8
    rerank_depth: int = 20
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    reranked: bool = True
    current_only: bool = True
    legs: tuple[str, ...] = ("bm25", "dense", "path")

    def __post_init__(self):
        if not self.legs or set(self.legs) - {"bm25", "dense", "path"}:
            raise ValueError(f"legs must be some of bm25, dense and path, not {self.legs!r}")


class Engine:
    """Retrieval over ``chunks (chunk_id long, path, text, mtime)``; a ``search_context``, if
    there is one, is indexed with the text.

    ``reranker`` scores batches of ``(query, text)``, as ``rerank.model_scores`` has it; without
    one the overlap reranks. One that was meant to be there but didn't load is named by
    ``reranker_error``: the overlap stands in, and each hit says so in ``degraded``.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None, index: lexical.Index | None = None, reranker: Callable[[list[tuple[str, str]]], Sequence[float]] | None = None, reranker_error: str | None = None):
        ship(spark)
        self.spark, self.chunks, self.index = spark, chunks, index
        self.reranker, self.reranker_error = reranker, reranker_error
        self.vectors = vectors if vectors is not None else chunks.select("chunk_id", embedders.hash_vectors("text").alias("embedding"))

    def save(self, path: str) -> None:
        """Write the index: chunks, vectors, postings and what scoring needs, for ``load``."""
        self.chunks.write.parquet(f"{path}/chunks")
        self.vectors.write.parquet(f"{path}/vectors")
        lexical.write_index(self._indexed(), f"{path}/lexical", item="chunk_id")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        """An engine that searches what ``save`` wrote: no text is tokenised again."""
        return cls(spark, spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), lexical.read_index(spark, f"{path}/lexical"))

    def _indexed(self) -> DataFrame:
        """The chunks with what is indexed of them as their text."""
        return self.chunks.select("chunk_id", lexical.search_text(self.chunks).alias("text"))

    def lexical_hits(self, terms: DataFrame, config: Config) -> DataFrame:
        """``(query_id, item, score, rank)``, from the stored index if there is one."""
        if self.index is not None:
            return lexical.index_top_k(self.index, terms, config.depth, config.k1, config.b)
        return lexical.bm25_top_k(self._indexed(), terms, config.depth, config.k1, config.b, item="chunk_id")

    def retrieve(self, queries: DataFrame, config: Config = Config()) -> DataFrame:
        """``(query_id, rank, chunk_id, path, text, route, rrf, bm25, dense, path_score,
        rerank, degraded)`` of ``queries (query_id long, text)``."""
        routed = understand.route(queries.select("query_id", "text"))
        found = [self._leg(name, routed, config) for name in config.legs]
        none = F.lit(None).cast("double")
        legs = None
        for own, rows in found:
            scores = (F.col("score").alias(name) if name == own else none.alias(name) for name in ("bm25", "dense", "path_score"))
            part = rows.select("query_id", "item", "rank", *scores)
            legs = part if legs is None else legs.unionByName(part)
        share = 1 / (F.lit(float(config.rrf_k)) + F.col("rank"))
        fused = legs.groupBy("query_id", "item").agg(F.round(F.sum(share), 10).alias("rrf"), F.max("bm25").alias("bm25"), F.max("dense").alias("dense"), F.max("path_score").alias("path_score"))
        hits = ranking.top_k(fused, config.depth, score="rrf").join(routed.withColumnRenamed("text", "query"), "query_id")
        hits = hits.join(self.chunks.select(F.col("chunk_id").alias("item"), "path"), "item")
        if config.current_only:
            hits = versions.prefer_current(hits, versions.clusters(self.chunks.select("path", "mtime")))
        if config.reranked:
            head = hits.filter((F.col("rank") <= config.rerank_depth) & ~F.col("skip_rerank")).join(self.chunks.select(F.col("chunk_id").alias("item"), "text"), "item")
            scores = rerank.model_scores(head, self.reranker, allow_fallback=True).select("query_id", "item", F.col("score").alias("rerank"))
            hits = hits.join(scores, ["query_id", "item"], "left")
            order = Window.partitionBy("query_id").orderBy((F.col("rank") > config.rerank_depth).asc(), F.col("rerank").desc_nulls_last(), "rank")
            hits = hits.withColumn("rank", F.row_number().over(order))
        else:
            hits = hits.withColumn("rerank", none)
        kept = hits.filter(F.col("rank") <= config.k)
        texts = self.chunks.select(F.col("chunk_id").alias("item"), "text")
        troubled = self.reranker is None and self.reranker_error is not None and config.reranked
        degraded = F.array(*([F.lit(f"rerank: {self.reranker_error}")] if troubled else [])).cast("array<string>")
        return kept.join(texts, "item").select("query_id", "rank", F.col("item").alias("chunk_id"), "path", "text", "route", "rrf", "bm25", "dense", "path_score", "rerank", degraded.alias("degraded"))

    def _leg(self, name: str, routed: DataFrame, config: Config) -> tuple[str, DataFrame]:
        """A leg's column and its ``(query_id, item, score, rank)``, for the routes it serves."""
        if name == "bm25":
            return "bm25", self.lexical_hits(lexical.query_terms(routed), config)
        if name == "dense":
            asked = routed.filter("not skip_embed").select("query_id", embedders.hash_vectors("text").alias("embedding"))
            return "dense", dense.exact_top_k(self.vectors, asked, config.depth, item="chunk_id")
        named = lexical.path_scores(self.chunks.select("path").distinct(), routed.filter("skip_embed")).withColumnRenamed("item", "path")
        return "path_score", ranking.top_k(named.join(self.chunks.select("path", F.col("chunk_id").alias("item")), "path"), config.depth)

    def evaluate(self, hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """Metrics of each query, against ``qrels (query_id, item, grade)`` on chunk ids."""
        return evaluate.metrics(hits.withColumnRenamed("chunk_id", "item"), qrels, queries, k)

    def explain(self, queries: DataFrame, config: Config = Config()) -> str:
        """The physical plan of a batch."""
        return self.retrieve(queries, config)._jdf.queryExecution().executedPlan().toString()
