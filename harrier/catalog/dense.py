"""Dense retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, QUERIES_SQL, TF_SQL, Catalog, all_vector_queries, bm25_sql, docs, table, text_queries, top_sql
from harrier.functions import text as T
from harrier.functions import vectors as V
from harrier.operators import dense as D
from harrier.operators import interaction as I
from harrier.operators import lexical as L
from harrier.operators import ranking as R
from harrier.operators import routed as G
from harrier.scratch import fresh_folder

CATALOG = Catalog()

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v FROM embeddings)"
_DOT = "round(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])), 10)"
_COS = f"{_UNIT}, cs AS (SELECT a.vec_id AS query_id, b.vec_id AS item, {_DOT.format(a='a.v', b='b.v')} AS score FROM u a, u b WHERE a.vec_id % 100 = 0)"


@CATALOG.add(f"WITH {_COS}, {top_sql('cs', 10, 'r', 'item')} SELECT query_id, item, score, rank FROM r")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_top_k(table(spark, sf_dir, "embeddings"), all_vector_queries(spark, sf_dir), 10)


@CATALOG.add(f"WITH {_UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 8) AS length2, round(v[1], 8) AS first FROM u")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.unit("embedding").alias("v"))
    return e.select("vec_id", F.round(V.dot("v", "v"), 8).alias("length2"), F.round(F.element_at("v", 1), 8).alias("first"))


# a document's vector is that of its number; queries are the documents whose number is divisible by 100
_ASKED = QUERIES_SQL.replace("item_id AS query_id", "doc_id AS query_id").replace("FROM benchmark", "FROM docs WHERE doc_id % 100 = 0")
_LEGS = f"{TF_SQL}, {QT_SQL.replace(QUERIES_SQL, _ASKED)}, {bm25_sql()}, {top_sql('bm', 50, 'lex')}, {_COS}, {top_sql('cs', 50, 'den', 'item')}"


@CATALOG.add(f"""WITH {_LEGS},
  f AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.item, l.doc_id) AS item,
        round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 10) AS score, d.score AS dense, l.score AS bm25
        FROM den d FULL OUTER JOIN (SELECT * FROM lex) l ON d.query_id = l.query_id AND d.item = l.doc_id),
  {top_sql('f', 10, 'r', 'item')} SELECT query_id, item, score AS rrf, dense, bm25, rank FROM r""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rrf_hybrid(spark, sf_dir, _asked(spark, sf_dir), all_vector_queries(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, text)``: the first twelve tokens of each document whose number is divisible by 100."""
    d = docs(spark, sf_dir).filter("doc_id % 100 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.tokens("text"), 1, 12), " ").alias("text"))


def _rrf_hybrid(spark: SparkSession, sf_dir: str, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    lex = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(texts), 50)
    den = D.exact_top_k(table(spark, sf_dir, "embeddings"), vectors, 50)
    nothing = F.lit(None).cast("double")
    both = den.select("query_id", "item", "rank", F.col("score").alias("dense"), nothing.alias("bm25")).unionByName(lex.select("query_id", "item", "rank", nothing.alias("dense"), F.col("score").alias("bm25")))
    fused = both.groupBy("query_id", "item").agg(F.round(F.sum(1 / (60 + F.col("rank"))), 10).alias("rrf"), F.max("dense").alias("dense"), F.max("bm25").alias("bm25"))
    return R.top_k(fused, 10, score="rrf")


_WEIGHTS = [(0.25, 10), (0.5, 10), (1.0, 10), (2.0, 10), (0.25, 60), (0.5, 60), (1.0, 60), (2.0, 60)]


@CATALOG.add(f"""WITH {_LEGS}, g AS (SELECT * FROM (VALUES {", ".join(f"({w}::DOUBLE, {k}::BIGINT)" for w, k in _WEIGHTS)}) AS v(weight, k)),
  e AS (SELECT query_id, item, rank, weight AS w, weight, k FROM den, g UNION ALL SELECT query_id, doc_id, rank, 1.0::DOUBLE, weight, k FROM lex, g),
  f AS (SELECT weight, k, query_id, item, round(sum(w / (k + rank)), 10) AS score FROM e GROUP BY ALL)
  SELECT weight, k, query_id, item, score AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY weight, k, query_id ORDER BY score DESC, item) AS rank FROM f) WHERE rank <= 3""")
def weighted_rrf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted_rrf_grid(spark, sf_dir, _asked(spark, sf_dir), all_vector_queries(spark, sf_dir))


def _weighted_rrf_grid(spark: SparkSession, sf_dir: str, texts: DataFrame, vectors: DataFrame) -> DataFrame:
    lex = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(texts), 50)
    den = D.exact_top_k(table(spark, sf_dir, "embeddings"), vectors, 50)
    # the grid is a constant array, not a join
    grid = F.array(*(F.struct(F.lit(float(w)).alias("weight"), F.lit(k).alias("k")) for w, k in _WEIGHTS))
    every = den.select("query_id", "item", "rank", F.lit(True).alias("dense")).unionByName(lex.select("query_id", "item", "rank", F.lit(False).alias("dense")))
    spread = every.withColumn("g", F.explode(grid)).select("query_id", "item", "rank", "g.weight", "g.k", F.when(F.col("dense"), F.col("g.weight")).otherwise(1.0).alias("w"))
    fused = spread.groupBy("weight", "k", "query_id", "item").agg(F.round(F.sum(F.col("w") / (F.col("k") + F.col("rank"))), 10).alias("rrf"))
    return R.top_k(fused, 3, score="rrf", by=["weight", "k", "query_id"])


@CATALOG.add(f"""WITH {_UNIT}, b AS (SELECT vec_id, v, list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits FROM u),
  h AS (SELECT q.vec_id AS query_id, d.vec_id AS item, -list_sum(list_transform(list_zip(q.bits, d.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS score, {_DOT.format(a='q.v', b='d.v')} AS cosine FROM b q, b d WHERE q.vec_id % 100 = 0),
  {top_sql('h', 40, 'c', 'item')}, s AS (SELECT query_id, item, cosine AS score FROM c), {top_sql('s', 10, 'r', 'item')} SELECT query_id, item, score, rank FROM r""")
def hamming_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hamming_rescored(table(spark, sf_dir, "embeddings"), all_vector_queries(spark, sf_dir), 10)


@CATALOG.add(f"""WITH {_UNIT}, p AS (SELECT vec_id, unnest(range(4)) AS pos, embedding FROM embeddings),
  t AS (SELECT vec_id, pos, list_transform(embedding[pos * 16 + 1 : pos * 16 + 16], lambda x: x::DOUBLE) AS w FROM p),
  n AS (SELECT vec_id, pos, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS v FROM t),
  m AS (SELECT q.vec_id AS query_id, d.vec_id AS item, q.pos, max({_DOT.format(a='q.v', b='d.v')}) AS best FROM n q, n d WHERE q.vec_id % 100 = 0 GROUP BY ALL),
  s AS (SELECT query_id, item, round(sum(best), 8) AS score FROM m GROUP BY ALL), {top_sql('s', 5, 'r', 'item')} SELECT query_id, item, score, rank FROM r""")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maxsim(spark, sf_dir, "vec_id % 100 = 0")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as four token vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item"), F.posexplode(F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4)))).alias("pos", "vec"))


@CATALOG.add(CATALOG.sql["maxsim"])
def maxsim_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of centroids, all of which are probed."""
    t = _tokens(spark, sf_dir)
    index = I.index_tokens(t.select("item", "vec"), 32)
    return R.top_k(I.late_interaction(index, t.filter("item % 100 = 0").withColumnRenamed("item", "query_id"), 32, None, 5), 5)


@CATALOG.add()
def late_interaction_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a third of the centroids and a tenth of the items as candidates: the recall at 5 of each query."""
    t = _tokens(spark, sf_dir)
    q = t.filter("item % 100 = 0").withColumnRenamed("item", "query_id")
    index = I.index_tokens(t.select("item", "vec"), 64)
    found = R.top_k(I.late_interaction(index, q, 20, max(50, table(spark, sf_dir, "embeddings").count() // 10), 5), 5)
    return D.tie_aware_recall(found, maxsim(spark, sf_dir), 5)


def _maxsim(spark: SparkSession, sf_dir: str, asked: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    cut = e.select("vec_id", F.posexplode(F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4)))).alias("pos", "vec"))
    scored = D.maxsim(cut.select(F.col("vec_id").alias("item"), "vec"), cut.filter(asked).select(F.col("vec_id").alias("query_id"), "pos", "vec"), 5)
    return R.top_k(scored, 5)


@CATALOG.add()
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = table(spark, sf_dir, "embeddings"), all_vector_queries(spark, sf_dir)
    return D.tie_aware_recall(D.graph_top_k(e, q, 10), D.exact_top_k(e, q, 10), 10)


@CATALOG.add()
def routed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a routed index that is written first: the mean recall at 10 for each beam (0: the cells scanned), and the
    share of the shards that a query looks into, over all vectors whose id is divisible by 100."""
    e, q = table(spark, sf_dir, "embeddings"), all_vector_queries(spark, sf_dir)
    place = fresh_folder(spark, "routed")
    G.write_routed(e, place, cell_rows=64)
    index, truth = G.read_routed(spark, place), fresh_folder(spark, "exact")
    # the exact search is of all pairs: once for all beams
    D.exact_top_k(e, q, 10).write.parquet(truth)
    exact = spark.read.parquet(truth)
    share = G.shards_read(index, q).agg(F.round(F.sum("read") / F.sum("shards"), 6).alias("share")).select(F.col("share")).scalar()
    out = None
    for ef in (10, 20, 40, 80, 160, 0):
        part = D.tie_aware_recall(G.routed_top_k(index, q, 10, ef or None), exact, 10).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(ef).alias("ef"), "recall")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("shards_read", share)


@CATALOG.add()
def halfvec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.to_half("embedding").alias("embedding"))
    q = all_vector_queries(spark, sf_dir).select("query_id", V.to_half("embedding").alias("embedding"))
    return D.exact_top_k(e, q, 10)


@CATALOG.add(f"""WITH {TF_SQL}, {QT_SQL}, q2 AS (SELECT query_id, 0 AS part, term, qtf FROM qt UNION ALL SELECT query_id, 1, term, qtf FROM qt WHERE length(term) > 4),
  s AS (SELECT query_id, part, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qtf), 8) AS score FROM q2 JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, doc_id) AS rank FROM s),
  f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS score, max(score) AS best FROM r WHERE rank <= 20 GROUP BY ALL), {top_sql('f', 10, 'o')} SELECT query_id, doc_id AS item, score AS rrf, best, rank FROM o""")
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, terms = docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir))
    lists = None
    for own in (terms, terms.filter(F.char_length("term") > 4)):
        part = L.bm25_top_k(d, own, 20)
        lists = part if lists is None else lists.unionByName(part)
    best = R.best_of(lists).withColumnRenamed("score", "best")
    return R.top_k(R.rrf(lists).join(best, ["query_id", "item"]), 10, score="rrf")


@CATALOG.add("""WITH p AS (SELECT page_id % 10 AS query_id, page_id AS item, row_number() OVER (PARTITION BY page_id % 10 ORDER BY length(html) DESC, page_id) AS rank FROM pages),
  t AS (SELECT doc_id % 10 AS query_id, doc_id AS item, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  e AS (SELECT * FROM p WHERE rank <= 30 UNION ALL SELECT * FROM t WHERE rank <= 30) SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf FROM e GROUP BY ALL""")
def modality_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("item"), F.char_length("html").cast("double").alias("score"))
    t = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("item"), F.col("n_chars").cast("double").alias("score"))
    return R.rrf(R.top_k(p, 30).unionByName(R.top_k(t, 30)))
