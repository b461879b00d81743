"""Ranking quality and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QRELS_SQL, QT_SQL, TF_SQL, Catalog, bm25_sql, docs, table, text_queries, top_sql
from harrier.operators import evaluate as M
from harrier.operators import lexical as L
from harrier.operators.scoring import draws
from harrier.operators import ranking as R

CATALOG = Catalog()


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage. A passage's first token and length lead to few
    candidates, so passages and documents aren't compared in all pairs: they meet on
    a rare token of the passage."""
    from harrier.functions import text as T

    d = docs(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    inner = F.slice(T.tokens("passage"), 2, F.greatest(F.size(T.tokens("passage")) - 2, F.lit(1)))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t"))))["t"]
    keyed = b.withColumn("key", longest)
    spread = L.exploded(d.select("doc_id", T.tokens("text").alias("tokens"))).withColumnRenamed("term", "key")
    holders = spread.join(R.small(keyed.select("key").distinct(), L.BROADCAST_TERMS), "key", "left_semi").distinct()
    found = holders.join(keyed, "key").join(d.select("doc_id", "text"), "doc_id").filter(F.col("text").contains(F.col("passage")))
    return found.select("query_id", F.col("doc_id").alias("item"), F.lit(1).alias("grade"))


_RUN = f"{TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 50, 'r')}, {QRELS_SQL}"
_SCORES = """nr AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id),
  s AS (SELECT q.query_id,
      coalesce(round((SELECT count(*) FROM r JOIN qrels USING (query_id, doc_id) WHERE r.query_id = q.query_id AND rank <= 10) / n_rel, 8), 0) AS recall,
      coalesce(round(1.0::DOUBLE / (SELECT min(rank) FROM r JOIN qrels USING (query_id, doc_id) WHERE r.query_id = q.query_id AND rank <= 10), 8), 0) AS mrr,
      coalesce(round((SELECT sum(1 / log2(rank + 1)) FROM r JOIN qrels USING (query_id, doc_id) WHERE r.query_id = q.query_id AND rank <= 10)
        / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n_rel), 8), 0) AS ndcg
    FROM q LEFT JOIN nr USING (query_id))"""


def _hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), k)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics(_hits(spark, sf_dir), qrels(spark, sf_dir), text_queries(spark, sf_dir))


@CATALOG.add(f"WITH {_RUN}, {_SCORES} SELECT query_id, recall, mrr, ndcg FROM s")
def bm25_retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@CATALOG.add(f"WITH {_RUN}, {_SCORES}, c AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category, * FROM s) SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM c GROUP BY GROUPING SETS ((), (category))")
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.means(_scores(spark, sf_dir).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")))


@CATALOG.add(f"""WITH {_RUN}, g AS (SELECT query_id, doc_id, 1 + doc_id % 3 AS grade FROM qrels),
  i AS (SELECT query_id, sum(grade / log2(a + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS a FROM g) WHERE a <= 10 GROUP BY query_id),
  x AS (SELECT query_id, sum(grade / log2(rank + 1)) AS dcg FROM r JOIN g USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id)
  SELECT query_id, coalesce(round(dcg / ideal, 8), 0) AS ndcg FROM q LEFT JOIN i USING (query_id) LEFT JOIN x USING (query_id)""")
def graded_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = qrels(spark, sf_dir).withColumn("grade", 1 + F.col("item") % 3)
    return M.graded_ndcg(_hits(spark, sf_dir), graded, text_queries(spark, sf_dir))


@CATALOG.add(f"WITH {_RUN} SELECT query_id, count(DISTINCT doc_id) AS unique_items, round(least(10, count(DISTINCT doc_id)) / (SELECT count(*)::DOUBLE FROM docs), 8) AS baseline FROM r GROUP BY query_id")
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = docs(spark, sf_dir).agg(F.count("*")).scalar()
    return M.random_baseline(_hits(spark, sf_dir), n)


@CATALOG.add(f"""WITH {_RUN}, h AS (SELECT query_id, doc_id, rank, source AS path FROM r JOIN docs USING (doc_id)),
  f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, path ORDER BY rank) = 1 THEN 1 ELSE 0 END AS fresh FROM h),
  c AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
  SELECT query_id, doc_id AS item, rank, path FROM c WHERE before < 3""")
def file_depth_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("source").alias("path")), "item")
    return R.file_depth_cut(hits.select("query_id", "item", "rank", "path"), 3)


@CATALOG.add(f"WITH {_RUN}, h AS (SELECT query_id, rank, source AS path FROM r JOIN docs USING (doc_id)), f AS (SELECT query_id, path, min(rank) AS first FROM h GROUP BY ALL) SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY first, path) AS rank FROM f")
def paths_from_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("source").alias("path")), "item")
    return R.first_hits_by_path(hits)


@CATALOG.add("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 2 AS part FROM documents")
def split_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_alternate(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@CATALOG.add("SELECT event_type AS stage, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latencies(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@CATALOG.add("WITH o AS (SELECT event_type AS stage, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT stage, v[CAST(round_even(0.9::DOUBLE * (len(v) - 1), 0) AS BIGINT) + 1] AS value FROM o")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_rank(table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("stage"), "value"), 90)


_DRAWN = """k AS (SELECT count(*) AS n FROM v), p AS (SELECT x, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM v),
  dr AS (SELECT id // n AS b, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12))::BIGINT % n AS idx FROM (SELECT n, unnest(range(2000 * n)) AS id FROM k)),
  m AS (SELECT b, avg(x) AS m FROM dr JOIN p USING (idx) GROUP BY b) SELECT (SELECT round(avg(x), 8) FROM v) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m"""


@CATALOG.add(f"WITH v AS (SELECT query_id, ndcg AS x FROM ({CATALOG.sql['bm25_retrieval_quality']})), {_DRAWN}")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the mean nDCG, over draws that any engine can make."""
    scores = _scores(spark, sf_dir)
    w = Window.orderBy("query_id")  # one row for each query
    placed = scores.select((F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("ndcg").alias("value"))
    return M.interval(placed, draws(spark, text_queries(spark, sf_dir).count()))


@CATALOG.add(f"WITH v AS (SELECT query_id, a.ndcg - b.ndcg AS x FROM ({CATALOG.sql['bm25_retrieval_quality']}) a JOIN ({CATALOG.sql['bm25_retrieval_quality'].replace(bm25_sql(), bm25_sql('0.9', '0.4'))}) b USING (query_id)), {_DRAWN}")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = L.query_terms(text_queries(spark, sf_dir))
    judged, q = qrels(spark, sf_dir), text_queries(spark, sf_dir)
    runs = [M.metrics(L.bm25_top_k(docs(spark, sf_dir), terms, 50, k1, b), judged, q).select("query_id", F.col("ndcg").alias("value")) for k1, b in ((1.5, 0.75), (0.9, 0.4))]
    return M.paired_interval(*runs, draws(spark, q.count()))


_KAPPA = "l AS (SELECT CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS a, quality AS b FROM labels JOIN documents USING (doc_id))"


@CATALOG.add(f"""WITH {_KAPPA}, n AS (SELECT count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) / count(*)::DOUBLE AS po FROM l),
  e AS (SELECT sum(ca * cb) / (SELECT n * n FROM n)::DOUBLE AS pe FROM (SELECT a, count(*) AS ca FROM l GROUP BY a) x JOIN (SELECT b, count(*) AS cb FROM l GROUP BY b) y ON a = b)
  SELECT n, round(po, 8) AS agreement, round(pe, 8) AS expected, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 8) AS kappa FROM n, e""")
def cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.kappa(rows.select(F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("a"), F.col("quality").alias("b")), "a", "b")


@CATALOG.add(f"""WITH votes AS (SELECT 'user ' || user_id AS question, event_type AS label FROM events), c AS (SELECT question, label, count(*) AS c FROM votes GROUP BY ALL),
  t AS (SELECT question, label, c, max(c) OVER (PARTITION BY question) AS m FROM c) SELECT question, CASE WHEN count(*) > 1 THEN 'partial' ELSE min(label) END AS label FROM t WHERE c = m GROUP BY question""")
def jury_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as votes."""
    e = table(spark, sf_dir, "events")
    return M.jury_vote(e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question"), F.col("event_type").alias("label")))


@CATALOG.add("""WITH v AS (SELECT unnest(['correct', 'partial', 'wrong']) AS x), l AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' ELSE 'wrong' END AS t, CASE WHEN n_chars > 2000 THEN 'correct' WHEN n_chars > 500 THEN 'partial' ELSE 'wrong' END AS s FROM labels JOIN documents USING (doc_id))
  SELECT a.x AS truth, b.x AS said, count(t) AS n FROM v a CROSS JOIN v b LEFT JOIN l ON t = a.x AND s = b.x GROUP BY ALL""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    truth = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").otherwise("wrong")
    said = F.when(F.col("n_chars") > 2000, "correct").when(F.col("n_chars") > 500, "partial").otherwise("wrong")
    return M.confusion(rows.select(truth.alias("t"), said.alias("s")), "t", "s", ["correct", "partial", "wrong"])


#: Of the even events the mean and the largest value of each type, of the odd ones the mean and the least.
_HALVES = {name: "SELECT event_type AS config, '{m}' AS metric, round({f}, 3) AS value FROM events WHERE event_id % 2 = {half} GROUP BY event_type UNION ALL SELECT event_type, 'mean', round(avg(value) / 50, 3) FROM events WHERE event_id % 2 = {half} GROUP BY event_type".format(m=m, f=f, half=half) for name, m, f, half in (("b", "max", "max(value)", 0), ("a", "min", "min(value)", 1))}


@CATALOG.add(f"""WITH b AS ({_HALVES['b']}), a AS ({_HALVES['a']})
  SELECT coalesce(b.config, a.config) AS config, coalesce(b.metric, a.metric) AS metric, b.value AS before, a.value AS after,
  CASE WHEN b.value IS NULL THEN 'new' WHEN a.value IS NULL THEN 'missing' WHEN round(a.value - b.value, 10) < -0.002 THEN 'regression' WHEN round(a.value - b.value, 10) > 0.002 THEN 'improvement' ELSE 'same' END AS verdict
  FROM b FULL OUTER JOIN a ON a.config = b.config AND a.metric = b.metric""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")

    def half(n: int, name: str, other) -> DataFrame:
        own = e.filter(F.col("event_id") % 2 == n).groupBy(F.col("event_type").alias("config")).agg(F.round(other("value"), 3).alias(name), F.round(F.avg("value") / 50, 3).alias("mean"))
        return own.unpivot("config", [name, "mean"], "metric", "value")

    return M.gate(half(0, "max", F.max), half(1, "min", F.min))


@CATALOG.add(f"""WITH {DOCS_SQL}, b AS (SELECT doc_id AS id, text AS context, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), 3, 9), ' ') AS answer, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), 1, 5), ' ') AS question, lang FROM docs),
  t AS (SELECT id, list_distinct(list_transform(regexp_extract_all(answer, '[A-Za-z0-9_./-]+'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z0-9_./-]+'), lambda x: lower(x))) AS q, list_distinct(list_transform(regexp_extract_all(context, '[A-Za-z0-9_./-]+'), lambda x: lower(x))) AS c FROM b)
  SELECT id, CASE WHEN len(a) = 0 OR len(c) = 0 THEN 0 ELSE round(len(list_intersect(a, c)) / len(a)::DOUBLE, 6) END AS faithfulness, CASE WHEN len(a) = 0 OR len(q) = 0 THEN 0 ELSE round(len(list_intersect(a, q)) / len(a)::DOUBLE, 6) END AS answer_relevancy, round(1 / 3.0::DOUBLE, 6) AS context_precision, 0.5::DOUBLE AS context_recall FROM t""")
def rag_overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(docs(spark, sf_dir))


def _overlaps(d: DataFrame) -> DataFrame:
    cut = F.regexp_extract_all("text", F.lit("[A-Za-z0-9_./-]+"), F.lit(0))
    rows = d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("context"), F.array_join(F.slice(cut, 3, 7), " ").alias("answer"), F.array_join(F.slice(cut, 1, 5), " ").alias("question"),
        F.array(*map(F.lit, ("a", "b", "c"))).alias("retrieved"), F.array(*map(F.lit, ("b", "x"))).alias("relevant"),
    )
    return M.overlap_metrics(rows)
