"""Smaller operators: projections and cuts of hits, comparisons of runs, files put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, TF_SQL, TOKENS_SQL, Catalog, bm25_sql, docs, table, text_queries, top_sql
from harrier.catalog.evaluation import qrels
from harrier.functions import embedders as E
from harrier.operators import chunking as C
from harrier.operators import evaluate as M
from harrier.operators import learning as RL
from harrier.operators import lexical as L
from harrier.operators import ranking as R
from harrier.operators import rerank as K
from harrier.operators import understand as U
from harrier.sources import corpus as S
from harrier.streaming import cache

CATALOG = Catalog()

_ENDING = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.yaml' ELSE '.out' END"
_H = f"{TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 5, 'r')}, h AS (SELECT query_id, doc_id || {_ENDING} AS path, rank, score FROM r)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each text query, as files of four kinds."""
    found = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), 5).withColumnRenamed("item", "doc_id")
    return found.select("query_id", F.expr(f"doc_id || {_ENDING}").alias("path"), "rank", "score")


@CATALOG.add(f"WITH {_H} SELECT * FROM h WHERE rank <= 2 AND path LIKE '%.py'")
def filetype_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.of_type(_hits(spark, sf_dir), [".py"], 2)


@CATALOG.add(f"WITH {_H}, x AS (SELECT query_id, CASE WHEN path LIKE '%.md' THEN query_id || '' ELSE path END AS item, rank FROM h) SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS rank FROM x WHERE item <> CAST(query_id AS VARCHAR)")
def ignore_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hits(spark, sf_dir).select("query_id", F.when(F.col("path").endswith(".md"), F.col("query_id").cast("string")).otherwise(F.col("path")).alias("item"), "rank")
    return R.without_self(rows)


@CATALOG.add(f"WITH {_H}, o AS (SELECT query_id, path, 1 AS r FROM h WHERE rank = 3), s AS (SELECT h.*, round(1.0::DOUBLE / (60 + rank) + coalesce(1.0::DOUBLE / (60 + r), 0), 10) AS s FROM h LEFT JOIN o USING (query_id, path)) SELECT query_id, path AS item, rank, s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS BIGINT) AS new_rank FROM s")
def community_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    other = hits.filter("rank = 3").select("query_id", F.col("path").alias("item"), F.lit(1).alias("rank"))
    return R.boosted_by_rank(hits.select("query_id", F.col("path").alias("item"), "rank"), other)


@CATALOG.add(f"WITH {DOCS_SQL} SELECT path, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || ' ...' ELSE text END AS text FROM docs")
def shown_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shown(docs(spark, sf_dir).select("path", "text"), 200)


@CATALOG.add(f"WITH {DOCS_SQL} SELECT path, sha256(text) AS sha FROM docs WHERE regexp_matches(text, '\\S')")
def rebuilt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(docs(spark, sf_dir))


def _rebuilt(d: DataFrame) -> DataFrame:
    return S.rebuilt(C.with_bytes(C.fixed_chunks(d), d)).select("path", F.sha2("text", 256).alias("sha"))


@CATALOG.add(f"WITH {DOCS_SQL}, s AS (SELECT path, unnest(range(0, CAST(ceil(greatest(length(text) - 512, 0) / 462.0::DOUBLE) AS BIGINT) + 1)) * 462 AS a, text FROM docs WHERE path = 'src3/3.txt') SELECT path, strlen(substr(text, 1, a)) AS start_byte, strlen(substr(text, 1, least(a + 512, length(text)))) AS end_byte FROM s")
def chunks_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).filter("path = 'src3/3.txt'")
    return S.chunks_of_path(C.with_bytes(C.fixed_chunks(d), d), "src3/3.txt").select("path", "start_byte", "end_byte")


@CATALOG.add("SELECT event_id, k AS field, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scalar_fields(table(spark, sf_dir, "events"), "props", "event_id")


@CATALOG.add("SELECT event_type AS phase, count(*) AS n, count(*) FILTER (value > 5) AS ok, round(1 - count(*) FILTER (value > 5) / count(*)::DOUBLE, 6) AS error_rate, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return M.load_summary(e.select(F.col("event_type").alias("phase"), F.coalesce(F.col("value") > 5, F.lit(False)).alias("success"), F.col("user_id").alias("user"), F.col("value").alias("ms")))


def _runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    terms = L.query_terms(text_queries(spark, sf_dir))
    return [L.bm25_top_k(docs(spark, sf_dir), terms, 10, k1, b) for k1, b in ((1.5, 0.75), (0.4, 0.0))]


_TWO = f"{TF_SQL}, {QT_SQL}, {bm25_sql('1.5', '0.75', 'b0')}, {bm25_sql('0.4', '0.0', 'b1')}, {top_sql('b0', 10, 'r0')}, {top_sql('b1', 10, 'r1')}"


@CATALOG.add(f"""WITH {_TWO}, rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN docs ON contains(docs.text, benchmark.text)), a AS (SELECT query_id, doc_id FROM r0 JOIN rel USING (query_id, doc_id) WHERE rank <= 1), b AS (SELECT query_id, doc_id FROM r1 JOIN rel USING (query_id, doc_id) WHERE rank <= 1)
  SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (b.doc_id IS NULL) AS dropped, count(*) FILTER (a.doc_id IS NULL) AS gained FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY ALL""")
def relevant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.list_changes(*_runs(spark, sf_dir), qrels(spark, sf_dir), 1)


@CATALOG.add(f"WITH {_TWO}, x AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM r0 GROUP BY query_id), y AS (SELECT query_id, list(doc_id ORDER BY rank) AS l FROM r1 GROUP BY query_id) SELECT query_id, x.l IS DISTINCT FROM y.l AS changed FROM x FULL OUTER JOIN y USING (query_id)")
def changed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.changed_lists(*_runs(spark, sf_dir))


@CATALOG.add("WITH p AS (SELECT user_id % 3 AS route, event_id AS query_id, value FROM events WHERE value IS NOT NULL) SELECT route, count(*) AS n, round(avg(round(value) - value), 6) AS delta, count(*) FILTER (round(value) - value > 0) AS better, count(*) FILTER (round(value) - value < 0) AS worse FROM p GROUP BY route")
def paired_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_id").alias("query_id"), (F.col("user_id") % 3).alias("route"), "value")
    return M.paired_by_route(a, a.withColumn("value", F.round("value")))


@CATALOG.add(f"""WITH {_H}, hq AS (SELECT query_id, q.text AS query, path, rank FROM h JOIN q USING (query_id)), t AS (SELECT query_id, query, rank, unnest({TOKENS_SQL.format(x='path')}) AS t, unnest(range(len({TOKENS_SQL.format(x='path')}))) AS pos FROM hq WHERE rank <= 3),
  f AS (SELECT query_id, t, min(rank * 100 + pos) AS r FROM t WHERE length(t) > 2 AND NOT list_contains({TOKENS_SQL.format(x='query')}, t) GROUP BY ALL),
  g AS (SELECT query_id, array_to_string(list(t ORDER BY r)[1:6], ' ') AS s FROM f GROUP BY query_id) SELECT DISTINCT hq.query_id, CASE WHEN s IS NULL THEN query || ' details' ELSE query || ' ' || s END AS rewritten FROM hq LEFT JOIN g USING (query_id)""")
def path_token_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_path_tokens(_hits(spark, sf_dir).join(text_queries(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").select("query_id", "query", "path", "rank"))


@CATALOG.add("SELECT event_id AS id, round(1 / (1 + exp(-(coalesce(value, 0) - 5))), 8) AS p FROM events")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(K.sigmoid(F.coalesce("value", F.lit(0.0)) - 5), 8).alias("p"))


_ROLL = "event_id AS id, CAST(event_id % 2 AS DOUBLE) AS exact, CAST(event_id % 5 AS DOUBLE) / 4 AS ndcg, CAST(user_id % 3 AS DOUBLE) / 2 AS jury, user_id % 4 AS n_search, CAST(event_id % 3 AS DOUBLE) / 2 AS uncited"


@CATALOG.add(f"WITH r AS (SELECT {_ROLL} FROM events) SELECT *, round(exact + 0.5::DOUBLE * ndcg + 0.3::DOUBLE * jury - 0.1::DOUBLE * n_search - uncited, 8) + 0::DOUBLE AS reward FROM r")
def search_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.rewards(table(spark, sf_dir, "events").selectExpr(*_ROLL.split(", ")))


@CATALOG.add()
def hyde_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text_queries(spark, sf_dir)
    both = q.select("query_id", E.hash_vectors("text").alias("q"), E.hash_vectors(U.hypothesis(F.col("text"))).alias("h"))
    return both.select("query_id", E.mean_unit([F.col("h"), F.col("q")]).alias("embedding"))


@CATALOG.add()
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("question_id"), (F.col("vec_id") % 4).alias("shard"), F.col("vec_id").cast("double").alias("at"), F.col("embedding").alias("vector"))
    again = asked.withColumns({"question_id": F.col("question_id") + 1_000_000, "at": F.col("at") + 40.0})
    served = cache.replay(asked.unionByName(again))
    return served.groupBy("shard").agg(F.count("*").alias("asked"), F.count("served_by").alias("hits"), F.round(F.count("served_by") / F.count("*"), 6).alias("hit_rate"))


@CATALOG.add()
def cache_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes near every third vector, against the caches that all vectors fill."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.select(F.col("vec_id").alias("question_id"), (F.col("vec_id") % 4).alias("shard"), F.col("vec_id").cast("double").alias("at"), F.col("embedding").alias("vector"))
    near = asked.filter("question_id % 3 = 0").select((F.col("question_id") + 1_000_000).alias("question_id"), "shard", (F.col("at") + 100.0).alias("at"), F.transform("vector", lambda x: F.round(x, 2)).alias("vector"))
    found = cache.probed(asked, near)
    return cache.probe_counts(found, near.select("question_id", (F.col("question_id") - 1_000_000).alias("source_id")))
