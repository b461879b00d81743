"""Embedders, judges, probes and the whole engine."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QUESTION, TOKENS_SQL, Catalog, docs, made, made_sql, table, text_queries
from harrier.catalog.evaluation import qrels
from harrier.functions import embedders as E
from harrier.functions import text as T
from harrier.operators import evaluate as M
from harrier.operators import probes as B
from harrier.operators import singular
from harrier.plans.engine import Config, Engine

CATALOG = Catalog()


@CATALOG.add()
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", E.hash_vectors("text").alias("embedding"))


@CATALOG.add()
def sql_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sql_hash_vectors(docs(spark, sf_dir), "doc_id")


@CATALOG.add()
def tfidf_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = E.tfidf(docs(spark, sf_dir))
    return model.transform(rows).select("doc_id", F.size(F.filter(vector_to_array("features"), lambda x: x > 0)).alias("n_features"))


@CATALOG.add()
def tfidf_svd_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF on 64 singular axes."""
    vectors = singular.embedded(docs(spark, sf_dir), "doc_id", features=1024, dim=64)
    return vectors.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "path", "text", F.lit(1.0).alias("mtime")))


@CATALOG.add()
def engine_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).retrieve(text_queries(spark, sf_dir)).drop("text")


@CATALOG.add()
def engine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, q = _engine(spark, sf_dir), text_queries(spark, sf_dir)
    return engine.evaluate(engine.retrieve(q, Config(k=10)), qrels(spark, sf_dir), q)


@CATALOG.add(f"""WITH g AS (SELECT doc_id AS id, lang AS category, 'question ' || doc_id AS question FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM g),
  p AS (SELECT DISTINCT category, CAST(round_even(k * (n - 1) / (least(4, n) - 1)::DOUBLE, 0) AS BIGINT) AS i FROM n, range(4) t(k) WHERE k < least(4, n)) SELECT id, category, question FROM n JOIN p USING (category, i)""")
def evenly_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return B.evenly_sampled(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("question")), "category", "id", 4)


_STOP = ", ".join(f"'{w}'" for w in B.WEAK)


@CATALOG.add(f"""WITH {made_sql(QUESTION, 20, columns="doc_id AS id, {x} AS question")}, w AS (SELECT *, list_filter(list_transform(string_split(replace(replace(lower(question), 'how many', 'number of'), 'what''s', 'what is'), ' '), lambda x: trim(x, '?,.:')), lambda x: x <> '' AND x NOT IN ({_STOP})) AS w FROM q)
  SELECT id, array_to_string(w, ' ') AS keywords, CASE WHEN split_part(lower(question), ' ', 1) IN ('open', 'find', 'show', 'read', 'locate', 'explain', 'compare', 'list', 'get') THEN 'can you ' || question || '?' ELSE 'can you tell me ' || question || '?' END AS ask, 'quick question: ' || question AS prefix FROM w""")
def paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.paraphrases(made(spark, sf_dir, QUESTION, 20).select(F.col("doc_id").alias("id"), F.col("text").alias("question")))


@CATALOG.add(f"""WITH {DOCS_SQL}, b AS (SELECT doc_id AS id, {TOKENS_SQL.format(x="substr(text, 1, 60)")} AS q, {TOKENS_SQL.format(x="substr(text, 30, 120)")} AS a, {TOKENS_SQL.format(x="text")} AS c, {TOKENS_SQL.format(x="substr(text, 90, 60)")} AS g FROM docs),
  d AS (SELECT id, list_distinct(q) AS q, list_distinct(a) AS a, list_distinct(c) AS c, list_distinct(g) AS g FROM b),
  s AS (SELECT id, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a)::DOUBLE ELSE 0 END AS faithfulness, CASE WHEN len(q) > 0 THEN len(list_intersect(a, q)) / len(q)::DOUBLE ELSE 0 END AS relevancy, CASE WHEN len(g) > 0 THEN len(list_intersect(g, a)) / len(g)::DOUBLE END AS gr FROM d),
  t AS (SELECT *, coalesce(gr, faithfulness) AS groundedness FROM s), u AS (SELECT *, round(0.5::DOUBLE * groundedness + 0.3::DOUBLE * faithfulness + 0.2::DOUBLE * relevancy, 10) AS x FROM t)
  SELECT id, round(faithfulness, 6) AS faithfulness, round(relevancy, 6) AS relevancy, round(groundedness, 6) AS groundedness, CASE WHEN x >= 0.75 THEN 'correct' WHEN x >= 0.35 THEN 'partial' ELSE 'wrong' END AS label FROM u""")
def heuristic_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(docs(spark, sf_dir))


def _judged(d: DataFrame) -> DataFrame:
    rows = d.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("question"), F.substring("text", 30, 120).alias("answer"), F.col("text").alias("context"), F.substring("text", 90, 60).alias("gold"))
    return B.judged(rows)


_REPLY = """CASE k WHEN 0 THEN '{"score": 0.' || (doc_id % 7) || ', "label": "wrong"}' WHEN 1 THEN 'SCORE: ' || (doc_id % 13) WHEN 2 THEN 'wrong, by ' || w1 WHEN 3 THEN 'it is correct' WHEN 4 THEN 'yes, ' || w1 WHEN 5 THEN ''
  WHEN 6 THEN '{"label": "partial"}' WHEN 7 THEN 'faithfulness = 0.' || doc_id WHEN 8 THEN NULL WHEN 9 THEN '{"groundedness": "0.' || (doc_id % 5) || '"}' WHEN 10 THEN 'unfaithful' ELSE w1 || ' ' || w2 END"""


@CATALOG.add(rf"""WITH {made_sql(_REPLY, 12, columns="doc_id AS id, trim(coalesce({x}, '')) AS t")}, j AS (SELECT *, CASE WHEN json_valid(t) THEN t END AS j FROM q),
  p AS (SELECT id, try_cast(coalesce(j ->> '$.score', j ->> '$.faithfulness', j ->> '$.relevancy', j ->> '$.groundedness') AS DOUBLE) AS number, try_cast(nullif(regexp_extract(t, '(?i)(?:score|faithfulness|relevancy)\s*[:=]\s*([0-9.]+)', 1), '') AS DOUBLE) AS written, lower(coalesce(j ->> '$.label', t)) AS named FROM j)
  SELECT id, coalesce(CASE WHEN number IS NOT NULL THEN least(greatest(number, 0), 1) END, CASE WHEN written <= 1 THEN written WHEN written > 1 THEN least(written / 10, 1) END, CASE WHEN regexp_matches(named, '\bcorrect\b') THEN 1 WHEN regexp_matches(named, '\bpartial\b') THEN 0.5 WHEN regexp_matches(named, '\bwrong\b') THEN 0
    WHEN contains(named, 'yes') OR contains(named, 'faithful') THEN 1 WHEN contains(named, 'no') OR contains(named, 'unfaith') THEN 0 ELSE 0.5 END)::DOUBLE AS score FROM p""")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of twelve kinds, one for each document."""
    return B.scores(made(spark, sf_dir, _REPLY, 12).select(F.col("doc_id").alias("id"), F.col("text").alias("reply")))


@CATALOG.add(f"""WITH p AS (SELECT event_id AS id, ['A', 'B', 'tie'][event_id % 3 + 1] AS first_order, ['A', 'B', 'tie'][user_id % 3 + 1] AS second_order FROM events), s AS (SELECT CASE first_order WHEN 'A' THEN 1 WHEN 'B' THEN 0 ELSE 0.5 END::DOUBLE AS x, CASE second_order WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 0.5 END::DOUBLE AS y FROM p) SELECT count(*) AS n, round(avg((x + y) / 2), 6) AS p_a, round(abs(avg(x) - avg(y)), 6) AS position_gap FROM s""")
def pairwise_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("A", "B", "tie")))
    e = table(spark, sf_dir, "events")
    return B.pairwise(e.select(F.col("event_id").alias("id"), F.get(said, (F.col("event_id") % 3).cast("int")).alias("first_order"), F.get(said, (F.col("user_id") % 3).cast("int")).alias("second_order")))


@CATALOG.add("""WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang, length(html) AS n FROM pages) SELECT lang, host, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM p GROUP BY ROLLUP (lang, host)""")
def page_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), F.char_length("html").cast("long").alias("n"))
    return p.rollup("lang", "host").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_chars"))


@CATALOG.add("""WITH m AS (SELECT user_id AS item, event_id % 3 AS list_no, event_id AS rank, event_type AS k, 'event ' || event_id AS v FROM events), f AS (SELECT item, k, arg_min(v, list_no * 1000000000 + rank) AS v FROM m GROUP BY item, k)
  SELECT item, list_sort(list(k || '=' || v)) AS entries FROM f GROUP BY item""")
def metadata_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in three lists, each with one entry."""
    e = table(spark, sf_dir, "events")
    entry = F.create_map(F.col("event_type"), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    rows = e.select(F.col("user_id").alias("item"), (F.col("event_id") % 3).alias("list_no"), F.col("event_id").alias("rank"), entry.alias("metadata"))
    return M.metadata_union(rows).select("item", F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("entries"))


@CATALOG.add(f"WITH {DOCS_SQL}, s AS (SELECT query_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT doc_id % 7 AS query_id, doc_id FROM docs)), x AS (SELECT query_id, list(item ORDER BY rank) FILTER (rank <= 10) AS top FROM s GROUP BY query_id) SELECT query_id, top FROM x")
def top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_lists(docs(spark, sf_dir))


def _top_lists(d: DataFrame) -> DataFrame:
    rows = d.select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("item"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("item")))
    return M.top_lists(ranked, 10)


@CATALOG.add(f"WITH {DOCS_SQL}, t AS (SELECT doc_id, list_distinct({TOKENS_SQL.format(x='text')}) AS a FROM docs), n AS (SELECT t.doc_id, t.a, coalesce(o.a, []) AS b FROM t LEFT JOIN t o ON o.doc_id = t.doc_id + 1) SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 8) AS jaccard FROM n")
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text with that of the next id."""
    d = docs(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return d.join(after, "doc_id", "left").select("doc_id", F.round(T.jaccard(T.tokens("text"), T.tokens("next")), 8).alias("jaccard"))
