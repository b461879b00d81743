"""Reranking, evidence, spreadsheets, and learning on search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, TF_SQL, TOKENS_SQL, Catalog, bm25_sql, docs, made, made_sql, table, text_queries, top_sql, values
from harrier.operators import evidence as X
from harrier.operators import learning as RL
from harrier.operators import lexical as L
from harrier.operators import ranking as R
from harrier.operators import rerank as K
from harrier.operators import tabular as P

CATALOG = Catalog()

_PAIRS = f"""{TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 20, 'r')},
  p AS (SELECT r.query_id, r.doc_id AS item, q.text AS query, path, docs.text, 1.0::DOUBLE / (60 + rank) AS rrf, rank, score, {TOKENS_SQL.format(x="q.text")} AS qt, list_distinct({TOKENS_SQL.format(x="docs.text")}) AS dt FROM r JOIN q USING (query_id) JOIN docs ON docs.doc_id = r.doc_id),
  j AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_filter(qt, lambda t: list_contains(dt, t))) / len(qt)::DOUBLE END AS exact, CASE WHEN len(qt) = 0 OR len(dt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(list_distinct(list_concat(qt, dt)))::DOUBLE END AS jac FROM p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text_queries(spark, sf_dir)
    hits = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(q), 20)
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("item"), "path", "text")
    return hits.join(q.withColumnRenamed("text", "query"), "query_id").join(d, "item").withColumn("rrf", 1 / (60 + F.col("rank")))


@CATALOG.add(f"WITH {_PAIRS} SELECT query_id, item, round(exact + jac + 0.05::DOUBLE * rrf, 10) AS score FROM j")
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.overlap_scores(_pairs(spark, sf_dir)).select("query_id", "item", "score")


@CATALOG.add(f"WITH {_PAIRS}, o AS (SELECT query_id, item, rank, CASE WHEN rank <= 5 THEN round(exact + jac + 0.05::DOUBLE * rrf, 10) END AS rerank FROM j) SELECT query_id, item, CASE WHEN rank <= 5 THEN CAST(row_number() OVER (PARTITION BY query_id, rank <= 5 ORDER BY rerank DESC, rank) AS BIGINT) ELSE rank END AS rank FROM o")
def rerank_depth_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return R.rerank_head(pairs.select("query_id", "item", "rank"), K.overlap_scores(pairs).select("query_id", "item", "score"), 5).select("query_id", "item", "rank")


@CATALOG.add(f"WITH {_PAIRS}, m AS (SELECT *, max(item::DOUBLE) OVER (PARTITION BY query_id) AS latest FROM j) SELECT query_id, item, 0.0::DOUBLE AS dense_cosine, score AS bm25_score, rrf AS rrf_score, rank::DOUBLE AS rrf_rank, round(jac, 10) AS jaccard, round(exact, 10) AS exact_overlap, 2.0::DOUBLE AS path_depth, CASE WHEN latest > 0 AND item <> 0 THEN round(item / latest, 10) ELSE 0 END AS recency, 0.0::DOUBLE AS is_yaml, 0.0::DOUBLE AS is_log, 0.0::DOUBLE AS is_code, 0.0::DOUBLE AS is_csv, 1.0::DOUBLE AS is_md FROM m")
def features13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"mtime": F.col("item").cast("double"), "dense": F.lit(None).cast("double"), "bm25": F.col("score")})
    return K.features(rows)


@CATALOG.add()
def student_lstsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"mtime": F.col("item").cast("double"), "dense": F.lit(0.0), "bm25": F.col("score")})
    examples = K.features(rows).join(K.overlap_scores(_pairs(spark, sf_dir)).select("query_id", "item", F.col("score").alias("teacher")), ["query_id", "item"])
    return K.student_scores(K.fit_student(examples), examples).select("query_id", "item", F.round("score", 4).alias("score"))


_REPLY = """CASE k WHEN 0 THEN '[2] > [1] > [3]' WHEN 1 THEN '' WHEN 2 THEN 'the second, ' || w1 || ', is best' WHEN 3 THEN '[' || (doc_id % 5) || '] > [1]' WHEN 4 THEN '[1] > [1]' WHEN 5 THEN '[2] > [1]' WHEN 6 THEN ' [1] ' ELSE NULL END"""
_REPLY_N = "CAST((doc_id - doc_id % 8) / 8 % 4 AS INT)"


@CATALOG.add(f"""WITH {made_sql(_REPLY, 8, "r", "doc_id AS query_id, {x} AS reply, " + _REPLY_N + " AS n")}, i AS (SELECT *, trim(coalesce(reply, '')) AS t, list_transform(regexp_extract_all(coalesce(reply, ''), '\\[([0-9]+)\\]', 1), lambda x: x::INT - 1) AS ids FROM r),
  s AS (SELECT *, CASE WHEN t = '' THEN 'no_completion' WHEN NOT regexp_matches(t, '^\\[[0-9]+\\](\\s*>\\s*\\[[0-9]+\\])*$') THEN 'not_a_chain' WHEN len(list_filter(ids, lambda x: x < 0 OR x >= n)) > 0 THEN 'out_of_range' WHEN len(list_distinct(ids)) < len(ids) THEN 'repeated_id' WHEN len(ids) < n THEN 'partial' ELSE 'permutation' END AS status FROM i)
  SELECT query_id, CASE WHEN status = 'permutation' THEN ids ELSE list_transform(range(n), lambda x: x::INT) END AS "order", status FROM s""")
def listwise_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.read_permutation(made(spark, sf_dir, _REPLY, 8).select(F.col("doc_id").alias("query_id"), F.col("text").alias("reply"), F.expr(_REPLY_N).alias("n")))


_ANSWER = """CASE k WHEN 0 THEN 'The ' || w1 || ' is 0.055 [' || w2 || '.md:0-' || (doc_id % 40 + 1) || '] and [b.md:3-7] [' || w2 || '.md:0-' || (doc_id % 40 + 1) || '].' WHEN 1 THEN 'NOT IN SOURCES' WHEN 2 THEN 'Plain answer of ' || w1 || ' in configs/x.yaml. It was good!'
  WHEN 3 THEN 'See [' || w2 || '.md:2-3] ' || w1 WHEN 4 THEN w1 || ' [' || w2 || '.md:0-' || (doc_id % 40 + 1) || '] NOT IN SOURCES' ELSE NULL END"""
_SOURCE = "doc_id AS id, w2 || '.md' AS path, CAST(0 AS BIGINT) AS start_byte, doc_id % 40 + 1 AS end_byte"
_ANSWERS_SQL = made_sql(_ANSWER, 6, "a", "doc_id AS id, {x} AS answer")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _ANSWER, 6).select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))


@CATALOG.add(f"""WITH {_ANSWERS_SQL}, c AS (SELECT id, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 1)) AS path, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 2))::BIGINT AS start_byte, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 3))::BIGINT AS end_byte FROM a) SELECT DISTINCT id, path, start_byte, end_byte FROM c""")
def parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.citations(_answers(spark, sf_dir)).drop("pos")


@CATALOG.add(f"""WITH {_ANSWERS_SQL}, h AS (SELECT {_SOURCE} FROM w1s WHERE k <> 2), c AS (SELECT DISTINCT id, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 1)) AS path, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 2))::BIGINT AS x, unnest(regexp_extract_all(answer, '\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', 3))::BIGINT AS y FROM a),
  k AS (SELECT id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.id = c.id AND h.path = c.path AND start_byte = x AND end_byte = y)) AS v, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.id = c.id AND h.path = c.path)) AS p FROM c GROUP BY id)
  SELECT id, coalesce(v, 0) AS valid, coalesce(n - v, 0) AS unknown, coalesce(p = n, false) AS paths_retrieved, contains(coalesce(answer, ''), 'NOT IN SOURCES') AS abstained, coalesce(v, 0) = 0 AND NOT contains(coalesce(answer, ''), 'NOT IN SOURCES') AS uncited,
    trim(regexp_replace(coalesce(answer, ''), '\\s*\\[([^\\[\\]\\s]+?):([0-9]+)-([0-9]+)\\]', '', 'g'), ' ') AS answer FROM a LEFT JOIN k USING (id)""")
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cited_answers(_answers(spark, sf_dir), made(spark, sf_dir, _ANSWER, 6).filter("k <> 2").selectExpr(*_SOURCE.split(", ")))


@CATALOG.add(f"""WITH {DOCS_SQL}, c AS (SELECT doc_id, path, text, strlen(substr(text, 1, 10)) AS a, strlen(substr(text, 1, 30)) AS b FROM docs WHERE length(text) > 40) SELECT doc_id AS id, path, a AS start_byte, b AS end_byte, substr(text, 11, 20) AS span FROM c""")
def cited_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited_spans(docs(spark, sf_dir).filter("char_length(text) > 40"))


def _cited_spans(d: DataFrame) -> DataFrame:
    at = lambda n: F.octet_length(F.substring("text", 1, n)).cast("long")
    cited = d.select(F.col("doc_id").alias("id"), "path", at(10).alias("start_byte"), at(30).alias("end_byte"))
    evidence = d.select("path", F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), "text", F.sha2("text", 256).alias("span_sha256"))
    return X.cited_spans(evidence, cited)


_CLAIM = """CASE k WHEN 0 THEN 'Run ' || doc_id || ' reached val_rmse 0.0' || (doc_id % 90 + 10) || ' after ' || (doc_id % 50) || ' epochs. See configs/run_' || doc_id || '.yaml for more.' || chr(10) || 'Short.'
  WHEN 1 THEN 'The ' || w1 || ' ' || w2 || ' is ' || w3 || '. Weather was nice today and ' || w4 || ' [a.md:1-2].' WHEN 2 THEN 'ok' WHEN 3 THEN 'The ' || w1 || ' should might does help ' || w2 || ' a lot is.'
  WHEN 4 THEN 'The encoder is clip and resnet50, with 1e-3 in notes/' || w1 || '.md! Is ' || w4 || ' it so?' ELSE NULL END"""
_EVIDENT = "doc_id AS id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'configs/run_' || doc_id || '.yaml' ELSE 'notes/' || w1 || '.md' END AS path, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'clip after ' || (doc_id % 50) || ' epochs, run ' || doc_id || ' 0.0' || (doc_id % 90 + 10) || '.' ELSE '' END AS said"
_DISTINCT = "list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda z: list_position({x}, z[1]) = z[2]), lambda z: z[1])"
_CLAIMS_SQL = f"""{made_sql(_CLAIM, 6, "a", "doc_id AS id, {x} AS answer")},
  s0 AS (SELECT id, string_split(regexp_replace(regexp_replace(coalesce(answer, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS s FROM a),
  s1 AS (SELECT id, unnest(range(len(s))) AS sentence_no, trim(unnest(s)) AS claim FROM s0),
  s2 AS (SELECT *, nullif(regexp_extract(claim, '{X.PATHS}'), '') AS cited_path, regexp_replace(claim, '{X.CITATION}', ' ', 'g') AS bare FROM s1 WHERE length(claim) >= 10),
  s3 AS (SELECT *, {" || ".join(f"regexp_extract_all(bare, '{p}', {g})" for p, g in X.VALUES)} AS v FROM s2),
  s4 AS (SELECT *, {_DISTINCT.format(x="v")} AS found FROM s3),
  cl AS (SELECT id, sentence_no, claim, cited_path, unnest(CASE WHEN len(found) > 0 THEN range(len(found)) ELSE [0] END) AS claim_no, unnest(CASE WHEN len(found) > 0 THEN found ELSE [NULL] END) AS value
    FROM s4 WHERE len(found) > 0 OR cited_path IS NOT NULL OR regexp_matches(claim, '{X.ASSERTS}'))"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.claims(made(spark, sf_dir, _CLAIM, 6).select(F.col("doc_id").alias("id"), F.col("text").alias("answer")))


@CATALOG.add(f"WITH {_CLAIMS_SQL} SELECT id, sentence_no, claim_no, value, claim, cited_path FROM cl")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of an answer for each document, of six kinds."""
    return _claims(spark, sf_dir)


@CATALOG.add(f"""WITH {_CLAIMS_SQL}, e0 AS (SELECT {_EVIDENT} FROM w1s), e AS (SELECT e0.id, path, said || ' ' || coalesce(text, '') AS text FROM e0 JOIN documents ON doc_id = id),
  m AS (SELECT cl.*, coalesce(regexp_matches(e.text, '(?i)(^|[^\\w.])' || regexp_escape(value) || '([^\\w.]|$)'), false) AS v, coalesce(e.path = cited_path, false) AS p, lower(e.text) AS low,
    list_distinct(list_filter(list_transform(regexp_extract_all(claim, '[A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN ({", ".join(f"'{w}'" for w in X.FILLER)}))) AS words FROM cl LEFT JOIN e USING (id)),
  h AS (SELECT *, len(list_filter(words, lambda w: coalesce(contains(low, w), false))) AS held FROM m),
  g AS (SELECT id, sentence_no, claim_no, claim, value, cited_path, bool_or(v) AS v, bool_or(p) AS p, max(held) AS held, any_value(len(words)) AS n FROM h GROUP BY ALL)
  SELECT id, sentence_no, claim_no, claim, value, cited_path, cited_path IS NOT NULL AND NOT p AS missing_path,
    CASE WHEN cited_path IS NOT NULL AND NOT p THEN false WHEN value IS NOT NULL THEN v ELSE p OR n = 0 OR held / n >= 0.6 END AS verified FROM g""")
def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These claims against the document itself, under a path that some of them cite."""
    made_of = made(spark, sf_dir, _CLAIM, 6).selectExpr(*re.split(r", (?=CASE)", _EVIDENT))
    evidence = made_of.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return X.verified(_claims(spark, sf_dir), evidence.select("id", "path", F.concat_ws(" ", "said", F.coalesce("text", F.lit(""))).alias("text")))


#: A claimed and an evident fact for each order, of eleven kinds, over ``kk`` and a number ``m``.
_FACT = [
    "id - id % 2 AS claim_id", "'run' || who AS c_subject", "CASE WHEN kk IN (5, 6) THEN 'name' ELSE 'lr' END AS c_field", "CASE kk WHEN 0 THEN (3 * m) || '' WHEN 2 THEN (5 + m) || '' WHEN 5 THEN 'abc' || m WHEN 6 THEN 'abc' WHEN 10 THEN (3 * m) || '' ELSE m || '' END AS c_value",
    "CASE kk WHEN 0 THEN 'ms' WHEN 1 THEN 'm' WHEN 7 THEN 'furlong' WHEN 10 THEN 'ms' ELSE '' END AS c_unit", "kk = 2 AS c_negated", "CASE WHEN kk IN (3, 4) THEN true END AS c_current", "'run' || (who + CASE WHEN kk = 8 THEN 1 ELSE 0 END) AS e_subject", "CASE WHEN kk IN (5, 6) THEN 'name' ELSE 'lr' END AS e_field",
    "CASE kk WHEN 0 THEN '0.00' || (3 * m) WHEN 2 THEN (6 + m) || '' WHEN 5 THEN 'abc' || m WHEN 6 THEN 'abd' WHEN 9 THEN m || '.0' WHEN 10 THEN (4 * m) || '' ELSE m || '' END AS e_value", "CASE kk WHEN 0 THEN 's' WHEN 1 THEN 's' WHEN 10 THEN 'ms' ELSE '' END AS e_unit", "kk = 9 AS e_negated", "CASE WHEN kk = 3 THEN false END AS e_current",
]
_FACT_OF = "o_orderkey AS id, o_custkey AS who, o_orderkey % 11 AS kk, o_custkey % 3 + 1 AS m"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_FACT_OF.split(", ")).selectExpr(*_FACT)


_FACT_SQL = f"""f AS (SELECT {", ".join(_FACT)} FROM (SELECT {_FACT_OF} FROM orders)),
  {values("u", "unit, dim, factor", [(u, d, f) for u, d, f in X.UNITS])},
  q AS (SELECT f.*, CASE WHEN try_cast(c_value AS DOUBLE) IS NULL THEN CASE WHEN c_unit = '' THEN 'text' END ELSE a.dim END AS ck, CASE WHEN try_cast(e_value AS DOUBLE) IS NULL THEN CASE WHEN e_unit = '' THEN 'text' END ELSE b.dim END AS ek,
        try_cast(c_value AS DECIMAL(18, 6)) * a.factor::DECIMAL(12, 6) AS cn, try_cast(e_value AS DECIMAL(18, 6)) * b.factor::DECIMAL(12, 6) AS en FROM f LEFT JOIN u a ON c_unit = a.unit LEFT JOIN u b ON e_unit = b.unit),
  r AS (SELECT *, CASE WHEN c_subject <> e_subject OR c_field <> e_field THEN 'different_subject_or_field' WHEN c_current AND e_current IS NULL THEN 'currency_unknown' WHEN c_current AND NOT e_current THEN 'superseded_evidence' WHEN ck IS NULL OR ek IS NULL THEN 'unknown_unit_or_nonfinite_value' WHEN ck <> ek THEN 'unit_dimension_mismatch'
        WHEN CASE WHEN ck = 'text' THEN c_value <> e_value ELSE cn <> en END THEN CASE WHEN c_negated OR e_negated THEN 'different_value_with_negation' ELSE 'value_mismatch' END WHEN c_negated <> e_negated THEN 'polarity_mismatch' ELSE 'structured_fields_agree' END AS reason FROM q),
  l AS (SELECT *, CASE WHEN reason = 'structured_fields_agree' THEN 'supported' WHEN reason IN ('superseded_evidence', 'unit_dimension_mismatch', 'value_mismatch', 'polarity_mismatch') THEN 'conflict' ELSE 'unknown' END AS label FROM r)"""


@CATALOG.add(f"WITH {_FACT_SQL} SELECT claim_id, e_value, label, reason FROM l")
def fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compared_facts(_facts(spark, sf_dir)).select("claim_id", "e_value", "label", "reason")


@CATALOG.add(f"WITH {_FACT_SQL} SELECT claim_id, CASE WHEN max(CASE WHEN label = 'conflict' THEN 1 ELSE 0 END) = 1 THEN 'conflict' WHEN min(CASE WHEN label = 'supported' THEN 1 ELSE 0 END) = 1 THEN 'supported' ELSE 'unknown' END AS label FROM l GROUP BY claim_id")
def fact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.fact_verdicts(X.compared_facts(_facts(spark, sf_dir)))


@CATALOG.add(f"""WITH {_PAIRS}, b AS (SELECT query_id, rank, path, list_distinct(qt) AS asked, string_split(regexp_replace(trim(text, ' '), '([.!?' || chr(10) || '])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM j WHERE rank <= 4),
  u AS (SELECT query_id, rank, path, asked, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM b), v AS (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY len(list_intersect(asked, list_distinct({TOKENS_SQL.format(x="s")}))) DESC, i) AS k FROM u)
  SELECT query_id, string_agg('[' || path || '] ' || substr(trim(s, ' '), 1, 400), chr(10) ORDER BY rank) AS answer FROM v WHERE k = 1 GROUP BY query_id""")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extractive_answers(_pairs(spark, sf_dir))


@CATALOG.add(f"""WITH RECURSIVE {_PAIRS}, h AS (SELECT query_id, rank, item, len(string_split(text, ' ')) AS size FROM j),
  w(query_id, rank, used, taken) AS (SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, false FROM h UNION ALL SELECT h.query_id, h.rank, w.used + CASE WHEN w.used + size <= 2048 THEN size ELSE 0 END, w.used + size <= 2048 FROM w JOIN h ON h.query_id = w.query_id AND h.rank = w.rank + 1)
  SELECT query_id, rank, item, size FROM w JOIN h USING (query_id, rank) WHERE taken""")
def scratchpad_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("query_id", "rank", "item", F.size(F.split("text", " ")).cast("long").alias("size"))
    return X.within_budget(rows, 2048)


_ART = "CAST(user_id AS STRING) AS run, CAST(event_id AS STRING) AS path, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'code' WHEN 1 THEN 'config' WHEN 2 THEN 'paper' WHEN 3 THEN 'test' ELSE 'env' END AS role, event_id % 17 > 0 AS present, event_id % 3 = 0 AS cited"


@CATALOG.add(f"""WITH f AS (SELECT {_ART} FROM events), b AS (SELECT run, bool_and(present) AS available, bool_or(present AND role IN ('code', 'test')) AS code, bool_or(present AND role = 'config') AS config, bool_or(present AND role IN ('env', 'paper')) AS papers, bool_or(cited) AS cited FROM f GROUP BY run)
  SELECT run, available, available AND code AND config AS functional, available AND code AND config AND papers AND cited AS reusable FROM b""")
def artifact_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.badges(table(spark, sf_dir, "events").selectExpr(*_ART.split(", ")).withColumnRenamed("present", "exists"))


@CATALOG.add("""WITH f AS (SELECT o_orderpriority AS template, o_orderkey AS id, o_orderstatus AS value FROM orders), d AS (SELECT DISTINCT template, value FROM f), n AS (SELECT template, value, coalesce(lead(value) OVER (PARTITION BY template ORDER BY value), first_value(value) OVER (PARTITION BY template ORDER BY value)) AS planted FROM d)
  SELECT template, value, id, nullif(planted, value) AS planted FROM f JOIN n USING (template, value)""")
def planted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return X.planted_values(o.select(F.col("o_orderpriority").alias("template"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value")))


_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@CATALOG.add(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", nullif(CAST({c} AS VARCHAR), '') AS cell FROM orders" for c in _COLUMNS if c != "o_totalprice")
    + """), n AS (SELECT "column", count(*) - count(cell) AS missing, count(cell) AS present, count(DISTINCT cell) AS "unique", bool_and(lower(trim(cell)) IN ('true', 'false')) AS truths, bool_and(try_cast(cell AS DOUBLE) IS NOT NULL) AS numbers, min(try_cast(cell AS DOUBLE)) AS minimum, max(try_cast(cell AS DOUBLE)) AS maximum FROM c GROUP BY ALL)
  SELECT "column", CASE WHEN truths THEN 'boolean' WHEN numbers THEN 'numeric' WHEN "unique" <= greatest(20, present // 2) THEN 'categorical' ELSE 'text' END AS kind, missing, "unique", minimum, maximum FROM n"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(table(spark, sf_dir, "orders").select(*(c for c in _COLUMNS if c != "o_totalprice")))


@CATALOG.add(" UNION ALL ".join(f"SELECT '{op}' AS operation, l_returnflag AS \"group\", round({f}, 6)::DOUBLE AS result, count(l_quantity) AS n FROM lineitem GROUP BY l_returnflag" for op, f in (("mean", "avg(l_quantity)"), ("sum", "sum(l_quantity)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"), ("count", "count(l_quantity)"))))
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for op in P.OPERATIONS:
        part = P.aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", op).withColumn("operation", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


@CATALOG.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@CATALOG.add("WITH r AS (SELECT event_type AS \"group\", event_id AS id, value AS reward FROM events WHERE value IS NOT NULL), w AS (SELECT *, avg(reward) OVER (PARTITION BY \"group\") AS m, stddev_pop(reward) OVER (PARTITION BY \"group\") AS s, count(*) OVER (PARTITION BY \"group\") AS n FROM r) SELECT \"group\", id, reward, CASE WHEN n > 1 THEN round((reward - m) / (s + 1e-8), 6) ELSE 0 END AS advantage FROM w")
def grpo_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    return RL.advantages(e.select(F.col("event_type").alias("group"), F.col("event_id").alias("id"), F.col("value").alias("reward")))


@CATALOG.add("SELECT user_id % 20 AS id, round(coalesce(-avg(CASE WHEN event_type <> 'error' THEN -value END), 0), 8) AS nll FROM events GROUP BY user_id % 20")
def masked_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return RL.masked_nll(e.select((F.col("user_id") % 20).alias("id"), (-F.col("value")).alias("logprob"), (F.col("event_type") != "error").alias("mask")))


_TRAJ = """CASE k WHEN 0 THEN '<search> ' || w1 || ' ' || w2 || ' </search><information>' || w3 || '</information><search>' || w4 || '</search><answer> yes </answer>' WHEN 1 THEN w1 || ' without tags' WHEN 2 THEN '<search>' || w1 || '<answer>' || w2 || chr(10) || w3 || '</answer><answer>no</answer>' ELSE NULL END"""


@CATALOG.add(f"""WITH {made_sql(_TRAJ, 4, "r", "doc_id AS id, {x} AS text")} SELECT id, list_transform(regexp_extract_all(text, '(?s)<search>(.*?)</search>', 1), lambda x: trim(x, ' ')) AS searches, list_transform(regexp_extract_all(text, '(?s)<information>(.*?)</information>', 1), lambda x: trim(x, ' ')) AS informations,
  trim(coalesce(regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1), ''), ' ') AS answer FROM r""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.trajectories(made(spark, sf_dir, _TRAJ, 4).select(F.col("doc_id").alias("id"), "text"))


@CATALOG.add("WITH o AS (SELECT l_orderkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS i FROM lineitem) SELECT l_suppkey, l_orderkey FROM o WHERE i = 1")
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("l_orderkey"))


@CATALOG.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@CATALOG.add("SELECT s_nationkey::BIGINT AS nation FROM supplier INTERSECT SELECT c_nationkey::BIGINT FROM customer")
def nations_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, sf_dir, "customer").select("c_nationkey"))


@CATALOG.add("WITH t AS (SELECT n_name, c_custkey, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY spent DESC, c_custkey) AS rank FROM t) SELECT n_name, c_custkey, spent, rank FROM r WHERE rank <= 3")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    spent = o.groupBy("n_name", "c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    rank = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("spent"), "c_custkey"))
    return spent.withColumn("rank", rank).filter("rank <= 3")
