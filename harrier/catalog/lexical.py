"""Lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, QUERIES_SQL, TF_SQL, TOKEN_SQL, TOKENS_SQL, Catalog, bm25_sql, docs, table, text_queries, top_sql
from harrier.functions import text as T
from harrier.operators import blockmax as B
from harrier.operators import fulltext as X
from harrier.operators import lexical as L
from harrier.operators.ranking import top_k
from harrier.scratch import fresh_folder
from harrier.streaming.segments import SegmentedIndex

CATALOG = Catalog()
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@CATALOG.add(f"WITH {TF_SQL} SELECT doc_id, term, tf FROM tf")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_frequencies(docs(spark, sf_dir))


@CATALOG.add(f"WITH {TF_SQL} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 8) AS idf FROM df, st")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    stats = L.corpus_statistics(L.document_lengths(d))
    df = L.term_statistics(L.token_frequencies(d))
    return df.select("term", "df", F.round(L.idf(stats.select("n").scalar(), F.col("df")), 8).alias("idf"))


@CATALOG.add(f"WITH {TF_SQL} SELECT n, round(avgdl, 8) AS avgdl, (SELECT CAST(coalesce(sum(dl), 0) AS BIGINT) FROM dl) AS total FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.corpus_statistics(L.document_lengths(docs(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 8))


@CATALOG.add(f"WITH {TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 10, 'r')} SELECT query_id, doc_id AS item, score, rank FROM r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), 10)


@CATALOG.add(CATALOG.sql["bm25_topk"])
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a stored index, which is written first."""
    place = fresh_folder(spark, "index")
    L.write_index(docs(spark, sf_dir), place)
    return L.index_top_k(L.read_index(spark, place), L.query_terms(text_queries(spark, sf_dir)), 10)


@CATALOG.add(CATALOG.sql["bm25_topk"])
def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a block index, which is written first; few postings are read at once."""
    place = fresh_folder(spark, "blocks")
    B.write_blocks(docs(spark, sf_dir), place)
    return B.block_top_k(B.read_blocks(spark, place), L.query_terms(text_queries(spark, sf_dir)), 10)


@CATALOG.add(CATALOG.sql["bm25_topk"])
def bm25_blockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two passes, which read the blocks that can beat a query's threshold only."""
    place = fresh_folder(spark, "blocks")
    B.write_blocks(docs(spark, sf_dir), place, span=16)
    return B.block_top_k(B.read_blocks(spark, place), L.query_terms(text_queries(spark, sf_dir)), 10, one_pass=0)


@CATALOG.add(CATALOG.sql["bm25_topk"].replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 3)", 1))
def segmented_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segmented index of all documents, a fifth of them in an older version first, of which a seventh is
    deleted in the end; four batches, so segments are merged on the way."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("item"), "text")
    index = SegmentedIndex(spark, fresh_folder(spark, "segments"), buckets=8, fanout=3)
    old, gone = F.col("item") % 5 == 0, F.col("item") % 7 == 3
    index.apply(d.filter(~old), 0)
    index.apply(d.filter(old).withColumn("text", F.concat(F.lit("an older version "), F.reverse("text"))), 1)
    index.apply(d.filter(old), 2)
    index.apply(d.filter(gone).select("item", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted")), 3)
    return index.top_k(L.query_terms(text_queries(spark, sf_dir)), 10)


_GRID = [("fixture", 1.5, 0.75), ("beir", 0.9, 0.4), ("flat", 1.2, 0.0)]


@CATALOG.add(
    f"WITH {TF_SQL}, {QT_SQL}, "
    + ", ".join(bm25_sql(str(k1), str(b), f"b{i}") for i, (_, k1, b) in enumerate(_GRID))
    + ", "
    + ", ".join(top_sql(f"b{i}", 5, f"r{i}") for i in range(len(_GRID)))
    + " "
    + " UNION ALL ".join(f"SELECT '{name}' AS setting, query_id, doc_id AS item, score, rank FROM r{i}" for i, (name, *_) in enumerate(_GRID))
)
def bm25_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, terms, out = docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), None
    for name, k1, b in _GRID:
        part = L.bm25_top_k(d, terms, 5, k1, b).select(F.lit(name).alias("setting"), "query_id", "item", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@CATALOG.add(f"WITH {DOCS_SQL}, t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM docs) SELECT lang, term, count(*) AS n FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL")
def stopword_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exploded(docs(spark, sf_dir).select("lang", T.alnum_tokens("text").alias("tokens"))).groupBy("lang", "term").agg(F.count("*").alias("n"))


@CATALOG.add()
def porter_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenize = T.analyzer("beir")
    d = docs(spark, sf_dir).select("doc_id", tokenize("text").alias("stems"))
    terms = L.query_terms(text_queries(spark, sf_dir), tokenize)
    return L.bm25_top_k(d, terms, 10, 0.9, 0.4, text="stems", tokenize=lambda c: F.col(c) if isinstance(c, str) else c)


@CATALOG.add(rf"WITH {DOCS_SQL}, t AS (SELECT lang, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}]*'))) AS term FROM docs) SELECT lang, term, count(*) AS n FROM t GROUP BY ALL")
def unicode_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exploded(docs(spark, sf_dir).select("lang", F.transform(T.word_runs("text"), F.lower).alias("tokens"))).groupBy("lang", "term").agg(F.count("*").alias("n"))


@CATALOG.add(rf"WITH u AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\p{{M}}]*'), lambda t: lower(t)) AS w FROM benchmark) SELECT query_id, array_to_string(list_filter(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]), lambda t: t <> 'or'), ' or ') AS lexical_query FROM u")
def lexical_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.lexical_query("text").alias("lexical_query"))


@CATALOG.add(f"""WITH {DOCS_SQL}, q AS (SELECT doc_id AS query_id, 'open ' || path || ' or ' || source || ' now' AS text FROM docs WHERE doc_id % 50 = 0),
  s AS (SELECT query_id, path AS item, lower(path) AS lp, lower(doc_id || '.txt') AS name, CAST(doc_id AS VARCHAR) AS stem, lower(q.text) AS qt FROM q, docs),
  sc AS (SELECT query_id, item, (CASE WHEN contains(qt, name) THEN 5 ELSE 0 END + CASE WHEN contains(qt, lp) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(qt, '(^|[^0-9a-z])' || stem || '([^0-9a-z]|$)') THEN 2 ELSE 0 END)::DOUBLE AS score FROM s)
  SELECT query_id, item, score FROM sc WHERE score >= 7""")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    q = d.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("open "), "path", F.lit(" or "), "source", F.lit(" now")).alias("text"))
    return L.path_scores(d, q).filter("score >= 7")


@CATALOG.add(f"""WITH {TF_SQL}, q0 AS (SELECT * FROM (VALUES (1::BIGINT, 'thereinne zzzz'), (2, 'the of'), (3, 'qqqq xxxx')) AS v(query_id, text)),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS_SQL.format(x='text')}) AS term FROM q0) GROUP BY ALL),
  {bm25_sql()}, {top_sql('bm', 5, 'r')},
  sub AS (SELECT query_id, doc_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM q0 JOIN docs ON contains(lower(docs.text), 'and') WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = q0.query_id))
  SELECT query_id, doc_id AS item, score, 'bm25' AS backend FROM r UNION ALL SELECT query_id, doc_id, score, 'substring' FROM sub WHERE rank <= 5""")
def lexical_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    q = spark.createDataFrame([(1, "thereinne zzzz"), (2, "the of"), (3, "qqqq xxxx")], "query_id int, text string")
    first = L.bm25_top_k(d, L.query_terms(q), 5).drop("rank")
    like = d.filter(F.col("text").ilike("%and%")).select(F.col("doc_id").alias("item"), F.lit(1.0).alias("score"))
    few = like.orderBy("item").limit(5)
    last = few.select(F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("query_id"), "item", "score")
    return L.fallback_tiers([("bm25", first), ("substring", last)])


@CATALOG.add(f"WITH {DOCS_SQL} SELECT doc_id, 1.0::DOUBLE AS score FROM docs WHERE text ILIKE '%thing%'")
def ilike_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter(F.col("text").ilike("%thing%")).select("doc_id", F.lit(1.0).alias("score"))


@CATALOG.add("SELECT doc_id, private FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN 'true' WHEN lang = 'fr' THEN 'false' END AS private FROM documents) WHERE coalesce(private <> 'true', true) OR CAST(doc_id AS VARCHAR) IN ('3', '11', '40')")
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    private = F.when(F.col("lang") == "de", "true").when(F.col("lang") == "fr", "false")
    return L.visible(table(spark, sf_dir, "documents").select("doc_id", private.alias("private")), ["3", "11", "40"])


@CATALOG.add(f"WITH {DOCS_SQL} SELECT doc_id, path FROM docs WHERE regexp_matches(path, '^src1.*/[0-9]*5[.]txt$') ORDER BY path LIMIT 100")
def glob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter(T.glob_match("path", "src1*/*5.txt")).select("doc_id", "path").orderBy("path").limit(100)


def _covers_sql(parts: str) -> str:
    """All covers, from ``parts (query_id, alternative, part, negated, words)`` as a query over ``w
    (query_id, w)``, the tokens of each passage: occurrences, for each end the largest start from which an
    alternative is whole, and the words between."""
    return f"""WITH {DOCS_SQL}, w AS (SELECT item_id AS query_id, {TOKENS_SQL.format(x="text")} AS w FROM benchmark),
      parts AS ({parts}),
      raw AS (SELECT doc_id, {TOKENS_SQL.format(x="text")} AS t FROM docs),
      tok AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM raw),
      word AS (SELECT query_id, alternative, part, negated, len(words) AS n, unnest(words) AS term, unnest(range(len(words))) AS turn FROM parts),
      occ AS (SELECT query_id, doc_id, alternative, part, negated, pos - turn AS a, pos - turn + n - 1 AS b FROM word JOIN tok USING (term) GROUP BY ALL HAVING count(DISTINCT turn) = any_value(n)),
      ent AS (SELECT DISTINCT query_id, doc_id, pos FROM (SELECT DISTINCT query_id, term FROM word) JOIN tok USING (term)),
      need AS (SELECT query_id, alternative, count(*) AS n_parts FROM parts WHERE NOT negated GROUP BY ALL),
      have AS (SELECT query_id, doc_id, alternative FROM occ JOIN need USING (query_id, alternative) WHERE NOT negated GROUP BY ALL HAVING count(DISTINCT part) = any_value(n_parts)),
      barred AS (SELECT DISTINCT query_id, doc_id, alternative FROM occ WHERE negated),
      good AS (SELECT DISTINCT query_id, doc_id FROM have ANTI JOIN barred USING (query_id, doc_id, alternative)),
      own AS (SELECT occ.* FROM occ JOIN have USING (query_id, doc_id, alternative) SEMI JOIN good USING (query_id, doc_id) WHERE NOT negated),
      stop AS (SELECT DISTINCT query_id, doc_id, b AS r FROM own),
      last AS (SELECT query_id, doc_id, r, alternative, part, max(a) AS a FROM stop JOIN own USING (query_id, doc_id) WHERE b <= r GROUP BY ALL),
      held AS (SELECT query_id, doc_id, r, alternative, min(a) AS a FROM last JOIN need USING (query_id, alternative) GROUP BY ALL HAVING count(*) = any_value(n_parts)),
      best AS (SELECT query_id, doc_id, r, max(a) AS a FROM held GROUP BY ALL),
      cover AS (SELECT query_id, doc_id, a, min(r) AS b FROM best GROUP BY ALL),
      noise AS (SELECT query_id, doc_id, a, b, b - a + 1 - count(*) AS noise FROM cover JOIN ent USING (query_id, doc_id) WHERE pos BETWEEN a AND b GROUP BY query_id, doc_id, a, b),
      scored AS (SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + noise)), 8) AS score FROM noise GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
      SELECT query_id, doc_id AS item, score, rank FROM r WHERE rank <= 20"""


def _passages(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    """``(query_id, text)``, made from the tokens of each passage."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens("text").alias("w"))
    return w.select("query_id", made(lambda i: F.get("w", F.lit(i - 1))).alias("text"))


def _found(spark: SparkSession, sf_dir: str, queries: DataFrame, mode: str) -> DataFrame:
    return top_k(X.full_text(X.positions(docs(spark, sf_dir)), X.parsed(queries, mode)), 20)


@CATALOG.add(_covers_sql("SELECT query_id, 0 AS alternative, term AS part, false AS negated, [term] AS words FROM (SELECT DISTINCT query_id, unnest(w[1:3]) AS term FROM w)"))
def full_text_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all of the first three words of a passage, by cover density."""
    return _found(spark, sf_dir, _passages(spark, sf_dir, lambda t: F.concat_ws(" ", t(1), t(2), t(3))), "all")


@CATALOG.add(_covers_sql("SELECT query_id, 0 AS alternative, 0 AS part, false AS negated, w[2:4] AS words FROM w WHERE len(w) > 1"))
def full_text_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the second to fourth words of a passage as a phrase."""
    return _found(spark, sf_dir, _passages(spark, sf_dir, lambda t: F.concat_ws(" ", t(2), t(3), t(4))), "phrase")


@CATALOG.add(_covers_sql("""SELECT DISTINCT query_id, alternative, array_to_string(words, ' ') || negated AS part, negated, words FROM (
        SELECT query_id, 0 AS alternative, false AS negated, w[1:2] AS words FROM w UNION ALL SELECT query_id, 0, false, [w[3]] FROM w
        UNION ALL SELECT query_id, 1, false, [w[4]] FROM w UNION ALL SELECT query_id, 1, false, [w[5]] FROM w UNION ALL SELECT query_id, 1, true, [w[6]] FROM w) WHERE words[1] IS NOT NULL"""))
def full_text_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase and a word, or two words without a third: ``"a b" c or d e -f``."""
    made = lambda t: F.concat_ws(" ", F.concat(F.lit('"'), t(1), F.lit(" "), t(2), F.lit('"')), t(3), F.lit("or"), t(4), t(5), F.concat(F.lit("-"), t(6)))
    return _found(spark, sf_dir, _passages(spark, sf_dir, made), "web")
