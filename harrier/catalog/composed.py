"""Lists put together, ingest as a whole, answers and their checks, and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.catalog.answers import _PAIRS, _pairs
from harrier.catalog.base import Catalog, DOCS_SQL, FILES_SQL, QT_SQL, TF_SQL, all_vector_queries, bm25_sql, docs, files, table, text_queries, top_sql
from harrier.catalog.chunks import _FIXED, _MANIFEST, _SCAN, _manifest
from harrier.catalog.evaluation import CATALOG as EVALUATION
from harrier.catalog.evaluation import qrels
from harrier.functions import text as T
from harrier.functions import vectors as V
from harrier.operators import chunking as C
from harrier.operators import dense as D
from harrier.operators import evidence as X
from harrier.operators import lexical as L
from harrier.operators import ranking as R
from harrier.operators import rerank as K
from harrier.operators import scoring as S
from harrier.sources import ingest as I
from harrier.sources import judgements as J

CATALOG = Catalog()

_LISTS = """lists AS (SELECT * FROM (SELECT doc_id % 10 AS query_id, 0 AS list_no, doc_id AS item, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT doc_id % 10, 1, doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id DESC) FROM documents) WHERE rank <= 30),
  f AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf, min(list_no * 1000 + rank) AS first FROM lists GROUP BY query_id, item)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("item"), "n_chars")
    by = Window.partitionBy("query_id")
    long = d.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n_chars"), "item"))).filter("rank <= 30").select("query_id", F.lit(0).alias("list_no"), "item", "rank")
    late = d.withColumn("rank", F.row_number().over(by.orderBy(F.desc("item")))).filter("rank <= 30").select("query_id", F.lit(1).alias("list_no"), "item", "rank")
    return long.unionByName(late)


@CATALOG.add(f"WITH {_LISTS} SELECT * FROM (SELECT query_id, item, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS rank FROM f) WHERE rank <= 20")
def rrf_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_first_seen(_lists(spark, sf_dir), 20)


@CATALOG.add(f"WITH {_LISTS} SELECT * FROM (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM f) WHERE rank <= 40")
def append_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.append_unseen(_lists(spark, sf_dir), 40)


@CATALOG.add(f"""WITH {TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 20, 'r')}, p AS (SELECT query_id, source AS path, min(rank) AS first FROM r JOIN docs USING (doc_id) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, path) AS i FROM p)
  SELECT query_id, list(path ORDER BY i) AS paths, max(CASE WHEN i = 3 THEN first END) AS hits_to_nth FROM o WHERE i <= 5 GROUP BY query_id""")
def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), 20)
    placed = hits.join(docs(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("source").alias("path")), "item")
    return R.path_lists(placed, 5, 3)


@CATALOG.add(f"""WITH {_FIXED} SELECT path, count(*) AS n FROM w WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY path""")
def rows_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rows_per_path(C.fixed_chunks(docs(spark, sf_dir)))


@CATALOG.add(f"WITH {DOCS_SQL}, {_MANIFEST} SELECT DISTINCT path, content_hash FROM manifest WHERE pipeline = 'v2'")
def hashes_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.hashes_for(_manifest(spark, sf_dir), "v2")


@CATALOG.add(f"""WITH {_SCAN}, s AS (SELECT path, text, unnest(range(0, CAST(ceil(greatest(length(text) - 512, 0) / 462.0::DOUBLE) AS BIGINT) + 1)) * 462 AS a FROM scan JOIN gated USING (path) WHERE reason IS NULL),
  c AS (SELECT path, count(*) AS n FROM s WHERE regexp_matches(substr(text, CAST(a AS BIGINT) + 1, 512), '\\S') GROUP BY path) SELECT path, sha256, reason, coalesce(n, 0) AS n_chunks FROM gated LEFT JOIN c USING (path)""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, gates, chunks and counts in one."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 9, ".exe").otherwise(".txt"))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), data.alias("content"), F.lit(0.0).alias("mtime"), F.octet_length(data).alias("size"))
    return I.load_chunks(files, max_bytes=20_000)[1]


@CATALOG.add(f"WITH {_PAIRS}, s AS (SELECT query_id, item, CASE WHEN len(qt) = 0 OR len(dt) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qt), dt)) / len(list_distinct(qt))::DOUBLE END AS share FROM j) SELECT query_id, item, round(share, 8) AS share FROM s WHERE share >= 0.12")
def relevant_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = T.containment(T.tokens("query"), T.tokens("text"))
    return _pairs(spark, sf_dir).select("query_id", "item", share.alias("share")).filter("share >= 0.12").withColumn("share", F.round("share", 8))


@CATALOG.add(f"WITH {TF_SQL}, {QT_SQL}, s AS (SELECT query_id, doc_id AS item, round(0.1::DOUBLE * sum(tf), 8) AS score FROM (SELECT DISTINCT query_id, term FROM qt) JOIN tf USING (term) GROUP BY ALL), {top_sql('s', 20, 'r', 'item')} SELECT query_id, item, score, rank FROM r")
def full_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(L.full_text_scores(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir))), 20)


_CONTEXT = "trim(regexp_replace(source || '/' || doc_id || '.txt', '[_/.-]+', ' ', 'g')) || chr(10) || coalesce(text, '') AS text, lang"


@CATALOG.add(f"WITH {TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 10, 'r')} SELECT query_id, doc_id AS item, score, rank FROM r".replace("coalesce(text, '') AS text, lang", _CONTEXT))
def contextual_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("search_context", T.path_words("path"))
    return L.bm25_top_k(d.select("doc_id", L.search_text(d).alias("text")), L.query_terms(text_queries(spark, sf_dir)), 10)


def _shared_words(pairs: list[tuple[str, str]]) -> Sequence[float]:
    """Stands in for a model: the words that both have, less three."""
    return [len(set(q.split(" ")) & set(t.split(" "))) - 3.0 for q, t in pairs]


@CATALOG.add(f"WITH {_PAIRS} SELECT query_id, item, round(1 / (1 + exp(-(len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(text, ' ')))) - 3.0::DOUBLE))), 10) AS score, 'model' AS backend FROM j")
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.model_scores(_pairs(spark, sf_dir), _shared_words)


@CATALOG.add(f"""WITH {_PAIRS}, l AS (SELECT query_id, any_value(query) AS query, count(*) AS n, string_agg('[' || rank || '] ' || text, chr(10) ORDER BY rank) AS lines FROM j WHERE rank <= 5 GROUP BY query_id)
  SELECT query_id, n, sha256('Question: ' || query || chr(10) || 'Passages:' || chr(10) || lines || chr(10) || 'Order all passages by how well they answer the question, best first, as [2] > [1]. Give the order alone.') AS sha FROM l""")
def listwise_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.listwise_prompts(_pairs(spark, sf_dir), 5).select("query_id", "n", F.sha2("prompt", 256).alias("sha"))


@CATALOG.add(f"""WITH {_PAIRS}, b AS (SELECT query_id, rank, 'Source ' || rank || ' [' || path || ':0-' || strlen(text) || ']' || chr(10) || CASE WHEN length(t) > 1200 THEN substr(t, 1, 1200) || ' ...' ELSE t END AS block FROM (SELECT *, trim(text, ' ') AS t FROM j) WHERE rank <= 8)
  SELECT query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS sha FROM b GROUP BY query_id""")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _pairs(spark, sf_dir).withColumns({"start_byte": F.lit(0).cast("long"), "end_byte": F.octet_length("text").cast("long")})
    return X.source_blocks(hits).select("query_id", F.sha2("sources", 256).alias("sha"))


@CATALOG.add(f"WITH {_PAIRS}, y AS (SELECT query_id, CASE WHEN item % 3 = 0 THEN path || '.md' WHEN item % 3 = 1 THEN path || '.py' ELSE path END AS path, rank FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM y) SELECT query_id, path, CASE WHEN path LIKE '%.md' THEN 'paper' WHEN path LIKE '%.py' THEN 'code' ELSE 'config' END AS role, i AS rank FROM o WHERE i <= 12")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("item") % 3 == 0, ".md").when(F.col("item") % 3 == 1, ".py").otherwise("")
    return X.file_roles(_pairs(spark, sf_dir).withColumn("path", F.concat("path", ending)))


_FIELD = r"(?i)\b{f}\s*[:=]\s*([A-Za-z0-9.eE+\-]+)"


@CATALOG.add(f"WITH {FILES_SQL}, r AS (SELECT r AS query_id, text, k AS rank FROM f), x AS (" + " UNION ALL ".join(f"SELECT query_id, rank, '{f}' AS field, regexp_extract(text, '{_FIELD.format(f=f)}', 1) AS value FROM r" for f in X.FIELDS) + ") SELECT query_id::BIGINT AS query_id, field, arg_min(value, rank) AS value FROM x WHERE value <> '' GROUP BY ALL")
def first_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_fields(files(spark, sf_dir).select(F.col("r").alias("query_id"), F.col("k").alias("rank"), "path", "text"))


@CATALOG.add(f"""WITH {DOCS_SQL}, a AS (SELECT doc_id AS id, path, coalesce(length(text), 0) AS n FROM docs), s AS (SELECT id, CASE id % 4 WHEN 0 THEN [CAST(n AS VARCHAR)] WHEN 1 THEN [path] WHEN 3 THEN [CAST(n + 1 AS VARCHAR), CAST(n AS VARCHAR)] END AS parts, CASE id % 4 WHEN 0 THEN [true] WHEN 1 THEN [true] WHEN 3 THEN [id = n + 1, true] END AS stated FROM a)
  SELECT id, parts, stated, CASE WHEN NOT list_contains(stated, false) THEN 'correct' WHEN list_contains(stated, true) THEN 'partial' END AS label FROM s""")
def answer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's length and path, stated in a sentence; golds of four kinds in turn."""
    n = F.char_length("text")
    gold = F.when(F.col("doc_id") % 4 == 0, n.cast("string")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("file "), "path")).when(F.col("doc_id") % 4 == 2, "yes").otherwise(F.concat((n + 1).cast("string"), F.lit(", "), n.cast("string")))
    answer = F.concat(F.lit("The file "), "path", F.lit(" has "), n.cast("string"), F.lit(" characters [S12]."))
    return S.answer_values(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), answer.alias("answer"), gold.alias("gold"), F.array().cast("array<string>").alias("cited")))


@CATALOG.add(f"""WITH {DOCS_SQL} SELECT doc_id AS id, doc_id % 3 = 2 OR (doc_id % 3 = 0 AND doc_id % 2 = 1) AS uncited, doc_id % 3 = 1 AS abstained, doc_id % 3 = 1 AS abstention_only, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_citations,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS cited_in_retrieved, CASE WHEN doc_id % 3 = 1 AND doc_id % 5 > 0 THEN 'wrong' END AS rule_label FROM docs""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each document: cited, abstaining or plain; half of the sources were retrieved."""
    d = docs(spark, sf_dir)
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("It is so ["), "path", F.lit(":0-9]."))).when(F.col("doc_id") % 3 == 1, " NOT IN SOURCES. ").otherwise("It is so.")
    answers = d.select(F.col("doc_id").alias("id"), answer.alias("answer"), F.when(F.col("doc_id") % 5 > 0, "gold").otherwise(" ").alias("gold"))
    hits = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "path", F.lit(0).cast("long").alias("start_byte"), F.lit(9).cast("long").alias("end_byte"))
    return S.answer_checks(answers, hits)


_DRAWN = "dr AS (SELECT id // n AS b, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12))::BIGINT % n AS idx FROM (SELECT n, unnest(range({samples} * n)) AS id FROM k))"


@CATALOG.add(f"""WITH l AS (SELECT source, (quality - toxic)::DOUBLE AS d FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, sum(d) AS s, count(d) AS c FROM l GROUP BY source), p AS (SELECT *, row_number() OVER (ORDER BY source) - 1 AS idx FROM g), k AS (SELECT count(*) AS n FROM g), {_DRAWN.format(samples=500)},
  m AS (SELECT b, sum(s) / sum(c) AS m FROM dr JOIN p USING (idx) GROUP BY b), e AS (SELECT round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m)
  SELECT (SELECT n FROM k) AS n_groups, (SELECT round(sum(s) / sum(c), 8) FROM g) AS mean, low, high, CASE WHEN (SELECT count(*) FROM l WHERE d <> 0) = 0 THEN 'identical' WHEN low > 0 THEN 'above zero' WHEN high < 0 THEN 'below zero' ELSE 'covers zero' END AS verdict FROM e""")
def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality less toxicity, when whole sources are drawn."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("family"), (F.col("quality") - F.col("toxic")).cast("double").alias("value"))
    changed = rows.filter("value <> 0").limit(1).count()
    found = S.group_interval(rows, S.draws(spark, rows.select("family").distinct().count(), 500))
    return found.withColumn("verdict", S.verdict(F.col("low"), F.col("high"), F.lit(changed)))


@CATALOG.add(f"""WITH l AS (SELECT doc_id % 50 AS q, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS la, quality AS lb FROM labels JOIN documents USING (doc_id)), g AS (SELECT q, la, lb, count(*) AS c FROM l GROUP BY ALL), i AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS idx FROM (SELECT DISTINCT q FROM g)), k AS (SELECT count(*) AS n FROM i), {_DRAWN.format(samples=200)},
  c AS (SELECT b, la, lb, sum(c) AS c FROM dr JOIN i USING (idx) JOIN g USING (q) GROUP BY ALL), t AS (SELECT b, sum(c) AS n, sum(CASE WHEN la = lb THEN c ELSE 0 END) AS same FROM c GROUP BY b),
  x AS (SELECT u.b, sum(ca * cb) AS bc FROM (SELECT b, la AS l, sum(c) AS ca FROM c GROUP BY ALL) u JOIN (SELECT b, lb AS l, sum(c) AS cb FROM c GROUP BY ALL) v ON u.b = v.b AND u.l = v.l GROUP BY u.b),
  y AS (SELECT same / n::DOUBLE AS po, coalesce(bc, 0) / (n * n)::DOUBLE AS pe FROM t LEFT JOIN x USING (b)), z AS (SELECT CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END AS k FROM y)
  SELECT round(quantile_cont(k, 0.025), 8) AS low, round(quantile_cont(k, 0.975), 8) AS high FROM z""")
def kappa_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    labels = rows.select((F.col("doc_id") % 50).alias("q"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("a"), F.col("quality").alias("b_label"))
    return S.kappa_interval(labels, S.draws(spark, labels.select("q").distinct().count(), 200), "q", "a", "b_label")


@CATALOG.add("""WITH s AS (SELECT 'as is' AS arm, event_id, event_type AS category, value, 0.0::DOUBLE AS d FROM events WHERE value IS NOT NULL UNION ALL SELECT 'rounded', event_id, event_type, round(value), round(value) - value FROM events WHERE value IS NOT NULL)
  SELECT arm, category, count(*) AS n, round(avg(value), 6) AS mean, round(avg(d), 6) AS delta, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) < 20 AS small FROM s GROUP BY GROUPING SETS ((arm, category), (arm))""")
def arm_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("category"), "value")
    arms = e.withColumn("arm", F.lit("as is")).unionByName(e.withColumn("value", F.round("value")).withColumn("arm", F.lit("rounded")))
    return S.confidence(arms, "as is").withColumns({"mean": F.round("mean", 6), "delta": F.round("delta", 6)})


@CATALOG.add("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x: round(x::DOUBLE, 2)) AS b FROM embeddings),
  n AS (SELECT list_transform(a, lambda x: x / greatest(sqrt(list_sum(list_transform(a, lambda y: y * y))), 1e-12)) AS a, list_transform(b, lambda x: x / greatest(sqrt(list_sum(list_transform(b, lambda y: y * y))), 1e-12)) AS b FROM u),
  c AS (SELECT list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS far, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) AS cosine FROM n)
  SELECT count(*) AS n, round(max(far), 8) AS max_difference, round(min(cosine), 8) AS least_cosine, round(avg(cosine), 8) AS mean_cosine FROM c""")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return S.vector_check(e, e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 2))))


@CATALOG.add(EVALUATION.sql["bm25_retrieval_quality"])
def rescored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics from the lines of the stored run."""
    hits = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), 50)
    return I.rescored(J.trec_lines(hits, "run"), qrels(spark, sf_dir), text_queries(spark, sf_dir))


@CATALOG.add()
def storage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 and bytes of a vector, for each way to keep vectors."""
    e, q = table(spark, sf_dir, "embeddings"), all_vector_queries(spark, sf_dir)
    exact, half = D.exact_top_k(e, q, 10), lambda v: v.withColumn("embedding", V.to_half("embedding"))
    found = {"float": (256, exact), "half": (128, D.exact_top_k(half(e), half(q), 10)), **{f"bits and {n} x rescored": (8, D.hamming_rescored(e, q, 10, n)) for n in (4, 16)}}
    out = None
    for name, (size, hits) in found.items():
        # what a variant found is judged by the exact cosines
        part = D.tie_aware_recall(hits, exact, 10).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(name).alias("variant"), F.lit(size).alias("bytes"), "recall")
        out = part if out is None else out.unionByName(part)
    return out
