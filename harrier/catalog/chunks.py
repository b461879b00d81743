"""Chunking and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.catalog.base import DOCS_SQL, QT_SQL, TF_SQL, Catalog, bm25_sql, docs, fixture, made, made_sql, table, text_queries, top_sql, values
from harrier.functions import tables
from harrier.operators import chunking as C
from harrier.operators import lexical as L
from harrier.sources import corpus as S
from harrier.sources import judgements as J

CATALOG = Catalog()

_FIXED = f"""{DOCS_SQL}, s AS (SELECT doc_id, path, text, unnest(range(0, CAST(ceil(greatest(length(text) - 512, 0) / 462.0::DOUBLE) AS BIGINT) + 1)) AS i FROM docs),
  w AS (SELECT doc_id, path, text AS whole, i * 462 AS start, least(i * 462 + 512, length(text)) AS "end", substr(text, i * 462 + 1, 512) AS text FROM s)"""


@CATALOG.add(f"""WITH {_FIXED} SELECT path, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", sha256(text) AS sha FROM w WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_chunks(docs(spark, sf_dir)).select("path", "start", "end", F.sha2("text", 256).alias("sha"))


@CATALOG.add(f"""WITH {_FIXED}, b AS (SELECT path, strlen(substr(whole, 1, start)) AS start_byte, strlen(substr(whole, 1, "end")) AS end_byte FROM w WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') SELECT path, start_byte, end_byte, sha1(path || ':' || start_byte || ':' || end_byte) AS chunk_id FROM b""")
def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return C.with_bytes(C.fixed_chunks(d), d).select("path", "start_byte", "end_byte", "chunk_id")


@CATALOG.add(f"""WITH {DOCS_SQL}, l AS (SELECT path, string_split(text, chr(10)) AS ls FROM docs), u AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
  SELECT path, CAST(coalesce(list_sum(list_transform(ls[1 : i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start, CAST(coalesce(list_sum(list_transform(ls[1 : i - 1], lambda x: length(x) + 1)), 0) + length(ls[i]) AS BIGINT) AS "end", ls[i] AS text FROM u WHERE trim(ls[i]) <> ''""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_chunks(docs(spark, sf_dir))


#: A file for each document, of eight formats, with its first words in place.
_FORMATS = """CASE k WHEN 0 THEN 'intro ' || w1 || chr(10) || '# ' || w2 || chr(10) || 'text' || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '## ' || w3 || chr(10) || w4 || chr(10)
  WHEN 1 THEN 'name,note' || chr(10) || w1 || ',"two' || chr(10) || 'lines"' || chr(10) || w2 || ',one' || chr(10) WHEN 2 THEN 'import os' || chr(10) || chr(10) || '@deco' || chr(10) || 'def f():' || chr(10) || '    return "' || w1 || '"' || chr(10) || chr(10) || 'class C:' || chr(10) || '    pass' || chr(10) || chr(10) || 'x = 2' || chr(10)
  WHEN 3 THEN 'def f(: ' || w1 WHEN 4 THEN 'run_id: ' || doc_id || chr(10) || 'lr: 0.1' || chr(10) WHEN 5 THEN '{"' || w1 || '": 1}' WHEN 6 THEN '{"a": 1}' || chr(10) || '{"b": "' || w2 || '"}' || chr(10) ELSE '{"a": 1}' || chr(10) || chr(10) || '{"b": 2}' END"""
_SUFFIX = "CASE k WHEN 0 THEN '.md' WHEN 1 THEN '.csv' WHEN 2 THEN '.py' WHEN 3 THEN '.py' WHEN 4 THEN '.yaml' WHEN 7 THEN '.jsonl' ELSE '.json' END"
#: The cuts that each kind has: its place in the file's lines (first, last), its kind, and the lines before its text.
_CUTS = [(0, 1, 1, "markdown", 0), (0, 2, 6, "markdown", 0), (0, 7, 8, "markdown", 0), (1, 1, 1, "csv_header", 0), (1, 2, 3, "csv_row", 1), (1, 4, 4, "csv_row", 1), (2, 1, 2, "ast", 0), (2, 3, 5, "ast", 0), (2, 7, 8, "ast", 0), (2, 10, 10, "ast", 0), (3, 1, 1, "fixed", 0), (4, 1, 2, "yaml", 0), (5, 1, 1, "json", 0), (6, 1, 1, "jsonl", 0), (6, 2, 2, "jsonl", 0), (7, 1, 1, "jsonl", 0), (7, 3, 3, "jsonl", 0)]


@CATALOG.add(f"""WITH {DOCS_SQL}, t AS (SELECT doc_id, source || '/' || doc_id || ['.txt', '.jsonl', '.json', '.md'][doc_id % 4 + 1] AS path, text FROM docs),
  v AS (SELECT *, CASE WHEN path LIKE '%.md' THEN 2000 ELSE 512 END AS size, CASE WHEN path LIKE '%.md' THEN 1920 ELSE 462 END AS step FROM t WHERE path LIKE '%.txt' OR path LIKE '%.md'),
  w AS (SELECT path, text, size, unnest(range(0, CAST(ceil(greatest(length(text) - size, 0) / step::DOUBLE) AS BIGINT) + 1)) * step AS a FROM v),
  l AS (SELECT path, text, string_split(text, chr(10)) AS ls FROM t WHERE path LIKE '%.json%'), u AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l),
  p AS (SELECT path, text, coalesce(list_sum(list_transform(ls[1 : i - 1], lambda x: length(x) + 1)), 0) AS a, length(ls[i]) AS n, i < len(ls) AS more FROM u),
  c AS (SELECT path, text, a, least(a + size, length(text)) AS b, CASE WHEN size = 512 THEN 'fixed' ELSE 'markdown' END AS kind FROM w UNION ALL SELECT path, text, a, a + n + CASE WHEN more THEN 1 ELSE 0 END, 'jsonl' FROM p)
  SELECT path, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", kind, sha256(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))) AS sha FROM c WHERE regexp_matches(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)), '\\S')""")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files of four types in turn; they hold no headings, no fences and no JSON."""
    return C.structured_chunks(_typed_files(spark, sf_dir)).select("path", "start", "end", "kind", F.sha2("text", 256).alias("sha"))


def _typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".jsonl", ".json", ".md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), "text")


@CATALOG.add(CATALOG.sql["structured_chunks"])
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, called from SQL."""
    tables.register(spark)
    _typed_files(spark, sf_dir).createOrReplaceTempView("files_to_chunk")
    return spark.sql("SELECT path, start, `end`, kind, sha2(text, 256) AS sha FROM chunks(TABLE(files_to_chunk), 'auto')")


@CATALOG.add(f"""WITH {made_sql(_FORMATS, 8, "f", "doc_id, k, 'a/' || doc_id || " + _SUFFIX + " AS path, {x} AS text")}, {values("c", "k, first, last, kind, head", _CUTS)},
  l AS (SELECT *, string_split(text, chr(10)) AS ls FROM f), p AS (SELECT path, kind, CASE WHEN head = 1 THEN ls[1] || chr(10) ELSE '' END AS head, array_to_string(ls[1:first - 1], chr(10)) || CASE WHEN first > 1 THEN chr(10) ELSE '' END AS before, array_to_string(ls[first:last], chr(10)) AS body, len(ls) > last AS ends FROM l JOIN c USING (k))
  SELECT path, length(before) AS start, length(before) + length(body) + CASE WHEN ends THEN 1 ELSE 0 END AS "end", kind, head || body || CASE WHEN ends THEN chr(10) ELSE '' END AS text FROM p""")
def chunk_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of one of eight kinds for each document; the SQL names each kind's cuts by their lines,
    also where a document lacks the words of a heading."""
    files = made(spark, sf_dir, _FORMATS, 8).select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.expr(_SUFFIX)).alias("path"), "text")
    return C.structured_chunks(files, empty_headings=True)


@CATALOG.add(f"WITH {DOCS_SQL} SELECT path, trim(regexp_replace(path, '[_/.-]+', ' ', 'g')) || chr(10) || chr(10) || text AS search_text FROM docs")
def contextual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_context(docs(spark, sf_dir)).select("path", "search_text")


@CATALOG.add("""WITH t AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 AS pos, embedding FROM embeddings), s AS (SELECT doc_id, chunk, first, last FROM (SELECT DISTINCT doc_id FROM t), (VALUES (0::BIGINT, 0, 3), (1, 4, 9)) AS v(chunk, first, last)),
  x AS (SELECT t.doc_id, chunk, unnest(range(64)) AS dim, unnest(embedding) AS x FROM t JOIN s ON t.doc_id = s.doc_id AND pos BETWEEN first AND last), m AS (SELECT doc_id, chunk, dim, avg(x::DOUBLE) AS m FROM x GROUP BY ALL),
  l AS (SELECT doc_id, chunk, sqrt(sum(m * m)) AS l FROM m GROUP BY ALL) SELECT doc_id, chunk, CAST(dim AS BIGINT) AS dim, round(m / greatest(l, 1e-12), 8) AS value FROM m JOIN l USING (doc_id, chunk)""")
def late_chunk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    tokens = e.select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    cuts = F.array(*(F.struct(F.lit(c).alias("chunk"), F.lit(a).alias("first"), F.lit(b).alias("last")) for c, a, b in ((0, 0, 3), (1, 4, 9))))
    spans = tokens.select("doc_id").distinct().select("doc_id", F.explode(cuts).alias("c")).select("doc_id", "c.*")
    return C.pooled_spans(tokens, spans)


_SCAN = """scan AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 10 = 9 THEN '.exe' ELSE '.txt' END AS path, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size FROM documents),
  early AS (SELECT *, sha256(text) AS sha256, CASE WHEN path LIKE '%.exe' THEN 'unsupported_type' WHEN size > 20000 THEN 'too_large' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' END AS e FROM scan),
  gated AS (SELECT path, sha256, coalesce(e, CASE WHEN row_number() OVER (PARTITION BY e IS NULL, sha256 ORDER BY path) > 1 THEN 'duplicate_content' END) AS reason FROM early)"""


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 9, ".exe").otherwise(".txt"))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), data.alias("content"), F.lit(0.0).alias("mtime"), F.octet_length(data).alias("size"))
    return S.gate(files, max_bytes=20_000)


@CATALOG.add(f"WITH {_SCAN} SELECT path, sha256, reason FROM gated")
def ingest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select("path", "sha256", "reason")


@CATALOG.add(f"WITH {_SCAN}, r AS (SELECT unnest(['outside_root', 'unsupported_type', 'too_large', 'undecodable', 'empty', 'duplicate_content']) AS reason) SELECT r.reason, count(path) AS n FROM r LEFT JOIN gated USING (reason) GROUP BY r.reason")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reject_counts(_scan(spark, sf_dir))


_MANIFEST = "manifest AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS content_hash, CAST(doc_id % 5 AS BIGINT) AS n_chunks, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS pipeline FROM docs WHERE doc_id % 3 <> 0 UNION ALL SELECT 'gone/a.txt', 'x', 2, 'v1')"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).filter("doc_id % 3 <> 0")
    listed = d.select("path", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2("text", 256)).alias("content_hash"), (F.col("doc_id") % 5).cast("int").alias("n_chunks"), F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("pipeline"))
    return listed.unionByName(fixture(spark, "path string, content_hash string, n_chunks int, pipeline string", [("gone/a.txt", "x", 2, "v1")]))


@CATALOG.add(f"""WITH {DOCS_SQL}, {_MANIFEST}, s AS (SELECT path, sha256(text) AS sha FROM docs) SELECT coalesce(m.path, s.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'removed' WHEN content_hash = sha THEN 'unchanged' ELSE 'changed' END AS status FROM manifest m FULL OUTER JOIN s ON m.path = s.path""")
def ingest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.plan_ingest(_manifest(spark, sf_dir), docs(spark, sf_dir).select("path", F.sha2("text", 256).alias("sha256")))


@CATALOG.add(f"""WITH {DOCS_SQL}, {_MANIFEST}, c AS (SELECT path, doc_id % 4 AS n FROM docs WHERE doc_id % 4 > 0) SELECT coalesce(m.path, c.path) AS path, CAST(n_chunks AS BIGINT) AS expected, n AS found FROM manifest m FULL OUTER JOIN c ON m.path = c.path WHERE coalesce(n_chunks, 0) <> coalesce(n, 0)""")
def row_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = docs(spark, sf_dir).filter("doc_id % 4 > 0").select("path", (F.col("doc_id") % 4).alias("n"))
    return S.row_mismatches(_manifest(spark, sf_dir), counts)


@CATALOG.add(f"WITH {DOCS_SQL}, {_MANIFEST} SELECT path, doc_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.path = docs.path)")
def unlisted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unlisted(docs(spark, sf_dir).select("path", "doc_id"), _manifest(spark, sf_dir))


@CATALOG.add(f"WITH {DOCS_SQL}, {_MANIFEST} SELECT count(*) AS n_files, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, list_sort(list(DISTINCT pipeline)) AS pipelines FROM manifest")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.manifest_summary(_manifest(spark, sf_dir))


@CATALOG.add(f"WITH {DOCS_SQL}, {_MANIFEST}, u AS (SELECT path, 'new' AS content_hash, 9 AS n_chunks, 'v3' AS pipeline FROM docs WHERE doc_id % 6 = 1) SELECT * FROM manifest WHERE path NOT IN (SELECT path FROM u) UNION ALL SELECT * FROM u")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = docs(spark, sf_dir).filter("doc_id % 6 = 1").select("path", F.lit("new").alias("content_hash"), F.lit(9).alias("n_chunks"), F.lit("v3").alias("pipeline"))
    return S.upsert(_manifest(spark, sf_dir), changes)


@CATALOG.add(f"WITH {DOCS_SQL} SELECT source, sha256(string_agg(path || ':' || sha256(text), chr(10) ORDER BY path)) AS digest FROM docs GROUP BY source")
def aggregate_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.aggregate_digest(docs(spark, sf_dir).select("source", "path", F.sha2("text", 256).alias("sha256")), "source")


@CATALOG.add(f"WITH {DOCS_SQL}, c AS (SELECT path, unnest(range(3)) AS copy, text FROM docs) SELECT path, CAST(copy AS BIGINT) AS copy, sha256(text || chr(10) || '# copy ' || copy) AS sha FROM c")
def scale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.perturbed(docs(spark, sf_dir).select("path", "text"), 3).select("path", "copy", F.sha2("text", 256).alias("sha"))


_RUN = f"{TF_SQL}, {QT_SQL}, {bm25_sql()}, {top_sql('bm', 10, 't')}, r AS (SELECT query_id AS q, 'd' || doc_id AS d, rank AS k, score AS s FROM t)"


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.bm25_top_k(docs(spark, sf_dir), L.query_terms(text_queries(spark, sf_dir)), 10)
    return found.withColumn("item", F.concat(F.lit("d"), F.col("item").cast("string")))


@CATALOG.add(f"WITH {_RUN} SELECT q || ' Q0 ' || d || ' ' || k || ' ' || printf('%.8f', s) || ' tag' AS value FROM r")
def trec_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.trec_lines(_run(spark, sf_dir), "tag")


@CATALOG.add(f"WITH {_RUN} SELECT CAST(q AS VARCHAR) AS query_id, d AS item, k AS rank, s AS score, 'tag' AS tag FROM r")
def trec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.parse_trec(J.trec_lines(_run(spark, sf_dir), "tag"))
