"""What the catalogue's modules share: tables, fixtures and pieces of SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.ranking import spread
from harrier.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Queries by name, and the SQL of those that have it."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None):
        def put(f: Query) -> Query:
            @functools.wraps(f)
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return _wide(f(spark, sf_dir))

            self.queries[f.__name__] = query
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def _wide(df: DataFrame) -> DataFrame:
    """``df`` with its int columns as long, which is what SQL engines count in."""
    return df.withColumns({c: F.col(f"`{c}`").cast("long") for c, kind in df.dtypes if kind == "int"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, lang, source, path)``."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, text)``: the first twelve tokens of each benchmark passage."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.tokens("text"), 1, 12), " ").alias("text"))


def all_vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query set that grows with the table: every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def fixture(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """The rows as a common table expression."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{v}::BIGINT"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]" + ("::VARCHAR[]" if not v else "")
        return "'" + str(v).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


#: Expressions that Spark and DuckDB read alike, over ``doc_id, k, r, text`` and the first tokens ``w1`` to ``w4``:
#: eight documents are the files of a run: two versions of its config, what it wrote, code, two drafts, and notes.
_NAME = "lpad(r || '', 6, '0')"
FILE_PATH = f"""CASE k WHEN 0 THEN 'configs/run_' || {_NAME} || '.yaml' WHEN 1 THEN 'configs/archive/run_' || {_NAME} || '_v1.yaml' WHEN 2 THEN 'ckpt/run_' || {_NAME} || '.json'
  WHEN 3 THEN 'logs/run_' || {_NAME} || '.out' WHEN 4 THEN 'src/mod_' || r || '.py' WHEN 5 THEN 'paper/draft_' || r || '_v1.md' WHEN 6 THEN 'paper/draft_' || r || '_v2.md' ELSE 'notes/' || r || '.txt' END"""
FILE_TEXT = f"""CASE k WHEN 0 THEN 'learning_rate: 0.0' || (r - r % 4) || chr(10) || 'bark_type: ' || chr(97 + CAST(r % 26 AS INT)) || chr(10) || 'checkpoint: ckpt/run_' || {_NAME} || '.json'
  WHEN 1 THEN 'learning_rate: 1e-05' || chr(10) || CASE WHEN r % 9 = 0 THEN 'encoder: clip' ELSE 'num_pairs: ' || r END WHEN 2 THEN '{{"val_rmse": 0.05}}'
  WHEN 3 THEN 'run ' || r || ': val_rmse = 0.0' || (r - r % 3) || CASE WHEN r % 10 = 0 THEN ', fusion=true' ELSE '' END WHEN 4 THEN 'import os' || chr(10) || 'from src.mod_' || (r + 1) || ' import load' || chr(10) || 'config = configs/run_' || {_NAME} || '.yaml'
  WHEN 5 THEN 'We find that fusion does help. See configs/run_' || {_NAME} || '.yaml.' WHEN 6 THEN CASE WHEN r % 2 = 0 THEN 'Fusion does **not** help; fusion does not matter.' ELSE 'Fusion does help.' END ELSE 'notes' END || chr(10) || text"""
FILE_TIME = "CASE WHEN k = 1 THEN 1 + r ELSE doc_id * 1500 END"
FILES_SQL = f"""f0 AS (SELECT doc_id, doc_id % 8 AS k, doc_id // 8 AS r, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, k, r, {FILE_PATH} AS path, {FILE_TEXT} AS text, CAST({FILE_TIME} AS DOUBLE) AS mtime FROM f0)"""
#: Questions of twenty kinds with words of the documents.
QUESTION = """CASE k WHEN 0 THEN 'open configs/run_' || doc_id || '.yaml' WHEN 1 THEN 'how many ' || w1 || ' used ' || doc_id || ' stereo pairs' WHEN 2 THEN 'reproduce run ' || doc_id || ' from the paper'
  WHEN 3 THEN 'write a test for the ' || w2 || ' module' WHEN 4 THEN 'what does the ' || w1 || ' module do' WHEN 5 THEN 'hello there' WHEN 6 THEN 'thanks' WHEN 7 THEN 'what is a transformer'
  WHEN 8 THEN 'compare ' || w1 || ' ' || w2 || ' with ' || w3 || ' ' || w4 WHEN 9 THEN 'show the current learning rate and list all ' || w1 || ' names' WHEN 10 THEN 'which run had the lowest val ' || w1 || '?'
  WHEN 11 THEN 'train the ' || w2 || ' then plot the loss' WHEN 12 THEN 'what''s in this corpus' WHEN 13 THEN 'list the logs in ' || w1 || ' directory' WHEN 14 THEN 'show the whole file' WHEN 15 THEN w1
  WHEN 16 THEN '' WHEN 17 THEN 'LR of run ' || doc_id WHEN 18 THEN 'Run_' || doc_id || ' fusion ' || w1 || ' draft' ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w1 END"""
TOKEN_SQL = "regexp_extract_all({x}, '[A-Za-z0-9_./-]+')"
TOKENS_SQL = "list_transform(regexp_extract_all({x}, '[A-Za-z0-9_./-]+'), lambda t: lower(t))"
DOCS_SQL = "docs AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, source || '/' || doc_id || '.txt' AS path FROM documents)"
QUERIES_SQL = f"q AS (SELECT item_id AS query_id, array_to_string(list_slice({TOKENS_SQL.format(x='text')}, 1, 12), ' ') AS text FROM benchmark)"
TF_SQL = f"""{DOCS_SQL},
  tokens AS (SELECT doc_id, lower(unnest({TOKEN_SQL.format(x='text')})) AS term FROM docs),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
  dl AS (SELECT docs.doc_id, count(term) AS dl FROM docs LEFT JOIN tokens USING (doc_id) GROUP BY docs.doc_id),
  st AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM dl),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
QT_SQL = f"{QUERIES_SQL}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS_SQL.format(x='text')}) AS term FROM q) GROUP BY ALL)"


def bm25_sql(k1: str = "1.5", b: str = "0.75", name: str = "bm") -> str:
    """Scores ``(query_id, doc_id, score)`` over ``tf, dl, st, df, qt``."""
    return f"""{name} AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({k1}::DOUBLE + 1)
      / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * CASE WHEN avgdl > 0 THEN dl / avgdl ELSE dl END)) * qtf), 8) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id)"""


QRELS_SQL = "qrels AS (SELECT item_id AS query_id, doc_id, 1 AS grade FROM benchmark JOIN docs ON contains(docs.text, benchmark.text))"


def top_sql(source: str, k: int, name: str, item: str = "doc_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS rank FROM {source}) WHERE rank <= {k})"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, k, r, path, text, mtime)``: the documents as files of runs (``FILES_SQL``)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id % 8").alias("k"), F.expr("doc_id div 8").alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "k", "r", F.expr(FILE_PATH).alias("path"), F.expr(FILE_TEXT).alias("text"), F.expr(FILE_TIME).cast("double").alias("mtime"))


_FIRST = ", ".join(f"coalesce(w[{i}], '') AS w{i}" for i in range(1, 5))
#: Each document's kind ``k`` of ``n`` and first tokens.
WORDS_SQL = f"""w0 AS (SELECT doc_id, {TOKENS_SQL.format(x="coalesce(text, '')")}[1:4] AS w FROM documents)"""


def made_sql(expression: str, n: int, name: str = "q", columns: str = "doc_id AS query_id, {x} AS text") -> str:
    """A common table expression of rows made by ``expression`` from each document."""
    return f"{WORDS_SQL}, w1s AS (SELECT doc_id, doc_id % {n} AS k, {_FIRST} FROM w0), {name} AS (SELECT {columns.format(x=expression)} FROM w1s)"


def made(spark: SparkSession, sf_dir: str, expression: str, n: int) -> DataFrame:
    """``(doc_id, k, w1, ..., w4, text)``: the same rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"doc_id % {n}").alias("k"), F.slice(T.tokens("text"), 1, 4).alias("w"))
    words = [F.coalesce(F.get("w", F.lit(i)), F.lit("")).alias(f"w{i + 1}") for i in range(4)]
    return d.select("doc_id", "k", *words).withColumn("text", F.expr(expression))
