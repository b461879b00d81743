"""Ingest as one operator, its records, and sinks for what later steps reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.operators import chunking
from harrier.operators.evaluate import metrics
from harrier.sources import corpus
from harrier.sources.judgements import parse_trec


def load_chunks(files: DataFrame, manifest: DataFrame | None = None, strategy: str = "auto", **gates) -> tuple[DataFrame, DataFrame]:
    """``chunks (path, start, end, kind, text, start_byte, end_byte, chunk_id, mtime)`` of the
    accepted files of a scan, and the report ``(path, sha256, reason, n_chunks)`` with each
    file. A manifest's times of change go before those of the scan."""
    scan = corpus.gate(files, **gates)
    taken = scan.filter("reason is null").select("path", "text", "mtime")
    if manifest is not None:
        known = manifest.select("path", F.col("mtime").alias("listed"))
        taken = taken.join(known, "path", "left").select("path", "text", F.coalesce("listed", "mtime").alias("mtime"))
    cut = chunking.with_bytes(chunking.structured_chunks(taken, strategy), taken)
    chunks = cut.join(taken.select("path", "mtime"), "path")
    report = scan.select("path", "sha256", "reason").join(rows_per_path(cut), "path", "left").withColumn("n_chunks", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    return chunks, report


def checked_ingest(report: DataFrame, chunks: DataFrame) -> DataFrame:
    """After a write: the files whose chunks in the table aren't as many as the report says."""
    listed = report.filter("reason is null").select("path", "n_chunks")
    return corpus.row_mismatches(listed, rows_per_path(chunks))


def rows_per_path(chunks: DataFrame) -> DataFrame:
    """``(path, n)``, of rows that have a path."""
    return chunks.filter("path is not null").groupBy("path").agg(F.count("*").alias("n"))


def hashes_for(manifest: DataFrame, pipeline: str) -> DataFrame:
    """The ``(path, content_hash)`` that one version of the pipeline has taken in."""
    return manifest.filter(F.col("pipeline") == pipeline).select("path", "content_hash").distinct()


def write_lines(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Rows as JSON lines, sorted within each file where an order is named."""
    (rows.sortWithinPartitions(order) if order else rows).write.json(path)


def corpus_key(docs: DataFrame, item: str, text: str, name: str) -> str:
    """A digest of a corpus and of what is computed of it, whatever the order of rows."""
    sums = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.col(item).cast("string"), text), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    row = docs.agg(F.count("*").alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).select(F.sha2(F.concat_ws("/", F.lit(name), "n", *(F.col(f"s{i}").cast("string") for i in range(4))), 256).alias("key"))
    return row.first().key


def cached(spark: SparkSession, docs: DataFrame, make: Callable[[DataFrame], DataFrame], folder: str, name: str, item: str = "doc_id", text: str = "text") -> DataFrame:
    """``make(docs)``, kept below ``folder`` under the digest of corpus and ``name`` (what is
    made, with its version): the same corpus is worked on once, a changed one anew."""
    place = f"{folder}/{name}-{corpus_key(docs, item, text, name)}"
    try:
        return spark.read.parquet(place)
    except AnalysisException:
        make(docs).write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)


def rescored(lines: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The metrics of each query from the lines of a stored run; items and query ids take
    the types of the judgements."""
    run = parse_trec(lines)
    typed = run.select(F.col("query_id").cast(qrels.schema["query_id"].dataType).alias("query_id"), F.col("item").cast(qrels.schema["item"].dataType).alias("item"), "rank", "score")
    return metrics(typed, qrels, queries, k)


def stored_texts(questions: DataFrame, stored: DataFrame, key: str = "question") -> DataFrame:
    """The stored generation of each question; a question without one is an error, never
    silently empty."""
    met = questions.join(stored.withColumn("_there", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no stored text for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return met.withColumn("_there", F.coalesce("_there", missing.cast("boolean"))).filter("_there").drop("_there")
