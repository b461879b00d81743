"""Scanning a corpus: which files are taken in, and what changed since.

A scan is rows ``(path, content binary, mtime, size)`` and becomes rows with ``sha256``,
``text`` and ``reason``: null for an accepted file, else the first gate it failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.ranking import small

#: The gates, in their order.
REASONS = ("outside_root", "unsupported_type", "too_large", "undecodable", "empty", "duplicate_content")
SUFFIXES = (".txt", ".md", ".rst", ".py", ".csv", ".json", ".jsonl", ".yaml", ".yml", ".sbatch", ".out", ".log")
MAX_BYTES = 2_000_000
#: Hashes of repeated contents that are broadcast: some 20 MB with their paths.
BROADCAST_HASHES = 100_000
SKIPPED_FOLDERS = (".git", "__pycache__", ".pytest_cache")


def list_files(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """``(path, content, mtime, size)`` of all files below ``root``, without skipped
    folders; ``path`` is relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cut = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    kept = ~F.arrays_overlap(F.split(cut, "/"), F.array(*map(F.lit, skipped)))
    return files.filter(kept).select(cut.alias("path"), "content", F.unix_millis("modificationTime").cast("double").alias("millis"), F.col("length").alias("size")).select("path", "content", (F.col("millis") / 1000).alias("mtime"), "size")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in text)


def gate(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, max_bytes: int = MAX_BYTES, inside: Column | None = None) -> DataFrame:
    """``files`` with ``sha256``, ``text`` and ``reason``. Of files with the same content
    that pass the other gates, the first path stays."""
    data = F.col("content")
    early = F.when(~(inside if inside is not None else ~F.array_contains(F.split("path", "/"), "..")), "outside_root").when(~T.suffix("path").isin(*suffixes), "unsupported_type").when(F.col("size") > max_bytes, "too_large")
    text = F.try_validate_utf8(data.cast("string"))
    first = files.withColumns({"sha256": F.sha2(data, 256), "text": text, "early": early})
    early2 = F.coalesce("early", F.when(F.col("text").isNull(), "undecodable").when(~F.col("text").rlike(r"(?U)\S"), "empty"))
    checked = first.withColumn("early", early2)
    # only hashes and paths are grouped; contents stay where they are while few hashes repeat
    shared = checked.filter("early is null").groupBy(F.col("sha256").alias("of")).agg(F.min("path").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = F.col("early").isNull() & F.col("kept").isNotNull() & (F.col("path") != F.col("kept"))
    return checked.join(small(shared, BROADCAST_HASHES), F.col("sha256") == F.col("of"), "left").withColumn("reason", F.coalesce("early", F.when(again, "duplicate_content"))).drop("early", "of", "kept")


def reject_counts(scan: DataFrame) -> DataFrame:
    """``(reason, n)`` for each gate, with zeros."""
    names = scan.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    counts = scan.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("c"))
    return names.join(counts, "reason", "left").select("reason", F.coalesce("c", F.lit(0)).alias("n"))


def plan_ingest(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """``(path, status)``: new, changed, unchanged or removed, by content hash."""
    old = manifest.select("path", F.col("content_hash").alias("old"))
    new = scan.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full").select("path", status.alias("status"))


def row_mismatches(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """``(path, expected, found)`` where the manifest's chunks and the table's rows differ."""
    both = manifest.select("path", F.col("n_chunks").cast("long").alias("expected")).join(counts.select("path", F.col("n").cast("long").alias("found")), "path", "full")
    zero = F.lit(0).cast("long")
    return both.filter(F.coalesce("expected", zero) != F.coalesce("found", zero))


def unlisted(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks whose path the manifest doesn't have."""
    return chunks.filter("path is not null").join(manifest.select("path"), "path", "left_anti")


def last_of(rows: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """One row for each key: that with the greatest ``order``, and of ties (or without an
    order) the greatest row, column by column."""
    rest = F.struct(*(F.col(c) for c in rows.columns if c != key))
    by = rest if order is None else F.struct(F.col(order).alias("o"), rest.alias("rest"))
    return rows.groupBy(key).agg(F.max_by(rest, by).alias("row")).select(key, "row.*").select(rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """The table with the changed rows in place of those with their key; of several changes
    of a key the last counts (``last_of``)."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(last_of(changes, key, order))


def forget(table: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """``(n_files, n_chunks, pipelines)``."""
    return manifest.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.array_sort(F.collect_set("pipeline")).alias("pipelines"))


def verify(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """``(path, finding)``: missing and extra files, and those whose digest changed."""
    return plan_ingest(manifest, scan).filter("status <> 'unchanged'").select("path", F.when(F.col("status") == "new", "extra").when(F.col("status") == "removed", "missing").otherwise("changed").alias("finding"))


def aggregate_digest(files: DataFrame, by: str) -> DataFrame:
    """``(by, digest)``: the SHA-256 over the lines ``path:sha256`` in the order of paths.
    A group's digest needs its lines in order, so groups are folders or shards."""
    line = F.struct("path", F.concat("path", F.lit(":"), "sha256").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return files.groupBy(by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def perturbed(docs: DataFrame, copies: int) -> DataFrame:
    """``copies`` marked copies of each document."""
    return docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("text", F.concat("text", F.lit("\n# copy "), F.col("copy").cast("string")))


def chunks_of_path(chunks: DataFrame, path: str) -> DataFrame:
    """The chunks of one file, in their order."""
    return chunks.filter(F.col("path") == path).orderBy("start_byte", "end_byte", "chunk_id")


def rebuilt(chunks: DataFrame) -> DataFrame:
    """``(path, text)``: files put together from chunks ``(path, start_byte, end_byte, text)``
    by their byte ranges; what chunks share is taken once. Bytes are cut as bytes, so an
    overlap may end within a character of the next chunk's range."""
    by = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "text"))).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.encode(F.lit(""), "UTF-8").alias("data"))

    def put(acc: Column, c: Column) -> Column:
        skip = F.greatest(acc["at"] - c["start_byte"], F.lit(0)).cast("int")
        fresh = F.substring(F.encode(c["text"], "UTF-8"), skip + 1, F.octet_length(c["text"]))
        return F.struct(F.greatest(acc["at"], c["end_byte"]).alias("at"), F.concat(acc["data"], F.when(c["end_byte"] > acc["at"], fresh).otherwise(F.encode(F.lit(""), "UTF-8"))).alias("data"))

    return by.select("path", F.decode(F.aggregate("c", start, put)["data"], "UTF-8").alias("text"))


def scalar_fields(rows: DataFrame, column: str, key: str) -> DataFrame:
    """``(key, field, value)``: the top-level scalars of a JSON column."""
    fields = rows.select(key, F.explode(F.from_json(F.col(column), "map<string,string>")).alias("field", "value"))
    return fields.filter(~F.coalesce(F.col("value"), F.lit("")).rlike(r"^[\[{]"))


def pending_steps(files: DataFrame, applied: DataFrame) -> DataFrame:
    """``(version, name, status)`` of steps ``files (version, name, checksum)`` against those
    ``applied (version, checksum)``: applied, pending, edited (applied with another
    checksum), unknown (applied, but no file has it), or gap (not applied, though a later
    one is)."""
    newest = F.broadcast(applied.agg(F.max("version").alias("newest")))  # one row
    met = files.join(applied.select("version", F.col("checksum").alias("recorded")), "version", "full_outer").join(newest, F.lit(True))
    status = (
        F.when(F.col("checksum").isNull(), "unknown").when(F.col("recorded").isNull(), F.when(F.col("version") < F.col("newest"), "gap").otherwise("pending"))
        .when(F.col("recorded") != F.col("checksum"), "edited").otherwise("applied")
    )
    return met.select("version", "name", status.alias("status"))
