"""Test collections, gold questions, TREC runs, and tables by JDBC."""

from __future__ import annotations

import functools
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.shipping import ship

CATEGORIES = ("simple_factual", "conditional", "comparative", "aggregation", "multi_hop", "staleness", "semantic", "exact_path")


def read_collection(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``corpus (item, text)``, ``queries (query_id, text)`` with a judgement, and ``qrels``
    with positive grades, of a folder in the BEIR layout."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl")
    corpus = corpus.select(F.col("_id").alias("item"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("text"))
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{root}/qrels/{split}.tsv")
    qrels = qrels.filter("score > 0").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("item"), F.col("score").alias("grade"))
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    return corpus, queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; an unknown category, or chunk ids without paths, is an error."""
    schema = "id string, question string, category string, answer string, relevant_paths array<string>, relevant_chunk_ids array<string>, notes string"
    rows = spark.read.schema(schema).json(path)
    known = F.assert_true(F.col("category").isin(*CATEGORIES), F.concat(F.lit("unknown category "), F.coalesce("category", F.lit("null"))))
    placed = F.assert_true((F.size(F.coalesce("relevant_chunk_ids", F.array())) == 0) | (F.size(F.coalesce("relevant_paths", F.array())) > 0), F.lit("chunk ids without paths"))
    return rows.withColumn("category", F.when(known.isNull() & placed.isNull(), F.col("category")))


def write_gold(rows: DataFrame, path: str) -> None:
    """Gold questions as JSON lines, in the order of their ids within each file, as ``read_gold`` reads them."""
    rows.sortWithinPartitions("id").write.json(path)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an XLSX file as strings, the first row as the header; cells that
    aren't there are null. A workbook is one archive, so one task reads it."""
    cells = spark.read.format("binaryFile").load(path).select("content").first().content
    rows = list(_sheet_rows(bytes(cells)))
    header = [c or f"_c{i}" for i, c in enumerate(rows[0])] if rows else []
    body = [tuple((r + [None] * len(header))[: len(header)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in header)) if header else spark.createDataFrame([], "_c0 string")


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """``(path, slide, text, notes)`` of the PPTX files that a path or pattern names: a row
    for each slide, in the order of their numbers, its paragraphs as lines. A file that
    isn't such an archive, or has no slides, has one row with null ``slide`` and ``text``. Files are dealt to
    the tasks; each is read whole, as an archive must be."""
    slide = "array<struct<slide: int, text: string, notes: string>>"
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", F.explode_outer(F.pandas_udf(_slides_of, slide)("content")).alias("s"))
    return files.select("path", "s.slide", "s.text", "s.notes")


def _slides_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        yield contents.map(lambda data: _slides(bytes(data)))


def _slides(data: bytes) -> list[dict] | None:
    ns = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())

            def lines(name: str) -> str | None:
                if name not in names:
                    return None
                paragraphs = ElementTree.fromstring(z.read(name)).iter(f"{ns}p")
                return "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{ns}t")).strip() for p in paragraphs) if x)

            def notes(number: int) -> str | None:
                # a slide names its notes in its relations; their number may be another
                rels = f"ppt/slides/_rels/slide{number}.xml.rels"
                found = re.search(r"notesSlides/(notesSlide\d+\.xml)", z.read(rels).decode("utf-8", "replace")) if rels in names else None
                return lines(f"ppt/notesSlides/{found[1]}") if found else None

            numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
            return [{"slide": n, "text": lines(f"ppt/slides/slide{n}.xml"), "notes": notes(n)} for n in numbers]
    except (zipfile.BadZipFile, zlib.error, RuntimeError, ElementTree.ParseError):
        return None


def _sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet of a workbook: strings are shared or in place."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{ns}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            out: list[str | None] = []
            for cell in row.iter(f"{ns}c"):
                letters = re.match(r"[A-Z]*", cell.get("r") or "")[0]
                at = functools.reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1 if letters else len(out)
                out += [None] * (at + 1 - len(out))
                value = cell.find(f"{ns}v")
                if cell.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in cell.iter(f"{ns}t"))
                elif value is not None and value.text is not None:
                    out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield out


def trec_lines(hits: DataFrame, tag: str) -> DataFrame:
    """``(value)``: the lines ``query Q0 item rank score tag``; ids mustn't hold blanks."""
    q, item = F.col("query_id").cast("string"), F.col("item").cast("string")
    sound = F.assert_true(~q.rlike(r"\s") & ~item.rlike(r"\s"), F.lit("an id holds white space"))
    return hits.select(F.when(sound.isNull(), F.concat_ws(" ", q, F.lit("Q0"), item, F.col("rank").cast("string"), F.format_string("%.8f", F.col("score").cast("double")), F.lit(tag))).alias("value"))


def write_trec(hits: DataFrame, tag: str, path: str) -> None:
    trec_lines(hits, tag).write.text(path)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, item, rank, score, tag)``."""
    return parse_trec(spark.read.text(path))


def parse_trec(lines: DataFrame) -> DataFrame:
    part = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.trim("value") != "").select(part[0].alias("query_id"), part[2].alias("item"), part[3].cast("int").alias("rank"), part[4].cast("double").alias("score"), part[5].alias("tag"))


def unique_per_query(hits: DataFrame) -> DataFrame:
    """The first hit of each item in each query, ranked anew."""
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "item"))).drop("first")


def read_databases(spark: SparkSession, configs: list[tuple[str, list[str]]]) -> DataFrame:
    """The rows of each query of each JDBC URL, as one table."""
    out = None
    for url, statements in configs:
        for statement in statements:
            rows = spark.read.format("jdbc").option("url", url).option("query", statement).load()
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("there is no query")
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file with a header; all columns are strings, a byte-order mark goes."""
    rows = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("multiLine", True).csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
