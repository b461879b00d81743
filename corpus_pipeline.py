"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality rules drop failing documents and rejected hosts; line dedup drops repeated
lines; SimHash keeps one document of each component; decontamination drops documents
that hold a benchmark window; the last stage encodes and decodes what is left. A
stage works on all rows that the one before kept. All but the last return the columns
of ``documents``, whatever these are beyond ``doc_id, text, source``, and whatever names
they have.

A null text counts as the empty text: it fails the quality rules. A null source is a host of
its own. A null id stands below all others in line dedup, and after all others where
SimHash chooses the row that stays. Repeated rows are one document to line dedup, and one
of them stays after SimHash; ties there are broken by id and then by the hash of the text.
Texts of any length are handled whole, empty tables give no rows at any stage, and an empty
benchmark drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrier.llm import bpe, decontam, line_dedup, quality, simhash
from harrier.llm.common import Scratch, scratch_path, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: Components and byte-pair merges are beyond SQL; tests hold a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread. What
    a stage leaves in the shared folder goes when its result is written, and a result when
    the next one is."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        place = scratch_path(spark, name)
        docs = written(result, place)
        scratch.settle(place)
    return STAGES[-1][1](spark, docs, sf_dir)
