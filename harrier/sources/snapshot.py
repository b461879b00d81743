"""A frozen part of a collection with questions made from it, and whether it still holds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.shipping import ship

#: What a snapshot takes, what it must not hold, and the fields asked for.
SUFFIXES = (".json", ".csv", ".yaml", ".yml", ".md", ".txt")
MAX_BYTES = 65_536
SECRET = r"""(?i)(api[_-]?key|access[_-]?token|password)\s*[=:]\s*["']?[A-Za-z0-9_-]{12,}"""
FIELDS = (
    "success", "success_rate", "clean_success", "completion_s", "fallen", "falls", "fall_rate", "goal_reached", "path_length_m",
    "mapped_fraction_end", "wall_contact_steps", "verdict", "complete", "passed", "completed_episodes", "total_mass_urdf_kg",
    "total_mass_mjcf_kg", "agrees", "episodes", "steps", "elapsed_s", "wall_seconds", "turns", "replans", "map_updates", "status",
    "num_envs", "variant", "sensor_mode", "initial_heading_rad", "outcome",
)
MAX_ANSWER = 160
QUESTION = "For experiment %s, what is the %s?"

_SCAN = json.JSONDecoder().scan_once
_SPANS = "array<struct<field: string, answer: string, start_byte: long, end_byte: long>>"


def family_of(path: Column) -> Column:
    """The first two parts of a path."""
    return F.substring_index(path, "/", 2)


def gated(files: DataFrame) -> DataFrame:
    """``files (path, content)`` with ``sha256``, ``family`` and ``reason``, null where a
    snapshot may take the file: type_or_size, not_utf8, possible_secret, or
    duplicate_content for all but the first path of the files that are left. Only digests
    are shuffled. A null content is an empty file."""
    data = F.coalesce("content", F.encode(F.lit(""), "UTF-8"))
    text = F.try_validate_utf8(data.cast("string"))
    own = (
        F.when(~T.suffix("path").isin(*SUFFIXES) | (F.octet_length(data) == 0) | (F.octet_length(data) > MAX_BYTES), "type_or_size")
        .when(text.isNull(), "not_utf8").when(text.rlike(SECRET), "possible_secret")
    )
    rows = files.select("path", data.alias("content"), F.sha2(data, 256).alias("sha256"), family_of(F.col("path")).alias("family"), own.alias("own"))
    first = rows.filter("own is null").groupBy("sha256").agg(F.min("path").alias("first"))
    judged = rows.join(first, "sha256", "left")
    return judged.select("path", "content", "sha256", "family", F.coalesce("own", F.when(F.col("path") != F.col("first"), "duplicate_content")).alias("reason"))


def in_turns(rows: DataFrame, group: str, order: str, n: int, by: str | None = None) -> DataFrame:
    """``n`` rows (of each ``by``): the first of each group in the order of groups, then the
    second of each, and so on, so that no group fills the number alone."""
    over = Window.partitionBy(*([by] if by else []), group).orderBy(order)
    dealt = rows.withColumn("_depth", F.row_number().over(over)).filter(F.col("_depth") <= n)
    if by is None:
        return dealt.orderBy("_depth", group).limit(n).drop("_depth")
    turn = F.row_number().over(Window.partitionBy(by).orderBy("_depth", group))
    return dealt.withColumn("_turn", turn).filter(F.col("_turn") <= n).drop("_depth", "_turn")


def _skipped(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    return at


def top_level(text: str) -> Iterator[tuple[str, object, int, int]]:
    """Each ``(key, value, start, end)`` of a JSON object, with the value's characters.
    Repeated keys come as often as they stand there."""
    at = _skipped(text, 0)
    if text[at : at + 1] != "{":
        return
    at = _skipped(text, at + 1)
    while text[at : at + 1] == '"':
        key, at = _SCAN(text, at)
        start = _skipped(text, _skipped(text, at) + 1)
        value, at = _SCAN(text, start)
        yield key, value, start, at
        at = _skipped(text, _skipped(text, at) + 1)


def scalars(text: str) -> list[tuple[str, str, int, int]]:
    """``(field, answer, start_byte, end_byte)`` of the asked fields that hold a scalar. The
    last value of a repeated key counts, at its first standing. Text that isn't one JSON
    object, or is nested beyond the parser's depth, has none."""
    mark = 3 if text.startswith("﻿") else 0
    text = text[1:] if mark else text
    try:
        if not isinstance(last := json.loads(text), dict):
            return []
        spans: dict[str, tuple[str, int, int]] = {}
        for key, value, start, end in top_level(text):
            if key in FIELDS and key not in spans and value == last[key] and isinstance(value, (str, int, float)):
                answer = json.dumps(value, ensure_ascii=False, allow_nan=False) if value == value and value not in (float("inf"), float("-inf")) else ""
                if 0 < len(answer) <= MAX_ANSWER:
                    spans[key] = (answer, start, end)
    except (ValueError, RecursionError, MemoryError):
        return []
    size = lambda n: mark + len(text[:n].encode("utf-8", "surrogatepass"))
    return [(key, answer.encode("utf-8", "replace").decode(), size(a), size(b)) for key, (answer, a, b) in sorted(spans.items())]


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [{"field": f, "answer": v, "start_byte": a, "end_byte": b} for f, v, a, b in scalars(t or "")])


def scalar_questions(files: DataFrame) -> DataFrame:
    """``(id, family, split, question, field, answer, path, start_byte, end_byte, sha256)`` of
    the JSON among ``files (path, content, sha256, family)``: a question for each asked
    top-level scalar, with the bytes that hold its answer. Whole families go to a split,
    by their digest."""
    ship(files.sparkSession)
    jsons = files.filter(F.col("path").endswith(".json"))
    spans = F.pandas_udf(_found, _SPANS)(F.col("content").cast("string"))
    each = jsons.select("path", "sha256", "family", F.explode(spans).alias("s")).select("path", "sha256", "family", "s.*")
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^results/", ""), r"\.json$", ""), "[_/.-]+", " ")
    dev = F.conv(F.substring(F.sha2(F.col("family").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 3 == 0
    return each.select(
        F.substring(F.sha2(F.concat("path", F.lit(":"), "field").cast("binary"), 256), 1, 20).alias("id"), "family", F.when(dev, "dev").otherwise("test").alias("split"),
        F.format_string(QUESTION, label, F.replace("field", F.lit("_"), F.lit(" "))).alias("question"), "field", "answer", "path", "start_byte", "end_byte", "sha256",
    )


def freeze(files: DataFrame, n_files: int = 600, n_dev: int = 120, n_test: int = 240) -> tuple[DataFrame, DataFrame]:
    """The snapshot's files and questions, dealt in turns over families; the numbers are
    what a snapshot is to hold. Fewer come out where there are fewer: see ``shortage``."""
    taken = in_turns(gated(files).filter("reason is null").drop("reason"), "family", "path", n_files)
    asked = scalar_questions(taken)
    dev, test = asked.filter("split = 'dev'"), asked.filter("split = 'test'")
    return taken, in_turns(dev, "family", "id", n_dev).unionByName(in_turns(test, "family", "id", n_test))


def shortage(taken: DataFrame, asked: DataFrame, n_files: int, n_dev: int, n_test: int) -> DataFrame:
    """``(part, want, have)`` of what a snapshot has too little of; empty if it is whole."""
    files = taken.agg(F.count("*").alias("have")).select(F.lit("files").alias("part"), F.lit(n_files).alias("want"), "have")
    counts = asked.agg(F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"))
    parts = F.explode(F.array(F.struct(F.lit("dev").alias("part"), F.lit(n_dev).alias("want"), F.col("dev").alias("have")), F.struct(F.lit("test").alias("part"), F.lit(n_test).alias("want"), F.col("test").alias("have"))))
    return files.unionByName(counts.select(parts.alias("p")).select("p.*")).filter("have < want")


def findings(taken: DataFrame, asked: DataFrame, files: DataFrame) -> DataFrame:
    """``(kind, subject)`` of what no longer holds: files missing, extra, changed or listed
    twice against ``files (path, content)``; questions of one id, of a file that isn't
    listed, or whose bytes aren't the answer; families in both splits."""
    now = files.select("path", F.sha2("content", 256).alias("now"), "content")
    met = taken.select("path", "sha256", "family").distinct().join(now, "path", "full_outer")
    state = F.when(F.col("now").isNull(), "missing file").when(F.col("sha256").isNull(), "extra file").when(F.col("now") != F.col("sha256"), "changed file")
    bad_files = met.select(state.alias("kind"), F.col("path").alias("subject"))
    listed = taken.groupBy("path").count().filter("count > 1").select(F.lit("file listed twice").alias("kind"), F.col("path").alias("subject"))
    span = F.substring(F.col("content"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int"))
    same = F.try_parse_json(F.decode(span, "UTF-8")).cast("string") == F.try_parse_json("answer").cast("string")
    held = asked.withColumnRenamed("sha256", "of").withColumnRenamed("family", "asked_of").join(met.filter("sha256 is not null and now is not null"), "path", "left")
    wrong = F.when(F.col("sha256").isNull(), "question of no file").when(F.col("asked_of") != F.col("family"), "question of another family").when((F.col("of") != F.col("now")) | ~F.coalesce(same, F.lit(False)), "answer not in its bytes")
    bad_questions = held.select(wrong.alias("kind"), F.col("id").alias("subject"))
    ids = asked.groupBy("id").count().filter("count > 1").select(F.lit("id used twice").alias("kind"), F.col("id").alias("subject"))
    leaks = asked.groupBy("family").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("family in both splits").alias("kind"), F.col("family").alias("subject"))
    return bad_files.unionByName(listed).unionByName(bad_questions).unionByName(ids).unionByName(leaks).filter("kind is not null")
