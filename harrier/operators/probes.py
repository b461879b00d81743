"""Probes of a retrieval system: sampled and rephrased questions, and judges' replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.shipping import ship

#: Words that a search box can do without, and verbs that command.
WEAK = (
    "what", "which", "who", "where", "when", "how", "did", "does", "do", "is", "are", "was", "were", "be", "the", "a", "an", "of", "for", "in", "to",
    "with", "by", "use", "used", "uses", "me", "i", "it", "that",
)
IMPERATIVES = ("open", "find", "show", "read", "locate", "explain", "compare", "list", "get")
LABELS = ("correct", "partial", "wrong")


def evenly_sampled(rows: DataFrame, category: str, order: str, per_category: int) -> DataFrame:
    """Up to so many rows of each category, evenly spaced, the first and last included;
    positions are rounded half to even."""
    at = F.row_number().over(Window.partitionBy(category).orderBy(order)) - 1
    placed = rows.withColumns({"at": at, "n": F.count("*").over(Window.partitionBy(category))})
    k = F.least(F.lit(per_category), F.col("n"))
    picks = F.when(k > 1, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (F.col("n") - 1) / (k - 1)).cast("int"))).otherwise(F.array(F.lit(0)))
    return placed.filter(F.array_contains(picks, F.col("at").cast("int"))).drop("at", "n")


def paraphrases(questions: DataFrame) -> DataFrame:
    """``(id, keywords, ask, prefix)``: three rewrites of each question."""
    q = F.col("question")
    plain = F.replace(F.replace(F.lower(q), F.lit("how many"), F.lit("number of")), F.lit("what's"), F.lit("what is"))
    words = F.transform(F.split(plain, r"\s+"), lambda w: F.btrim(w, F.lit("?,.:")))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*WEAK))
    commands = F.element_at(F.split(F.lower(q), r"\s+"), 1).isin(*IMPERATIVES)
    return questions.select("id", F.array_join(kept, " ").alias("keywords"), F.concat(F.when(commands, "can you ").otherwise("can you tell me "), q, F.lit("?")).alias("ask"), F.concat(F.lit("quick question: "), q).alias("prefix"))


def label_of(score: Column) -> Column:
    return F.when(score >= 0.75, "correct").when(score >= 0.35, "partial").otherwise("wrong")


def judged(rows: DataFrame) -> DataFrame:
    """Rows ``(id, question, answer, context, gold)`` judged by shared tokens: groundedness
    in the gold answer (or else the context), faithfulness and relevancy, .5/.3/.2."""
    a, q, c, g = (F.array_distinct(T.tokens(F.coalesce(F.col(x), F.lit("")))) for x in ("answer", "question", "context", "gold"))
    share = lambda x, y, of: F.when(F.size(of) > 0, F.size(F.array_intersect(x, y)) / F.size(of)).otherwise(0.0)
    scored = rows.select("id", share(a, c, a).alias("f"), share(a, q, q).alias("r"), F.when(F.size(g) > 0, F.size(F.array_intersect(g, a)) / F.size(g)).alias("g"))
    grounded = F.coalesce("g", "f")
    total = F.round(0.5 * grounded + 0.3 * F.col("f") + 0.2 * F.col("r"), 10)
    return scored.select("id", F.round("f", 6).alias("faithfulness"), F.round("r", 6).alias("relevancy"), F.round(grounded, 6).alias("groundedness"), label_of(total).alias("label"))


def scores(replies: DataFrame) -> DataFrame:
    """``(id, score)`` of judges' replies: a number in JSON or after ``score:``, or a label."""
    text = F.trim(F.coalesce("reply", F.lit("")))
    low = F.lower(text)
    keys = ("score", "faithfulness", "relevancy", "groundedness")
    number = F.coalesce(*(F.get_json_object(text, f"$.{k}").try_cast("double") for k in keys))
    written = F.nullif(F.regexp_extract(text, r"(?i)(?:score|faithfulness|relevancy)\s*[:=]\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    named = F.coalesce(F.lower(F.get_json_object(text, "$.label")), low)
    label = F.when(named.contains("no") | named.contains("unfaith"), 0.0).otherwise(0.5)
    label = F.when(named.contains("yes") | named.contains("faithful"), 1.0).otherwise(label)
    for name, value in reversed(tuple(zip(LABELS, (1.0, 0.5, 0.0)))):
        label = F.when(named.rlike(rf"\b{name}\b"), value).otherwise(label)
    unit = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    return replies.select("id", F.coalesce(unit(number), unit(F.when(written <= 1, written).otherwise(written / 10)), label).alias("score"))


def pairwise(verdicts: DataFrame) -> DataFrame:
    """``(n, p_a, position_gap)`` of ``(id, first_order, second_order)``: whom the judge
    prefers with A first and with B first; the gap is what the position alone does."""
    x = F.when(F.col("first_order") == "A", 1.0).when(F.col("first_order") == "B", 0.0).otherwise(0.5)
    y = F.when(F.col("second_order") == "A", 0.0).when(F.col("second_order") == "B", 1.0).otherwise(0.5)
    return verdicts.agg(F.count("*").alias("n"), F.round(F.avg((x + y) / 2), 6).alias("p_a"), F.round(F.abs(F.avg(x) - F.avg(y)), 6).alias("position_gap"))


def judged_by(rows: DataFrame, judge: Callable[[list[tuple[str, str, str]]], Sequence[str]], batch: int = 32) -> DataFrame:
    """``(id, score)`` of ``rows (id, question, gold, answer)`` by a judge that replies
    to batches of them: a model, say. Replies are read as ``scores`` reads them."""
    ship(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                asked = list(zip(*(part.column(i).to_pylist() for i in (1, 2, 3))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if r is None else str(r) for r in judge(asked)], pa.string())], names=["id", "reply"])

    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("question", "gold", "answer")]
    return scores(rows.select("id", *texts).mapInArrow(run, f"id {kind}, reply string"))
