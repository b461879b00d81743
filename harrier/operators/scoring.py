"""Scores of answers by the values they state, and how sure a difference of scores is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.operators.evidence import ABSTAINED, cited_answers

ROUNDED = 8
#: Markers of sources, numbers that stand alone, hyphens within words, answers that aren't values.
MARKER = r"\s*\[S\d{1,3}\]"
RUN = r"(?i)\brun[_\s-]?0*(\d+)"
NUMBER = r"(?<![\w.])(?<!\d-)[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:e[-+]?\d+)?(?!\w)(?!\.\d)"
WITHIN = r"(?<=[a-z0-9])[-_](?=[a-z0-9])"
NOT_VALUES = ("", "yes", "no")


def gold_parts(gold: Column) -> Column:
    """The values of a gold answer, or null where it is a sentence, or yes or no."""
    text = F.trim(F.coalesce(gold, F.lit("")))
    cut = F.filter(F.transform(F.split(text, r"[;,]|\s+vs\s+"), lambda x: F.trim(x)), lambda p: p != "")
    parts = F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"(?i)^file ", "")))
    plain = ~F.lower(text).isin(*NOT_VALUES) & (F.size(parts) > 0) & ~F.exists(parts, lambda p: p.rlike(r"\s"))
    return F.when(plain, parts)


def states_value(answer: Column, value: Column, cited: Column) -> Column:
    """Does the answer state the value? A number by its value; a path if it is cited, or
    stands in the answer (a folder: anything below it); other values as words, hyphens and
    underscores within them aside."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), MARKER, "")
    target = value.try_cast("double")
    numbers = F.transform(F.regexp_extract_all(F.lower(F.regexp_replace(text, RUN, "run $1")), F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    as_number = F.exists(numbers, lambda x: F.abs(x - target) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(target)))
    quoted = F.concat(F.lit("\\Q"), value, F.lit("\\E"))
    folder = F.exists(cited, lambda p: p.startswith(value)) | F.rlike(text, F.concat(F.lit(r"(?<![\w/.-])"), quoted))
    path = F.array_contains(cited, value) | F.rlike(text, F.concat(F.lit(r"(?<![\w/.-])"), quoted, F.lit(r"(?![\w/-])")))
    bare = lambda c: F.regexp_replace(F.lower(c), WITHIN, "")
    word = F.rlike(bare(text), F.concat(F.lit(r"(?<![a-z0-9])\Q"), bare(value), F.lit(r"\E(?![a-z0-9])")))
    stated = F.when(target.isNotNull(), as_number).when(value.endswith("/"), folder).when(value.contains("/"), path).otherwise(word)
    return F.coalesce((value != "") & stated, F.lit(False))


def answer_values(rows: DataFrame) -> DataFrame:
    """``(id, parts, stated, label)`` of ``rows (id, answer, gold, cited array<string>)``: all
    parts stated is correct, some partial, none wrong; gold that isn't values has no label."""
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    scored = rows.select("id", "answer", cited.alias("cited"), gold_parts(F.col("gold")).alias("parts"))
    scored = scored.withColumn("stated", F.transform("parts", lambda p: states_value(F.col("answer"), p, F.col("cited"))))
    label = F.when(F.forall("stated", lambda x: x), "correct").when(F.exists("stated", lambda x: x), "partial").when(F.col("stated").isNotNull(), "wrong")
    return scored.select("id", "parts", "stated", label.alias("label"))


def answer_checks(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``cited_answers`` with ``cited_in_retrieved`` (null without citations), whether the
    answer is nothing but an abstention, and the ``rule_label`` that such an answer to a
    question with a ``gold`` answer gets without a judge: wrong."""
    checked = cited_answers(answers.select("id", "answer"), hits).join(answers.select("id", "gold"), "id")
    only = F.col("abstained") & ~F.replace("answer", F.lit(ABSTAINED), F.lit(" ")).rlike("[A-Za-z0-9]")
    cited = F.when(F.col("valid") + F.col("unknown") > 0, F.col("unknown") == 0)
    label = F.when(only & (F.trim(F.coalesce("gold", F.lit(""))) != ""), "wrong")
    return checked.select("id", "uncited", "abstained", only.alias("abstention_only"), (F.col("valid") + F.col("unknown")).alias("n_citations"), cited.alias("cited_in_retrieved"), label.alias("rule_label"))


def draws(spark, n: int, samples: int = 2000) -> DataFrame:
    """``(b, idx)``: ``samples`` draws of ``n`` positions, by MD5 of the draw's number, so
    that any engine draws the same."""
    rows = spark.range(samples * n)
    bits = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("long")
    return rows.select(F.floor(F.col("id") / n).alias("b"), (bits % n).alias("idx"))


def _edges(values: DataFrame, column: str) -> DataFrame:
    return values.agg(F.round(F.percentile(column, 0.025), ROUNDED).alias("low"), F.round(F.percentile(column, 0.975), ROUNDED).alias("high"))


def group_interval(scores: DataFrame, drawn: DataFrame, group: str = "family", value: str = "value") -> DataFrame:
    """``(n_groups, mean, low, high)``: the interval of the mean over all rows when whole
    groups are drawn (``drawn (b, idx)``; groups count from 0 in the order of their names).
    Groups are summed first, so a draw moves two numbers for each."""
    from pyspark.sql import Window

    sums = scores.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    placed = sums.withColumn("idx", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))  # a row for each group
    means = drawn.join(placed, "idx").groupBy("b").agg((F.sum("s") / F.sum("c")).alias("m"))
    whole = sums.agg(F.count("*").alias("n_groups"), F.round(F.sum("s") / F.sum("c"), ROUNDED).alias("mean"))
    return whole.crossJoin(F.broadcast(_edges(means, "m")))  # one row each


def kappa_interval(labels: DataFrame, drawn: DataFrame, question: str, a: str, b: str) -> DataFrame:
    """``(low, high)`` of Cohen's kappa when questions are drawn, each with all its labels;
    questions count from 0 in their order. A question's labels are counted first."""
    from pyspark.sql import Window

    counts = labels.groupBy(question, F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("c"))
    names = counts.select(question).distinct()
    placed = counts.join(names.withColumn("idx", (F.row_number().over(Window.orderBy(question)) - 1).cast("long")), question)
    often = drawn.groupBy("b", "idx").agg(F.count("*").alias("times"))
    cells = often.join(placed, "idx").groupBy("b", "la", "lb").agg(F.sum(F.col("c") * F.col("times")).alias("c"))
    totals = cells.groupBy("b").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy("b", F.col("la").alias("label")).agg(F.sum("c").alias("ca"))
    right = cells.groupBy("b", F.col("lb").alias("label")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, ["b", "label"]).groupBy("b").agg(F.sum(F.col("ca") * F.col("cb")).alias("by_chance"))
    both = totals.join(chance, "b", "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("by_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    kappa = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return _edges(both.select(kappa.alias("k")), "k")


def confidence(scores: DataFrame, parent: str, least: int = 20) -> DataFrame:
    """``(arm, category, n, mean, delta, up, down, small)`` of ``scores (arm, query_id,
    category, value)``: each arm against its parent on the same queries, in each category
    and in all (a null category); few queries are flagged."""
    base = scores.filter(F.col("arm") == parent).select("query_id", F.col("value").alias("before"))
    met = scores.join(base, "query_id").select("arm", "category", "value", (F.col("value") - F.col("before")).alias("d"))
    up, down = F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down")
    sets = [[F.col("arm"), F.col("category")], [F.col("arm")]]
    grouped = met.groupingSets(sets, "arm", "category").agg(F.count("*").alias("n"), F.round(F.avg("value"), ROUNDED).alias("mean"), F.round(F.avg("d"), ROUNDED).alias("delta"), up, down)
    return grouped.withColumn("small", F.col("n") < least)


def verdict(low: Column, high: Column, changed: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(changed == 0, "identical").when(low > 0, "above zero").when(high < 0, "below zero").otherwise("covers zero")


def vector_check(a: DataFrame, b: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(n, max_difference, least_cosine, mean_cosine)`` between the directions of two sets
    of vectors."""
    from harrier.functions import vectors as V

    met = a.select(key, V.unit(column).alias("x")).join(b.select(key, V.unit(column).alias("y")), key)
    far = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    rows = met.select(far.alias("far"), V.dot("x", "y").alias("cosine"))
    return rows.agg(F.count("*").alias("n"), F.round(F.max("far"), ROUNDED).alias("max_difference"), F.round(F.min("cosine"), ROUNDED).alias("least_cosine"), F.round(F.avg("cosine"), ROUNDED).alias("mean_cosine"))
