"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's weight gives it a share of the mix; no share exceeds ``most`` times what the
source has, and the excess goes to the others by weight until none is above. Whole
epochs of a source come first. What is left of its budget is a weighted sample without
replacement: each document draws an exponential key, ``-ln(u) / quality``, the source's
documents are sorted by it, sizes are summed along that order, and documents are taken
until the budget is reached; the one at the border is cut there, so a source's words
come to its target, rounded. ``u`` comes from the hash of id and size, so reruns agree.

The quality weight of a document is 1 / (1 + the quality rules that it fails).

No task holds a source. Running sums are made over ranges: rows are dealt by range of
(source, key), summed within their range, and the sums of the ranges before (a row
for each range and source) are added. The sources' ranks are made the same way, and
the level to which shares rise is found by a few aggregates over one row for each
source; two numbers reach the driver in each step.

A null text has no words; a null source is a source of its own, the last in order; null
ids draw by their size. Equal keys are ordered by id, size and content; rows equal in
all are interchangeable. Sources without words have the target 0. Repeated rows count
as often as they occur. Empty tables give no rows; texts of any length are measured
whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm import quality
from harrier.llm.common import free_name, materialize, text_of
from harrier.llm.sharding import draw
from harrier.operators.ranking import small

#: The weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: All sizes times this is the size of the mix; a source's size times ``MOST`` is its bound.
SHARE = 1.5
MOST = 2
#: Sources that are broadcast, at most; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def quality_weight(measure_of=F.col) -> Column:
    """Between 0 and 1, of the measures of a text."""
    failed = sum((fails.cast("int") for fails in quality.rule_failures(measure_of).values()), F.lit(0))
    return F.lit(1.0) / (1 + failed)


def running_sum(df: DataFrame, groups: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, in each group's order."""
    part, n = free_name(df, "part"), free_name(df, "part_sum")
    own = [f"{n}_{i}" for i in range(len(groups) + 1)]
    dealt = materialize(df.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(part, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(part, *groups).agg(F.sum(value).alias(n))
    upto = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, *groups, F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n)).toDF(own[0], *own[1:], n)
    local = dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    meets = F.col(part) == F.col(own[0])
    for name, other in zip(groups, own[1:]):
        meets = meets & F.col(name).eqNullSafe(F.col(other))
    return local.join(offsets, meets).withColumn(out, F.col(out) + F.col(n)).drop(part, n, *own)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes (source, size)``, a row for each source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = running_sum(each, [], [F.col("source").asc_nulls_last()], "one", "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    rows = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "sources")
    wanted = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        # sources that the level fills stay at their bound; the rest share what these leave
        under = F.col("cap") > F.col("weight") * level
        held, open_weight, now = rows.agg(
            F.coalesce(F.sum(F.when(~under, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(under, F.col("weight"))), F.lit(0.0)), F.count(F.when(~under, 1))
        ).first()
        if now == full or not open_weight:
            break
        level, full = (wanted - held) / open_weight, now
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def sample(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", into: str = "mix", carry: list[str] | None = None, seed: str = "mix") -> DataFrame:
    """The carried columns (all by default) with the struct ``into`` of ``size, source_size,
    target, taken``: how many words of each row the mix takes."""
    found, digest, source, size, key, words = (free_name(docs, n) for n in ("measures", "digest", "mix_source", "mix_size", "mix_key", "mix_before"))
    kept = list(docs.columns if carry is None else carry)
    measured = quality.with_measures(docs.withColumns({digest: F.xxhash64(text_of(text_col)), source: F.col(source_col).cast("string")}), found, text_col)
    size_of = F.col(found).getField("n_words")
    u = draw(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), size_of.cast("string")), seed)
    drawn = measured.withColumns({size: size_of, key: -F.ln(u) / quality_weight(lambda m: F.col(found).getField(m))})
    narrow = drawn.select(*dict.fromkeys([*kept, id_col]), source, size, key, digest)
    rows = materialize(narrow, "drawn")
    targets = materialize(source_targets(rows.select(F.col(source).alias("source"), F.col(size).alias("size"))), "targets")
    ordered = running_sum(rows, [source], [key, id_col, size, digest], size, words)
    own = small(targets, BROADCAST_SOURCES).select(F.col("source").alias(f"{source}_of"), F.struct("source_size", "target").alias(f"{source}_has"))
    met = ordered.join(own, F.col(source).eqNullSafe(F.col(f"{source}_of")))
    has = F.col(f"{source}_has")
    budget = F.round(has["target"]).cast("long")
    epochs = F.when(has["source_size"] > 0, F.floor(budget / has["source_size"])).otherwise(0)
    rest = budget - epochs * has["source_size"]
    part = F.greatest(F.least(rest - F.col(words), F.col(size)), F.lit(0))
    taken = epochs * F.col(size) + part
    result = F.struct(F.col(size).alias("size"), has["source_size"].alias("source_size"), has["target"].alias("target"), taken.cast("long").alias("taken"))
    return met.select(*kept, result.alias(into))


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their columns; a row
    that is cut has its first words, up to the border."""
    into = free_name(docs, "mix")
    drawn = sample(docs, source_col, text_col, id_col, into)
    size, taken = F.col(f"{into}.size"), F.col(f"{into}.taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    turn = free_name(docs, "turn")
    each = drawn.withColumn(turn, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    left = F.least(size, taken - (F.col(turn) - 1) * size)
    space = r"[\x20\x09-\x0D]+"
    first = F.concat_ws(" ", F.slice(F.split(F.regexp_replace(text_of(text_col), f"^{space}", ""), space), F.lit(1), left.cast("int")))
    return each.withColumn(text_col, F.when(left < size, first).otherwise(F.col(text_col))).select(docs.columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs``."""
    return sample(docs.select("doc_id", "source", "text"), carry=["doc_id"]).select("doc_id", "mix.*")
