"""Versions of files, and conflicts between what files say."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.understand import COMPARATIVE
from harrier.scratch import checkpointed

#: Folders of superseded files, fields of facts, and opposite phrases.
ARCHIVES = ("archive", "old", "superseded")
FIELDS = r"(?i)\b(learning_rate|val_rmse|num_pairs|fusion|encoder|bark_type)\s*[:=]\s*([A-Za-z0-9.eE+\-]+)"
OPPOSITES = (("does help", "does not help"), ("fusion helps", "fusion does not"), ("not help", "does help"))


def version_key(path: Column | str) -> Column:
    """Suffix and stem without version marks: what the versions of a file share."""
    bare = F.regexp_replace(T.stem(path), r"(?i)(_v\d+|_old|_archive|[-._]bak)$", "")
    suffix = T.suffix(path)
    return F.concat(F.when(suffix == "", "none").otherwise(suffix), F.lit(":"), F.lower(F.regexp_replace(bare, r"_v\d+", "")))


def clusters(chunks: DataFrame) -> DataFrame:
    """``(key, path, mtime, current, current_path)`` of the paths whose key has several.

    A path counts with its latest time; it is current if no folder of it is an archive
    and no other is newer; where none is, the newest is. Metadata is enough: the texts
    aren't read.
    """
    paths = chunks.groupBy("path").agg(F.max("mtime").alias("mtime")).withColumn("key", version_key("path"))
    of = Window.partitionBy("key")
    archived = F.arrays_overlap(F.split(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/"), F.array(*map(F.lit, ARCHIVES)))
    rows = paths.withColumns({"n": F.count("*").over(of), "newest": F.max("mtime").over(of)}).filter("n > 1")
    rows = rows.withColumn("fresh", ~archived & (F.col("mtime") >= F.col("newest") - 1e-6))
    rows = rows.withColumn("any_fresh", F.max("fresh").over(of))
    turn = F.row_number().over(of.orderBy(F.col("fresh").desc(), F.col("mtime").desc(), "path"))
    first = F.first("path").over(of.orderBy(F.col("fresh").desc(), F.col("mtime").desc(), "path"))
    return rows.withColumns({"turn": turn, "current_path": first}).select("key", "path", "mtime", F.when(F.col("any_fresh"), F.col("fresh")).otherwise(F.col("turn") == 1).alias("current"), "current_path")


def prefer_current(hits: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits ``(query_id, query, path, rank)`` without those superseded by a path that is
    among the same query's hits, ranked anew; comparative queries keep all."""
    superseded = versions.filter("path <> current_path").select("path", "current_path")
    present = hits.select("query_id", F.col("path").alias("current_path")).distinct()
    gone = hits.filter(~F.coalesce("query", F.lit("")).rlike(COMPARATIVE)).select("query_id", "path").join(superseded, "path").join(present, ["query_id", "current_path"]).select("query_id", "path").distinct()
    kept = hits.join(gone, ["query_id", "path"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def facts(chunks: DataFrame) -> DataFrame:
    """``(entity, field, value, path)``: fields with values, of the run that the path or
    else the text names, or else of the file."""
    run = T.run_id("path", "text")
    entity = F.coalesce(F.concat(F.lit("run:"), run), F.concat(F.lit("file:"), "path"))
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(FIELDS), F.lit(1)).alias("field"), F.regexp_extract_all("text", F.lit(FIELDS), F.lit(2)).alias("value"))
    rows = chunks.select(entity.alias("entity"), "path", F.explode(found).alias("f"))
    return rows.select("entity", F.lower(F.col("f").getField("field")).alias("field"), F.lower(F.col("f").getField("value")).alias("value"), "path")


def structural_conflicts(chunks: DataFrame) -> DataFrame:
    """``(entity, field, values, paths)`` where an entity's field has several values."""
    by = facts(chunks).groupBy("entity", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), F.array_sort(F.collect_set("path")).alias("paths"))
    return by.filter(F.size("values") >= 2)


def claim_conflicts(hits: DataFrame) -> DataFrame:
    """``(query_id, path_a, path_b, said, denied)``: pairs of a query's hits of which one
    says a phrase and the other its opposite. Hits meet on the phrases they hold.

    Texts are read once, and only those with a telling word of a phrase are cleaned: the
    text is bound by the functions' variables, and the few rows with phrases are written
    before their sides part, since Spark would work a text out anew for each use.
    """
    telling = sorted({max(reversed(p.split()), key=len) for pair in OPPOSITES for p in pair})
    bare = F.translate(F.lower(F.coalesce("text", F.lit(""))), "*_`~", "")
    cleaned = lambda b: F.when(reduce(or_, (b.contains(w) for w in telling)), T.claim_text(b))
    phrases = [F.struct(F.lit(i).alias("pair"), F.lit(side).alias("side"), F.lit(p).alias("phrase")) for i, pair in enumerate(OPPOSITES) for side, p in enumerate(pair)]
    holds = F.flatten(F.transform(F.array(bare), lambda b: F.flatten(F.transform(F.array(cleaned(b)), lambda x: F.filter(F.array(*phrases), lambda p: x.contains(p["phrase"]))))))
    # an outer explode: before another one Spark tests the array's size, which is all of the work again
    said = checkpointed(hits.select("query_id", "path", F.explode_outer(holds).alias("h")).filter("h is not null").select("query_id", "path", "h.pair", "h.side").distinct())
    a, b = said.filter("side = 0").select("query_id", "pair", F.col("path").alias("p")), said.filter("side = 1").select("query_id", "pair", F.col("path").alias("q"))
    met = a.join(b, ["query_id", "pair"]).filter("p <> q").select("query_id", "pair", F.least("p", "q").alias("path_a"), F.greatest("p", "q").alias("path_b"))
    first = met.groupBy("query_id", "path_a", "path_b").agg(F.min("pair").alias("pair"))
    names = F.array(*(F.struct(F.lit(x).alias("said"), F.lit(y).alias("denied")) for x, y in OPPOSITES))
    return first.select("query_id", "path_a", "path_b", F.element_at(names, F.col("pair") + 1).alias("n")).select("query_id", "path_a", "path_b", "n.said", "n.denied")
