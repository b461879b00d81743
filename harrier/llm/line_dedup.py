"""Line dedup over levelled sorted runs of line hashes.

A *run* is a Parquet table of ``(h1, h2, n_docs, owner)``, dealt and sorted by the
hash: for each line key seen in a batch of documents, in how many of them, and the
largest id among them. A new batch adds its run at level 0. When a level has
``fanout`` runs, they are merged into one run of the next level (counts add up,
owners take the maximum), so the number of runs stays logarithmic in that of the
batches and each entry is rewritten once for each level.

A batch is merge-anti-joined with the runs when it arrives: keys that are *settled*
(seen in ``min_docs`` documents, with an owner beyond the batch's) have their verdict,
and the batch adds its other keys only. The table is taken in from the largest ids
down, so the owner of a key is in the first batch that has it, and a key that stands in
many documents is written ``min_docs`` times or so rather than once for each batch.

After the last batch lines are judged by the same anti-join: those whose key is in
``min_docs`` documents or more, and which the key's owner does not hold, find a
partner and go; the others stay. The lines' side is shuffled once and narrow (hashes,
id, position). A hot key has one row on the runs' side, so the adaptive skew join
can split its lines over tasks; taking a batch in, counts are combined before each
shuffle. Texts are shuffled once, to meet the positions of their kept lines.

A key is the line without white space at its ends and with A-Z lower-cased, hashed
to 128 bits. Only keys of ``min_chars`` code points or more take part.

Rows with the same id are one document; a null id is a document that precedes all
others. Null and empty texts are one empty line, which stays. Repeated rows are
judged alike and stay repeated. Other columns pass through, whatever their names; empty
tables give no rows, and texts and lines of any length are judged whole. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.llm.common import free_name, materialize, text_of

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches in which the table is taken in, and runs of a level that are merged.
BATCHES = 4
FANOUT = 2

#: The characters of [\x20\x09-\x0D].
_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id, below all others.
_NO_ID = -(2**63)


def line_key(bare: Column) -> Column:
    """What two trimmed lines must share: percent-encoding keeps texts apart and leaves
    only ASCII, so that lower-casing it folds A-Z of the line and nothing else."""
    return F.lower(F.url_encode(bare))


def long_lines(text: Column, min_chars: int) -> Column:
    """``array<struct<pos, h1, h2>>``: the lines whose keys take part."""
    kept = F.filter(F.transform(F.split(text, "\n"), _positioned), lambda x: F.char_length(x["line"]) >= min_chars)
    keyed = F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), line_key(x["line"]).alias("key")))
    return F.transform(keyed, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))


class LineRuns:
    """The levelled runs of one corpus, in the session's shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_chars, self.min_docs = spark, fanout, min_chars, min_docs
        self.levels: list[list[DataFrame]] = []

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take in a batch; no document of it may be in an earlier batch. Batches may come in
        any order of ids; from the largest down, the fewest keys are written."""
        keys = F.array_distinct(F.transform(long_lines(text_of(text_col), self.min_chars), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
        seen = docs.select(_doc(id_col).alias("doc"), F.explode(keys).alias("key")).select("doc", "key.*")
        own = seen.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("owner"))
        if any(self.levels):
            settled = self.entries().filter(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("owner").alias("last"))
            own = own.join(settled, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("owner") < F.col("last")), "left_anti")
        self._push(own, 0)

    def _push(self, entries: DataFrame, level: int) -> None:
        run = materialize(entries.sortWithinPartitions("h1", "h2"), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(_merged(full), level + 1)

    def entries(self) -> DataFrame:
        """``(h1, h2, n_docs, owner)`` over all runs."""
        runs = [run for level in self.levels for run in level]
        return runs[0] if len(runs) == 1 else _merged(runs)

    def judge(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with two more columns: ``n_lines long`` and ``kept_lines array<string>``. Where
        ``docs`` has columns of these names, the new ones are named by ``judged_names``."""
        n_lines, kept_lines = judged_names(docs)
        doc, digest, stays, lines_at = (free_name(docs, n) for n in ("doc", "digest", "stays", "lines_at"))
        text = text_of(text_col)
        keyed = docs.withColumns({doc: _doc(id_col), digest: F.xxhash64(text)})
        lines = keyed.select(F.col(doc).alias("doc"), F.col(digest).alias("digest"), F.explode(long_lines(text, self.min_chars)).alias("line")).select("doc", "digest", "line.*")
        common = self.entries().filter(F.col("n_docs") >= self.min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "owner")
        kept = lines.join(common, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("doc") < F.col("owner")), "left_anti")
        by_doc = kept.groupBy(F.col("doc").alias(doc), F.col("digest").alias(digest)).agg(F.collect_set("pos").alias(stays))
        long_at = F.transform(F.filter(F.transform(F.col(lines_at), _positioned), lambda x: F.char_length(x["line"]) >= self.min_chars), lambda x: x["pos"])
        none = F.array().cast("array<int>")
        gone = F.array_except(long_at, F.coalesce(F.col(stays), none))
        stay_at = F.array_except(F.sequence(F.lit(0), F.size(F.col(lines_at)) - 1), gone)
        return (
            keyed.join(by_doc, [doc, digest], "left")
            .withColumn(lines_at, F.split(text, "\n"))
            .withColumns({n_lines: F.size(F.col(lines_at)).cast("long"), kept_lines: F.transform(stay_at, lambda i: F.element_at(F.col(lines_at), i + 1))})
            .drop(doc, digest, stays, lines_at)
        )


def judged_names(docs: DataFrame) -> tuple[str, str]:
    """``n_lines`` and ``kept_lines``, or these with underscores before where ``docs`` has them."""
    return free_name(docs, "n_lines"), free_name(docs, "kept_lines")


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))


def _positioned(line: Column, pos: Column) -> Column:
    return F.struct(pos.alias("pos"), F.trim(line, F.lit(_SPACE)).alias("line"))


def _merged(runs: list[DataFrame]) -> DataFrame:
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def batches_of(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` in ``n`` ranges of ids of about equal size, from the largest down, null ids last. The ranges
    reach the scan as filters, so files in the order of ids are read once in all."""
    cuts = sorted(set(docs.stat.approxQuantile(id_col, [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    key = F.col(id_col)
    if not cuts:
        return [docs]
    first = docs.filter(key.isNull() | (key < cuts[0]))
    return [docs.filter(key >= cuts[-1]), *(docs.filter((key >= a) & (key < b)) for a, b in reversed(list(zip(cuts, cuts[1:])))), first]


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``n_lines`` and ``kept_lines`` (``judged_names``): batch after batch is taken into the
    runs, and then all lines are judged against them."""
    runs = LineRuns(docs.sparkSession, fanout, min_chars, min_docs)
    for batch in batches_of(docs, batches):
        runs.add(batch)
    return runs.judge(docs)


def line_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)``, a row for each row of ``docs``."""
    judged = dedup_lines(docs.select("doc_id", "text"))
    kept = F.array_join("kept_lines", "\n")
    return judged.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``documents`` with the dropped lines gone from ``text``, and ``n_chars`` to match."""
    judged = dedup_lines(docs)
    text = F.array_join(judged_names(docs)[1], "\n")
    out = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return judged.withColumns(out).select(docs.columns)
