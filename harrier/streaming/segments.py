"""A lexical index in immutable segments, with tombstones, corrected at search.

Each batch of changes writes one segment: the postings and lengths of its new texts. A
changed or deleted item gets a tombstone ``(item, upto)``: what segments before ``upto``
hold of it is dead. Nothing written is ever changed. A *commit* lists the live segments,
the tombstone files and the corpus' numbers; readers take the newest whole one, so a
batch shows all at once or not at all, and a batch that is applied again does nothing.

At search the postings of the asked terms are read from all live segments, dead ones are
dropped, and document frequencies are counted of what is left, so answers are those of
an index built anew. When a level has ``FANOUT`` segments these are merged into one of
the next level, without their dead rows; the others are not touched. Tombstones that no
live segment needs go in the same commit.

Of several changes of an item in a batch the last by ``order`` counts (ties: deletions, then
the greater text). A null text is an empty one. One writer at a time: a second one finds
its commit's folder taken and fails. Old folders are left to ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.lexical import BROADCAST_TERMS, INDEX_BUCKETS, bm25_weight, bucket_of, exploded, idf
from harrier.operators.ranking import small, top_k

#: Segments of a level that are merged.
FANOUT = 4
#: Tombstones that are broadcast, at most.
BROADCAST_TOMBSTONES = 500_000

_POSTINGS = "segment long, bucket int, term string, item long, tf long, dl long"
_ITEMS = "segment long, item long, dl long"
_DEAD = "item long, upto long"

Tokenizer = Callable[[Column | str], Column]


@dataclass
class Segment:
    number: int
    level: int
    folder: str
    items: int
    postings: int


@dataclass
class Commit:
    """One state of the index. ``batch`` is the last batch applied; ``n`` and ``total`` are the
    number and the length of what is alive."""

    version: int = -1
    batch: int = -1
    n: int = 0
    total: int = 0
    segments: list[Segment] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)

    @property
    def avgdl(self) -> float:
        return self.total / self.n if self.n else 0.0

    @property
    def next_number(self) -> int:
        return 1 + max((s.number for s in self.segments), default=-1)


class SegmentedIndex:
    """The index below ``path``, in the shared file system."""

    def __init__(self, spark: SparkSession, path: str, tokenize: Tokenizer = T.tokens, buckets: int = INDEX_BUCKETS, fanout: int = FANOUT):
        self.spark, self.path, self.tokenize, self.buckets, self.fanout = spark, path.rstrip("/"), tokenize, buckets, fanout

    # the commits

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def head(self) -> Commit:
        """The newest whole commit."""
        place, files = self._files()
        if not files.exists(place):
            return Commit()
        names = [s.getPath().getName() for s in files.listStatus(place)]
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        whole = [int(n) for n in names if n.isdigit() and files.exists(jvm_path(f"{self.path}/commits/{n}/_SUCCESS"))]
        if not whole:
            return Commit()
        said = json.loads(self.spark.read.text(f"{self.path}/commits/{max(whole)}").first().value)
        return Commit(**{**said, "segments": [Segment(**s) for s in said["segments"]]})

    def _commit(self, commit: Commit) -> Commit:
        text = json.dumps(asdict(commit))
        # an existing folder is an error: another writer was faster
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.path}/commits/{commit.version}")
        return commit

    # the tables of a commit

    def _table(self, commit: Commit, kind: str, schema: str) -> DataFrame:
        places = [f"{s.folder}/{kind}" for s in commit.segments]
        if not places:
            return self.spark.createDataFrame([], schema)
        out = None
        for place in places:
            part = self.spark.read.schema(schema).parquet(place)
            out = part if out is None else out.unionByName(part)
        return out

    def tombstones(self, commit: Commit) -> DataFrame:
        """``(item, upto)``, a row for each item that has one."""
        if not commit.tombstones:
            return self.spark.createDataFrame([], _DEAD)
        return self.spark.read.schema(_DEAD).parquet(*commit.tombstones).groupBy("item").agg(F.max("upto").alias("upto"))

    def _alive(self, rows: DataFrame, commit: Commit) -> DataFrame:
        dead = small(self.tombstones(commit).withColumnRenamed("item", "dead"), BROADCAST_TOMBSTONES)
        return rows.join(dead, (F.col("item") == F.col("dead")) & (F.col("segment") < F.col("upto")), "left_anti")

    def items(self, commit: Commit | None = None) -> DataFrame:
        """``(segment, item, dl)`` of all items alive."""
        commit = commit or self.head()
        return self._alive(self._table(commit, "items", _ITEMS), commit)

    def postings(self, commit: Commit | None = None) -> DataFrame:
        """``(segment, bucket, term, item, tf, dl)`` of all items alive."""
        commit = commit or self.head()
        return self._alive(self._table(commit, "postings", _POSTINGS), commit)

    # changes

    def apply(self, changes: DataFrame, batch: int | None = None, order: str | None = None, item: str = "item", text: str = "text", deleted: str = "deleted") -> Commit:
        """Take in ``changes (item, text, deleted)``; ``batch`` is a number that grows, for batches
        that may come again."""
        head = self.head()
        if batch is not None and batch <= head.batch:
            return head
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in changes.columns else F.lit(False)
        turn = F.struct(*([F.col(order)] if order else []), gone, F.coalesce(F.col(text), F.lit("")))
        last = changes.filter(F.col(item).isNotNull()).groupBy(F.col(item).cast("long").alias("item")).agg(F.max_by(F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), gone.alias("gone")), turn).alias("c"))
        number, folder = head.next_number, f"{self.path}/data/{uuid.uuid4().hex}"
        last.select("item", self.tokenize("c.text").alias("tokens"), F.col("c.gone").alias("gone")).write.parquet(f"{folder}/changes")
        held = self.spark.read.parquet(f"{folder}/changes")
        held.select("item", F.lit(number).cast("long").alias("upto")).write.parquet(f"{folder}/tombstones")
        fresh = held.filter("not gone").select("item", F.size("tokens").cast("long").alias("dl"), "tokens")
        each = exploded(fresh).groupBy("item", "dl", "term").agg(F.count("*").alias("tf"))
        segment = self._write(folder, number, 0, each.select("term", "item", "tf", "dl"), fresh.select("item", "dl"))
        # what the changes put in the place of
        lost = self.items(head).join(held.select("item"), "item", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        won = self.spark.read.schema(_ITEMS).parquet(f"{folder}/items").agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        n, total = head.n - lost.n + segment.items, head.total - lost.dl + won
        # an empty segment holds the number, so that later ones don't fall under its tombstones
        commit = Commit(head.version + 1, head.batch if batch is None else batch, n, total, [*head.segments, segment], [*head.tombstones, f"{folder}/tombstones"])
        return self._merged(self._commit(commit))

    def _write(self, folder: str, number: int, level: int, postings: DataFrame, items: DataFrame) -> Segment:
        keyed = postings.select(F.lit(number).cast("long").alias("segment"), bucket_of(F.col("term"), self.buckets).alias("bucket"), "term", "item", "tf", "dl")
        keyed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "item").write.partitionBy("bucket").parquet(f"{folder}/postings")
        items.select(F.lit(number).cast("long").alias("segment"), "item", "dl").write.parquet(f"{folder}/items")
        counts = [self.spark.read.schema(schema).parquet(f"{folder}/{kind}").count() for kind, schema in (("items", _ITEMS), ("postings", _POSTINGS))]
        return Segment(number, level, folder, *counts)

    def _merged(self, commit: Commit) -> Commit:
        """Merge levels that are full; each merge is a commit of its own."""
        for level in sorted({s.level for s in commit.segments}):
            full = [s for s in commit.segments if s.level == level]
            if len(full) < self.fanout:
                continue
            part = Commit(segments=full, tombstones=commit.tombstones)
            folder, number = f"{self.path}/data/{uuid.uuid4().hex}", max(s.number for s in full)
            merged = self._write(folder, number, level + 1, self.postings(part).select("term", "item", "tf", "dl"), self.items(part).select("item", "dl"))
            segments = sorted([*(s for s in commit.segments if s.level != level), merged], key=lambda s: s.number)
            needed = self.tombstones(commit).filter(F.col("upto") > min(s.number for s in segments))
            needed.write.parquet(f"{folder}/tombstones")
            commit = self._commit(Commit(commit.version + 1, commit.batch, commit.n, commit.total, segments, [f"{folder}/tombstones"]))
            return self._merged(commit)
        return commit

    # reading

    def top_k(self, terms: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, commit: Commit | None = None) -> DataFrame:
        """``(query_id, item, score, rank)`` of ``terms (query_id, term, qtf)``, as of a commit."""
        commit = commit or self.head()
        asked = terms.select("query_id", "term", "qtf").withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        words = small(asked.select("bucket", "term").distinct(), BROADCAST_TERMS)
        met = self._alive(self._table(commit, "postings", _POSTINGS).join(words, ["bucket", "term"], "left_semi"), commit)
        df = met.groupBy("term").agg(F.count("*").alias("df"))
        weights = asked.join(df, "term").select("query_id", "term", (idf(F.lit(float(commit.n)), F.col("df")) * F.col("qtf")).alias("weight"))
        share = F.col("weight") * bm25_weight(F.col("tf"), F.col("dl"), F.lit(float(commit.avgdl)), k1, b)
        scored = met.join(small(weights, BROADCAST_TERMS), "term").groupBy("query_id", "item").agg(F.round(F.sum(share), 8).alias("score"))
        return top_k(scored.filter("score > 0"), k)

    def verify(self, commit: Commit | None = None) -> DataFrame:
        """``(check, expected, found)`` of all that doesn't hold: the rows of each segment, the
        numbers of the corpus, items that are alive twice, and items whose postings don't add up."""
        commit = commit or self.head()
        every, alive = self._table(commit, "items", _ITEMS), self.items(commit)
        said = self.spark.createDataFrame([(s.number, kind, n) for s in commit.segments for kind, n in (("items", s.items), ("postings", s.postings))], "segment long, kind string, expected long")
        counts = every.groupBy("segment").count().withColumn("kind", F.lit("items")).unionByName(self._table(commit, "postings", _POSTINGS).groupBy("segment").count().withColumn("kind", F.lit("postings")))
        rows = said.join(counts, ["segment", "kind"], "left").select(F.concat_ws(" ", F.lit("segment"), "segment", "kind").alias("check"), "expected", F.coalesce("count", F.lit(0)).alias("found"))
        whole = alive.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), (F.count("*") - F.count_distinct("item")).alias("twice"))
        numbers = whole.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.lit(e).cast("long").alias("expected"), F.col(c).cast("long").alias("found")) for c, e in (("n", commit.n), ("total", commit.total), ("twice", 0))))).alias("x")).select("x.*")
        sums = self.postings(commit).groupBy("segment", "item").agg(F.sum("tf").alias("tf"))
        uneven = alive.filter("dl > 0").join(sums, ["segment", "item"], "left").filter(~F.col("tf").eqNullSafe(F.col("dl"))).agg(F.count("*").alias("found")).select(F.lit("uneven").alias("check"), F.lit(0).cast("long").alias("expected"), "found")
        return rows.unionByName(numbers).unionByName(uneven).filter("expected <> found")

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest commit doesn't name; readers of older ones lose them."""
        head = self.head()
        used = {s.folder for s in head.segments} | {t.rsplit("/", 1)[0] for t in head.tombstones}
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        _, files = self._files()
        place = jvm_path(f"{self.path}/data")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        gone = [f"{self.path}/data/{n}" for n in names if f"{self.path}/data/{n}" not in used]
        for folder in gone:
            files.delete(jvm_path(folder), True)
        return gone


def index_stream(stream: DataFrame, index: SegmentedIndex, checkpoint: str, order: str | None = None) -> None:
    """Take in what is there of a stream of ``(item, text, deleted)``: a segment for each micro-batch.
    After a restart a batch that was committed is left out."""

    def put(batch: DataFrame, number: int) -> None:
        index.apply(batch, number, order)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
