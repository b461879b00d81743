"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a number u in (0, 1) for each key, from the hash of the key and the
shard's name; the shard with the largest ``weight / -ln(u)`` takes the record. The
place depends on the key and the shards alone, so one more shard takes records only
into itself, about its share of them, and moves none between the old ones.

Slots number a shard's records from 0 without gaps. No task holds a shard: records
fall into ``buckets`` by the hash of key and content (so many records of one key are
spread too), a window numbers each (shard, bucket), and the sums
of the counts before it (shards x buckets rows, a fixed number) are its offset.

Of equal scores the shard named first wins. A null key is a key of its own; null texts have no bytes. Repeated rows share a shard
and have a slot each. No columns of the input are needed but the key and the text,
whatever the others' names. Empty tables give no rows; texts count with all their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.common import free_name

BUCKETS = 512


def draw(key: Column, shard: str) -> Column:
    """A number in (0, 1), made of 48 bits of the MD5 of key and shard."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\x00")), F.lit(f"/{shard}"))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def shard_of(key: Column, shards: list[tuple[str, float]]) -> Column:
    """The position in ``shards`` (name, weight) of the record's shard."""
    if not shards or any(weight <= 0 for _, weight in shards):
        raise ValueError("there must be shards, with positive weights")
    scores = [F.struct((F.lit(float(weight)) / -F.ln(draw(key, name))).alias("score"), F.lit(-i).alias("turn")) for i, (name, weight) in enumerate(shards)]
    return (-F.array_max(F.array(*scores))["turn"]).cast("int")


def assign(df: DataFrame, key: str, shards: list[tuple[str, float]], out: str = "shard") -> DataFrame:
    """``df`` with the shard's position as a further column: no shuffle. A column of that
    name stays, and the new one gets underscores before its name (``free_name``)."""
    return df.withColumn(free_name(df, out), shard_of(F.col(key), shards))


def with_slots(df: DataFrame, key: str, order: list[str], buckets: int = BUCKETS, out: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` (with ``shard``) with gapless numbers from 0 in each shard, in the order of
    the bucket, the key and ``order``; a column named ``out`` stays, as in ``assign``."""
    bucket, before, out = free_name(df, "bucket"), free_name(df, "before"), free_name(df, out)
    dealt = df.withColumn(bucket, F.floor(draw(F.concat_ws("/", *(F.col(c).cast("string") for c in (key, *order))), "bucket") * buckets).cast("int"))
    counts = dealt.groupBy(shard, bucket).agg(F.count("*").alias("rows"))
    upto = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, bucket, F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias(before))
    numbered = dealt.withColumn(out, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(F.col(key).asc_nulls_first(), *order)).cast("long") - 1)
    # shards x buckets rows at most, whatever the input
    return numbered.join(F.broadcast(offsets), [shard, bucket]).withColumn(out, F.col(out) + F.col(before)).drop(bucket, before)


def write_shards(df: DataFrame, key: str, shards: list[tuple[str, float]], path: str) -> None:
    """Write the records as Parquet, a folder ``shard=<name>`` for each shard (``_shard=`` where
    the records have a column of that name). Every
    task writes to all shards; a shard is split over many files, never held by one task."""
    names = F.array(*(F.lit(name) for name, _ in shards))
    folder = free_name(df, "shard")
    df.withColumn(folder, F.element_at(names, shard_of(F.col(key), shards) + 1)).write.partitionBy(folder).parquet(path)


def shard_report(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The digest of ``documents``: where each record lies, and where with one more shard."""
    shards = [(str(i), 1.0) for i in range(n_shards + 1)]
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards[:-1]).alias("shard"),
        shard_of(F.col("doc_id"), shards).alias("grown_shard"),
    )
    return with_slots(narrow, "doc_id", ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
