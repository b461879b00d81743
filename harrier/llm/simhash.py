"""SimHash near-duplicates: BK-trees within shards, and components of their links.

A fingerprint has 64 bits; documents link if theirs differ in at most ``radius``.
Exact copies are one fingerprint. Two fingerprints within the radius agree on at
least ``blocks - radius`` of ``blocks`` bit blocks, so each goes to one shard for
each choice of that many blocks, named by the choice and its bits: every link lies
in some shard. In a shard a BK-tree holds the fingerprints: a node's children are
keyed by their Hamming distance to it, and a search at distance d follows only the
edges from d - radius to d + radius. Trees don't leave their shard's task; a shard
of more than ``shard_max`` fingerprints is cut into chunks, and each pair of chunks
is a task of its own: one chunk's tree goes to it, the other chunk's fingerprints
search it. So tasks are bounded and no link is lost. A shard hands on at most one
link for each fingerprint (to the root of its local component), never all pairs.

Components come from alternating large-star and small-star steps over the links
of fingerprints, written to the shared folder; a node of many links is salted.

A bit that is set in exactly half of the hashes is 0. Null and empty texts have the fingerprint zero and link like any other. A component
is named by its smallest id; null ids name none (a component of only null ids has a
null name). Repeated rows each get their row. Other columns aren't touched, whatever
their names; empty tables give no rows; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrier.llm.common import free_name, map_rows, materialize, ship, text_of

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bit blocks at least, and fingerprints that a shard holds on average at most: beyond, there are more blocks.
BLOCKS = 6
SHARD_MEAN = 8
SHARD_MAX = 4_096
#: Tasks over which the links of one node are dealt in a step towards components.
SALTS = 8

#: Stands for a null id where rows are matched.
_NO_ID = -(2**63)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the text's word shingles, as an unsigned number."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 16_384):
        part = hashes[at : at + 16_384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, fp)``: the fingerprint as a signed long, and a hash of the text."""

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        for key, digest, text in values:
            fp = fingerprint(text)
            yield key, digest, fp - 2**64 if fp >= 2**63 else fp

    text = text_of(text_col)
    return map_rows(docs, [docs[id_col], F.xxhash64(text), text], rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, digest long, fp long")


def shard_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits that name a shard, for each choice of blocks that must agree."""
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits that may differ")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Bit blocks for ``n`` distinct fingerprints. More blocks give names of more bits, so
    shards stay small as the corpus grows (six do for ten million, seven for a thousand
    million), at the price of more shards for each fingerprint; twice the radius at most."""
    least = max(BLOCKS, radius + 1)
    fits = (b for b in range(least, 2 * radius + 1) if n <= SHARD_MEAN * 2 ** (64 * (b - radius) / b))
    return next(fits, max(least, 2 * radius))


class BKTree:
    """Numbers by Hamming distance: a child hangs on the edge of its distance."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while at != new:
            edge = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(edge, new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The positions of the values within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            kids = self.children[at]
            if kids:
                if len(kids) <= 2 * radius:
                    todo.extend(kid for edge, kid in kids.items() if abs(edge - distance) <= radius)
                else:
                    todo.extend(kids[edge] for edge in range(distance - radius, distance + radius + 1) if edge in kids)


def tree_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A link to its root for each value in a component of two or more."""
    parent = list(range(len(values)))
    tree = BKTree()
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            _join(parent, i, j)
        tree.add(value)
    yield from ((values[i], values[r]) for i in range(len(values)) if (r := _root(parent, i)) != i)


def cross_links(grown: list[int], asked: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links between two chunks that together connect all of their pairs."""
    tree = BKTree()
    for value in grown:
        tree.add(value)
    parent = list(range(len(grown) + len(asked)))
    for i, value in enumerate(asked, len(grown)):
        for j in tree.within(value, radius):
            _join(parent, i, j)
    every = grown + asked
    yield from ((every[i], every[r]) for i in range(len(every)) if (r := _root(parent, i)) != i)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _join(parent: list[int], i: int, j: int) -> None:
    a, b = _root(parent, i), _root(parent, j)
    if a != b:
        parent[max(a, b)] = min(a, b)


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_max: int = SHARD_MAX) -> DataFrame:
    """``(a, b)``: links of distinct fingerprints (column ``fp``) that connect exactly
    those that a chain of steps within the radius connects."""
    spark = prints.sparkSession
    ship(spark)
    masks = [m - 2**64 if m >= 2**63 else m for m in shard_masks(blocks, radius)]
    shards = F.array(*(F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)))
    dealt = prints.select("fp", F.explode(shards).alias("shard")).select("shard.choice", "shard.bits", "fp")
    dealt = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    schema = "choice short, bits long, chunk int, a long, b long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (choice, bits), chunks in _groups(batches, 2, shard_max, alone=False):
            first, more = next(chunks), next(chunks, None)
            if more is None:
                found = list(tree_links(first, radius)) if len(first) > 1 else []
                if found:
                    yield _rows([(choice, bits, -1, a, b) for a, b in found], schema)
                continue
            yield _rows([(choice, bits, 0, a, None) for a in first], schema)
            number = 1
            while more is not None:
                yield _rows([(choice, bits, number, a, None) for a in more], schema)
                number, more = number + 1, next(chunks, None)

    found = materialize(dealt.mapInArrow(search, schema), "shard-links")
    large = found.filter("chunk >= 0").select("choice", "bits", "chunk", F.col("a").alias("fp"))
    spread = large.join(large.groupBy("choice", "bits").agg(F.max("chunk").alias("last")), ["choice", "bits"])
    as_tree = F.transform(F.sequence("chunk", "last"), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_query = F.transform(F.sequence(F.lit(0), "chunk"), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side")))
    pairs = spread.select("choice", "bits", "fp", F.explode(F.concat(as_tree, as_query)).alias("at")).select("choice", "bits", "at.i", "at.j", "at.side", "fp")
    pairs = pairs.filter("i < j or side = 0").repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, list[int]] | None = None
        for (*where, side), chunks in _groups(batches, 5, shard_max):
            values = next(chunks)
            if where[2] == where[3]:
                out = list(tree_links(values, radius))
            elif side == 0:
                held, out = (tuple(where), values), []
            else:
                out = list(cross_links(held[1], values, radius)) if held and held[0] == tuple(where) else []
            if out:
                yield _rows(out, "a long, b long")

    return found.filter("chunk < 0").select("a", "b").unionByName(pairs.mapInArrow(meet, "a long, b long"))


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """A batch of the rows; unsigned numbers become signed longs."""
    kinds = {"short": pa.int16(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = ([v - 2**64 if v is not None and v >= 2**63 else v for v in c] for c in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, most: int, alone: bool = True) -> Iterator[tuple[tuple, Iterator[list[int]]]]:
    """Runs of equal keys in sorted batches (the first columns), each with the last
    column's values in chunks of at most ``most``. ``alone``: are runs of one value
    wanted too?"""
    stream = _runs(batches, n_keys, alone)
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def chunks(key=key) -> Iterator[list[int]]:
            nonlocal ahead
            held: list[int] = []
            while ahead is not None and ahead[0] == key:
                held.extend(ahead[1])
                while len(held) > most:
                    yield held[:most]
                    held = held[most:]
                ahead = next(stream, None)
            yield held

        own = chunks()
        yield key, own
        for _ in own:
            pass


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, alone: bool) -> Iterator[tuple[tuple, list[int]]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        values = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], batch.num_rows)
        last = len(starts) - 1
        for n, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if not alone and b - a == 1 and 0 < n < last:
                continue
            yield tuple(k[a].item() for k in keys), values[a:b].tolist()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)`` for each node of ``edges (a, b)`` that isn't its component's
    smallest node, the root."""
    star = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = _state(star)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: the larger neighbours of a node go to the least of it and its neighbours
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("top")).filter("top > u")
        centres = near.select("u", F.least("u", "m").alias("m"))
        large = materialize(_met(star.select(F.col("v").alias("u"), F.col("u").alias("v")), centres).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: a node with several smaller neighbours sends them to the least; others stay
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        sent = _met(large, near.filter("n > 1").select("u", "m")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = sent.unionByName(near.filter("n = 1").select("u", F.col("m").alias("v")))
        star = materialize(small.filter("u <> v").distinct(), "small-star")
        before, state = state, _state(star)
        if state == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _met(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """``edges (u, v)`` with the ``m`` of ``centres (u, m)``. A node may have any number of
    edges: they are dealt over ``SALTS`` tasks by ``v``, and each centre goes to all of them."""
    spread = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = centres.select(F.col("u").alias("k"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    return spread.join(copies, (F.col("u") == F.col("k")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def _state(star: DataFrame) -> tuple:
    """Three numbers that tell whether a step changed the links."""
    return tuple(star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))).first())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None, shard_max: int = SHARD_MAX) -> DataFrame:
    """``(doc_id, digest, fp, component_id)``, a row for each row of ``docs``; the number of
    blocks follows from that of the fingerprints, if it isn't given."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    roots = components(links(least.select("fp"), radius, blocks or blocks_for(least.count(), radius), shard_max))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_doc", "root")
    members = named.filter("root is not null").groupBy("root").agg(F.min("first_doc").alias("least_member")).select(F.col("root").alias("r"), "least_member")
    # a root is no node of its own: its name and its members' meet here
    own = named.join(members, F.coalesce("root", "fp") == F.col("r"), "left")
    heads = named.filter("root is null").select(F.col("fp").alias("head"), F.col("first_doc").alias("head_doc"))
    linked = own.filter("root is not null").join(heads, F.col("root") == F.col("head")).select("fp", F.least("least_member", "head_doc").alias("component_id"))
    alone = own.filter("root is null").select("fp", F.least("first_doc", "least_member").alias("component_id"))
    classes = materialize(linked.unionByName(alone), "classes").select(F.col("fp").alias("of"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("of")).drop("of")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns: the one with the smallest id (null
    ids last, then by text hash); of repeated rows one stays."""
    found = near_duplicates(docs, id_col, text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"))
    # components of null ids alone have no name; their fingerprint's class stands in
    key = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    best = found.groupBy(key.alias("component")).agg(F.min(rank).alias("best")).select(F.col("best.doc_id").alias("keep_id"), F.col("best.digest").alias("keep_digest"))
    digest, number, turn = (free_name(docs, n) for n in ("digest", "number", "turn"))
    hashed = docs.withColumns({digest: F.xxhash64(text_of(text_col)), number: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))})
    best = best.select(F.coalesce(F.col("keep_id").cast("long"), F.lit(_NO_ID)).alias(number), F.col("keep_digest").alias(digest))
    once = F.row_number().over(Window.partitionBy(number, digest).orderBy(digest))
    return hashed.join(best, [number, digest], "left_semi").withColumn(turn, once).filter(F.col(turn) == 1).drop(digest, number, turn)
