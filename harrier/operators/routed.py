"""Vector search by routing: coarse cells, and a layered graph in each shard of a cell.

Centroids are fitted on a bounded sample; every vector then goes to its ``spill``
nearest cells. A cell of many vectors is cut into shards, and a shard is one row of the
index: its items, its vectors and the layers of its graph. Upper layers hold a sixteenth
of the layer below. A query goes to its ``probes`` nearest cells only, whose folders are
all that is read. In a shard it descends greedily through the layers and ends with a
search with a beam of ``ef``; a batch of queries walks in step, as numpy operations.
Without ``ef`` the shards it is routed to are scanned by one matrix product, which is
cheaper for small shards.

Null vectors are neither found nor asked for. Repeated rows of one item are found once;
ties are broken by the item. An empty index and an empty batch give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.functions import vectors as V
from harrier.operators.dense import _best, _matrix, _query_blocks, unit_rows
from harrier.operators.ranking import top_k
from harrier.shipping import ship

#: Vectors of a cell, about, and of a shard of it at most (twice that, by chance).
CELL_ROWS = 512
SHARD_ROWS = 4_096
#: Cells at most, and vectors that the centroids are fitted on.
MAX_CELLS = 4_096
SAMPLE = 100_000
#: Cells that a vector goes to, and that a query is routed to.
SPILL = 2
PROBES = 16
#: A layer is this part of the one below; neighbours of a vector in each direction.
THIN = 16
NEIGHBOURS = 16
#: Queries whose cosines with all centroids are held at once: 8 MB for ``MAX_CELLS``.
_ROUTED_ROWS = 256

_SHARD = "cell int, chunk int, dim int, items array<long>, vecs binary, members array<binary>, links array<binary>"


@dataclass(frozen=True)
class RoutedIndex:
    """The stored shards and the cells' centroids (bounded by ``MAX_CELLS``)."""

    shards: DataFrame
    centroids: np.ndarray


def write_routed(vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS, spill: int = SPILL, neighbours: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, seed: int = 0, item: str = "vec_id", vector: str = "embedding") -> None:
    """Build the index once and write it below ``path``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.transform(vector, lambda x: x.cast("float")).alias("vec"))
    n = rows.count()
    cells = max(1, min(MAX_CELLS, -(-n // cell_rows)))
    spark.createDataFrame([(c.tolist(),) for c in _centroids(rows, n, cells, sample, seed)], "centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    routes = _routes(rows, read_centroids(spark, path), spill)
    many = routes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("chunks"))
    dealt = routes.join(F.broadcast(many), "cell")  # a row for each cell
    dealt = dealt.select("cell", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int").alias("chunk"), "item", "vec")

    def build(key: tuple, held: pa.Table) -> pa.Table:
        items, first = np.unique(held.column("item").to_numpy(), return_index=True)
        raw = _matrix(held.column("vec").combine_chunks())[first]
        layers = build_layers(unit_rows(raw).astype(np.float32), neighbours, seed)
        row = {"cell": [key[0].as_py()], "chunk": [key[1].as_py()], "dim": [raw.shape[1]], "items": [items], "vecs": [raw.astype(np.float32).tobytes()], "members": [[m.tobytes() for m, _ in layers]], "links": [[x.tobytes() for _, x in layers]]}
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds)], names=list(row))

    built = dealt.groupBy("cell", "chunk").applyInArrow(build, _SHARD)
    built.write.partitionBy("cell").parquet(f"{path}/shards")


def _centroids(rows: DataFrame, n: int, cells: int, sample: int, seed: int) -> np.ndarray:
    """Cell centroids by spherical k-means on a sample of about ``sample`` vectors."""
    if not n:
        return np.zeros((0, 1))
    part = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(2**20)) < int(2**20 * sample / n))
    unit = part.select(array_to_vector(V.unit("vec")).alias("features"))
    if cells == 1:
        return np.ones((1, len(rows.first().vec)))
    return np.array(KMeans(k=cells, initMode="random", maxIter=10, seed=seed).fit(unit).clusterCenters())


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centroids").toArrow().column("centroid")
    return unit_rows(_matrix(found.combine_chunks())) if len(found) else np.zeros((0, 1))


def read_routed(spark: SparkSession, path: str) -> RoutedIndex:
    return RoutedIndex(spark.read.schema(_SHARD).parquet(f"{path}/shards"), read_centroids(spark, path))


def _routes(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """``rows (item, vec)`` with ``cell``: a row for each of a vector's nearest cells."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def nearest(vecs: pa.Array) -> pa.Array:
        if not len(shared.value):
            return pa.array([[]] * len(vecs), pa.list_(pa.int32()))
        return pa.array(list(_nearest_cells(unit_rows(_matrix(vecs)), shared.value, most)), pa.list_(pa.int32()))

    return rows.select(F.explode(nearest("vec")).alias("cell"), "*")


def _nearest_cells(unit: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    far = -(unit @ centroids.T)
    if most < far.shape[1]:
        some = np.sort(np.argpartition(far, most - 1, axis=1)[:, :most], axis=1)
    else:
        some = np.broadcast_to(np.arange(far.shape[1]), far.shape)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1).astype(np.int32)


def build_layers(own: np.ndarray, neighbours: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down: members (positions of vectors), and for each a row of links, as
    positions in the layer; a short row is filled up with the member itself."""
    order = np.random.default_rng(seed).permutation(len(own))
    sizes = [len(own)]
    while sizes[-1] > THIN * 2:
        sizes.append(sizes[-1] // THIN)
    layers = []
    for size in reversed(sizes):
        members = np.sort(order[:size]) if size < len(own) else np.arange(len(own))
        layers.append((members.astype(np.int32), _links(own[members], neighbours)))
    return layers


def _links(own: np.ndarray, neighbours: int) -> np.ndarray:
    """Each vector's nearest ones and those it is nearest to, ``2 * neighbours`` at most."""
    n = len(own)
    near = own @ own.T
    np.fill_diagonal(near, -2)
    m = min(neighbours, n - 1)
    if m < 1:
        return np.zeros((n, 1), np.int32)
    to = np.argsort(-near, axis=1, kind="stable")[:, :m]
    both = np.zeros((n, n), bool)
    both[np.repeat(np.arange(n), m), to.ravel()] = True
    both |= both.T
    ranked = np.argsort(np.where(both, -near, 3.0), axis=1, kind="stable")[:, : min(2 * neighbours, n)]
    real = np.take_along_axis(both, ranked, 1)
    return np.where(real, ranked, np.arange(n)[:, None]).astype(np.int32)


def descend(own: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray) -> np.ndarray:
    """For each query the vector that greedy steps lead to, from the first member of the top
    layer down to the last but one."""
    at = np.zeros(len(asked), np.int64)  # positions of vectors
    if len(layers) > 1:
        at += layers[0][0][0]
    for members, links in layers[:-1]:
        here = np.searchsorted(members, at)
        score = np.einsum("qd,qd->q", own[members[here]], asked)
        moving = np.arange(len(asked))
        while len(moving):
            around = links[here[moving]]
            near = np.einsum("qmd,qd->qm", own[members[around]], asked[moving])
            pick = near.argmax(axis=1)
            best = near[np.arange(len(moving)), pick]
            up = best > score[moving]
            moving = moving[up]
            here[moving], score[moving] = around[up, pick[up]], best[up]
        at = members[here].astype(np.int64)
    return at


def beam_search(own: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, ef: int) -> np.ndarray:
    """Positions of the ``ef`` best vectors that each query meets, -1 where there are fewer: in each
    step every query still under way looks at the links of its best vector not yet looked at."""
    n, links, q = len(own), layers[-1][1], len(asked)
    ef = min(ef, n)
    ids, score, done = np.full((q, ef), -1), np.full((q, ef), -np.inf), np.zeros((q, ef), bool)
    ids[:, 0] = descend(own, layers, asked)
    score[:, 0] = np.einsum("qd,qd->q", own[ids[:, 0]], asked)
    seen = np.zeros((q, n), bool)
    seen[np.arange(q), ids[:, 0]] = True
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), -np.inf, score[live])
        pick = open_.argmax(axis=1)
        on = open_[np.arange(len(live)), pick] > -np.inf
        live, pick = live[on], pick[on]
        if not len(live):
            break
        done[live, pick] = True
        around = links[ids[live, pick]]
        fresh = ~seen[live[:, None], around]
        seen[live[:, None], around] = True
        near = np.where(fresh, np.einsum("qmd,qd->qm", own[around], asked[live]), -np.inf)
        every = np.hstack([score[live], near])
        keep = np.argsort(-every, axis=1, kind="stable")[:, :ef]
        score[live] = np.take_along_axis(every, keep, 1)
        ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(fresh, around, -1)]), keep, 1)
        done[live] = np.take_along_axis(np.hstack([done[live], np.zeros_like(fresh)]), keep, 1)
    return ids


def routed_top_k(index: RoutedIndex, queries: DataFrame, k: int, ef: int | None = 64, probes: int = PROBES, vector: str = "embedding") -> DataFrame:
    """``(query_id, item, score, rank)``: the best cosines that each query (``query_id`` a whole
    number) finds in its cells; ``ef`` None scans them. Queries are taken in blocks of bounded size
    (``dense.QUERY_BLOCK``), so nothing that is sent grows with the batch; a block reads its cells' shards once."""
    spark = queries.sparkSession
    ship(spark)
    best = None
    for asked in _query_blocks(queries, vector):
        part = _block_top_k(index, asked, k, ef, probes)
        best = part if best is None else best.unionByName(part)
    best = best.groupBy("query_id", "item").agg(F.max("score").alias("score"))
    return top_k(best, k).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))


def _block_top_k(index: RoutedIndex, asked: tuple[np.ndarray, np.ndarray], k: int, ef: int | None, probes: int) -> DataFrame:
    """``(query_id, item, score)``, in the shards that a block of queries is routed to. The block goes out
    once, as arrays; which of its queries look into a cell is told by their rows."""
    cell, row = _cells_of(asked[1], index.centroids, probes)
    # the cells' numbers (MAX_CELLS at most) prune the folders
    cells = np.unique(cell).tolist()
    met = index.shards.filter(F.col("cell").isin(cells) if cells else F.lit(False))
    shared = index.shards.sparkSession.sparkContext.broadcast((*asked, cell, row))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, cell, row = shared.value
        for batch in batches:
            for shard in batch.to_pylist():
                own = unit_rows(np.frombuffer(shard["vecs"], np.float32).reshape(-1, shard["dim"]).astype(np.float64))
                some = row[np.searchsorted(cell, shard["cell"]) : np.searchsorted(cell, shard["cell"], "right")]
                items = np.array(shard["items"])
                width = [len(m) // 4 for m in shard["members"]]
                layers = [(np.frombuffer(m, np.int32), np.frombuffer(x, np.int32).reshape(n, -1)) for n, m, x in zip(width, shard["members"], shard["links"])]
                step = max(1, 4_000_000 // len(own))
                for part in (some[at : at + step] for at in range(0, len(some), step)):
                    yield _found(own, items, layers, ids[part], vecs[part], k, ef)

    return met.select("cell", "dim", "items", "vecs", "members", "links").mapInArrow(search, "query_id long, item long, score double")


def _cells_of(asked: np.ndarray, centroids: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell and the row of a query that is routed to it, by cell."""
    if not len(asked) or not len(centroids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = [_nearest_cells(asked[at : at + _ROUTED_ROWS], centroids, probes) for at in range(0, len(asked), _ROUTED_ROWS)]
    cell = np.concatenate(near)
    row = np.repeat(np.arange(len(asked)), cell.shape[1])
    order = np.argsort(cell.ravel(), kind="stable")
    return cell.ravel()[order].astype(np.int64), row[order]


def _found(own: np.ndarray, items: np.ndarray, layers: list, ids: np.ndarray, asked: np.ndarray, k: int, ef: int | None) -> pa.RecordBatch:
    if ef is None:
        scores, found = _best(np.round(asked @ own.T, V.SCORE_DECIMALS), np.broadcast_to(items, (len(ids), len(items))), k)
    else:
        at = beam_search(own.astype(np.float32), layers, asked.astype(np.float32), max(ef, k))
        scores = np.where(at < 0, -np.inf, np.round(np.einsum("qd,qcd->qc", asked, own[at]), V.SCORE_DECIMALS))
        scores, found = _best(scores, items[at], k)
    keep = (scores > -np.inf).ravel()
    return pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, scores.shape[1])[keep], "item": found.ravel()[keep], "score": scores.ravel()[keep]})


def shards_read(index: RoutedIndex, queries: DataFrame, probes: int = PROBES, vector: str = "embedding") -> DataFrame:
    """``(query_id, read, shards)``: how many of the index's shards each query looks into."""
    rows = queries.filter(F.col(vector).isNotNull()).select(F.col("query_id").alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    per = index.shards.groupBy("cell").agg(F.count("*").alias("n"))
    by = _routes(rows, index.centroids, probes).join(F.broadcast(per), "cell").groupBy(F.col("item").alias("query_id")).agg(F.sum("n").alias("read"))
    return by.withColumn("shards", per.agg(F.sum("n")).scalar())
