"""Graphs of files and entities: edges, hops, components, communities, page rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.ranking import top_k
from harrier.scratch import checkpointed
from harrier.shipping import ship

#: How texts refer to files, and what names entities.
PATH_REFERENCE = r"(?:[\w.\-]+/)+[\w.\-]+\.(?:ya?ml|py|csv|md|out|sbatch|json|png|pdf)"
IMPORT = r"(?m)^\s*(?:from|import)\s+([\w.]+)"
INCLUDE = r"(?:include|source|config|checkpoint)\s*[:=]\s*['\"]?([^\s'\"]+)"
ENCODER = r"(?i)\b(dinov2|resnet50|clip|vit-b/?\d*)\b"
BARK = r"(?i)\bbark(?:_type)?\s*[:=]\s*([A-Za-z]+)"
FIELDS = r"(?i)\b(learning_rate|val_rmse|num_pairs|fusion)\s*[:=]\s*([A-Za-z0-9.eE+\-]+)"
DECIMALS = 12


def _each(column: str, pattern: str, group: int) -> Column:
    return F.explode(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(pattern), F.lit(group)))


def file_edges(files: DataFrame, window_s: float = 3600.0) -> DataFrame:
    """``(src, dst, kind)`` of ``files (path, text, mtime)``: contains, references, imports,
    same_run and co_modified, with repeats as the texts repeat them.

    References meet files on whole paths or names, never in all pairs; files modified
    within the window meet on their folder and the hour of the window.
    """
    paths = files.select(F.col("path").alias("dst"))
    named = paths.withColumns({"name": T.basename("dst"), "stem": T.stem("dst")})
    contains = files.withColumn("src", T.parent("path")).filter("src <> ''").select("src", F.col("path").alias("dst"), F.lit("contains").alias("kind"))
    whole = files.select(F.col("path").alias("src"), _each("text", PATH_REFERENCE, 0).alias("dst")).join(paths, "dst").filter("src <> dst").select("src", "dst", F.lit("references").alias("kind"))
    asked = files.filter(F.col("path").endswith(".py")).select(F.col("path").alias("src"), _each("text", IMPORT, 1).alias("module"))
    # "a.b" means a path ending in a/b.py, or a file named b: either has the stem b, or it
    # ends within a name, which is found by the suffixes of names
    modules = asked.withColumns({"stem": F.element_at(F.split("module", r"\."), -1)})
    imports = modules.join(named, "stem").filter("src <> dst").select("src", "dst", F.lit("imports").alias("kind"))
    tails = named.select("dst", "stem", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.char_length("name") - 3, F.lit(2))), lambda i: F.substring("name", i, F.char_length("name")))).alias("tail")).filter(F.col("tail").endswith(".py"))
    within = modules.filter(~F.col("module").contains(".")).withColumn("tail", F.concat("stem", F.lit(".py"))).drop("stem").join(tails, "tail").filter("src <> dst").select("src", "dst", F.lit("imports").alias("kind"))
    included = files.select(F.col("path").alias("src"), _each("text", INCLUDE, 1).alias("ref")).withColumn("name", T.basename("ref"))
    includes = included.join(named, "name").filter("src <> dst").select("src", "dst", F.lit("references").alias("kind"))
    runs = files.select("path", T.run_id("path", "text").alias("run")).filter("run is not null")
    same = runs.select("run", F.col("path").alias("src")).join(runs.select("run", F.col("path").alias("dst")), "run").filter("src < dst").select("src", "dst", F.lit("same_run").alias("kind"))
    return contains.unionByName(whole).unionByName(imports).unionByName(within).unionByName(includes).unionByName(same).unionByName(co_modified(files, window_s))


def co_modified(files: DataFrame, window_s: float = 3600.0) -> DataFrame:
    """Pairs of a folder's files whose times differ by at most the window: each file is
    compared with those of its own and the next slot of that length."""
    slot = F.floor(F.col("mtime") / window_s)
    rows = files.select("path", "mtime", T.parent("path").alias("folder"), slot.alias("slot"))
    a = rows.select("folder", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), F.col("path").alias("src"), F.col("mtime").alias("ta"))
    b = rows.select("folder", "slot", F.col("path").alias("dst"), F.col("mtime").alias("tb"))
    near = (F.col("tb") - F.col("ta")).between(0, window_s) & ((F.col("ta") < F.col("tb")) | (F.col("src") < F.col("dst")))
    return a.join(b, ["folder", "slot"]).filter(near).select("src", "dst", F.lit("co_modified").alias("kind"))


def hops(edges: DataFrame, seeds: DataFrame, n: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """``(seed, node, hop)``: the nodes within ``n`` undirected steps of each seed, the seed
    at 0, each at its least distance."""
    used = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    steps = used.select("src", "dst").union(used.select("dst", "src")).toDF("node", "next").distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, n + 1):
        found = frontier.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def expanded(seeds: DataFrame, edges: DataFrame, n: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """``(query_id, node, position)``: the seeds ``(query_id, seed, rank)`` in their order,
    each followed by the nodes within ``n`` steps of it by name; a node stands where it
    comes first. Each distinct seed is walked from once, whatever the number of queries."""
    near = hops(edges, seeds.select("seed").distinct(), n, kinds)
    first = seeds.join(near, "seed").groupBy("query_id", "node").agg(F.min(F.struct("rank", (F.col("hop") > 0).alias("later"))).alias("at"))
    turn = Window.partitionBy("query_id").orderBy("at.rank", "at.later", "node")
    return first.withColumn("position", F.row_number().over(turn)).select("query_id", "node", "position")


def triples(chunks: DataFrame) -> DataFrame:
    """``(src, relation, dst, evidence)`` of the runs that ``chunks (path, text)`` name, as
    often as the text says them."""
    rows = chunks.withColumn("run", T.run_id("path", "text")).filter("run is not null").withColumn("src", F.concat(F.lit("run:"), "run"))
    parts = []
    for relation, prefix, pattern in (("uses_encoder", "encoder:", ENCODER), ("uses_bark", "bark:", BARK)):
        parts.append(rows.select("src", F.lit(relation).alias("relation"), _each("text", pattern, 1).alias("v"), "path").select("src", "relation", F.concat(F.lit(prefix), F.lower("v")).alias("dst"), F.col("path").alias("evidence")))
    fields = F.arrays_zip(F.regexp_extract_all("text", F.lit(FIELDS), F.lit(1)).alias("field"), F.regexp_extract_all("text", F.lit(FIELDS), F.lit(2)).alias("value"))
    parts.append(rows.select("src", F.explode(fields).alias("f"), "path").select("src", F.concat(F.lit("has_"), F.lower(F.col("f").getField("field"))).alias("relation"), F.lower(F.col("f").getField("value")).alias("dst"), F.col("path").alias("evidence")))
    parts.append(rows.filter("path <> ''").select("src", F.lit("documented_in").alias("relation"), F.concat(F.lit("file:"), "path").alias("dst"), F.col("path").alias("evidence")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def adjacency(found: DataFrame) -> DataFrame:
    """``(a, b, weight)``: symmetric counts of the triples between two nodes."""
    both = found.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(found.select("dst", "src"))
    return both.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def connected(edges: DataFrame, checkpoint_every: int = 2, rounds: int = 100) -> DataFrame:
    """``(node, component)`` of ``edges (a, b)``: the smallest node of each component.

    Each round takes the least label of the neighbours, and then the label of the
    label, so long chains settle in few rounds; labels that still move after ``rounds``
    are an error. Lineage is cut in the shared folder
    that the session's ``spark.checkpoint.dir`` names.
    """
    # read in every round: written once, dealt by the node that its neighbours are gathered for
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    held: list[DataFrame] = []
    for turn in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = nearer.select(F.col("node").alias("label"), F.col("component").alias("further"))
        stepped = nearer.join(jump, F.col("component") == F.col("label"), "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component"))
        cut = turn % checkpoint_every == checkpoint_every - 1
        stepped = checkpointed(stepped) if cut else stepped.cache()
        moved = stepped.filter("component <> before").limit(1).count()
        labels = stepped.select("node", "component")
        if not moved:
            return labels
        if cut:  # what was cached before isn't needed any more
            for old in held:
                old.unpersist()
            held = []
        else:
            held.append(stepped)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def communities(found: DataFrame) -> DataFrame:
    """``(community, node, size)`` of the triples' components with two nodes or more,
    numbered by size and then the smallest node."""
    labels = connected(found.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    numbered = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "component")) - 1)  # a row for each community
    return labels.join(numbered, "component").select("community", "node", "size")


def match_communities(queries: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """``(query_id, item, score, rank)``: the communities that share the most words with
    each query. Both sides meet on words."""
    words = members.select("community", F.explode(F.array_distinct(T.tokens(F.regexp_replace("node", ":", " ")))).alias("word")).distinct()
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens("text"))).alias("word"))
    scored = asked.join(words, "word").groupBy("query_id", F.col("community").alias("item")).agg(F.count("*").alias("score"))
    return top_k(scored, k)


#: Edges up to which page rank is worked out on a matrix in each task: 24 bytes each, 96 MB, and the nodes' names.
MATRIX_EDGES = 4_000_000


def page_rank(weights: DataFrame, seeds: DataFrame, rounds: int = 25, damping: float = 0.85, matrix_edges: int = MATRIX_EDGES) -> DataFrame:
    """``(query_id, node, mass)``: personalised page rank over ``weights (a, b, weight)``
    from ``seeds (query_id, node, mass)``; without seeds, from all nodes alike.

    A graph of at most ``matrix_edges`` edges is broadcast as a matrix, and each group of
    queries is a few sparse products; a larger one is joined with the mass in each round.
    """
    seeds = seeds.select(F.col("query_id").cast("long").alias("query_id"), "node", F.col("mass").cast("double").alias("mass"))
    if weights.limit(matrix_edges + 1).count() > matrix_edges:
        return _page_rank_joined(weights, seeds, rounds, damping)
    edges = weights.select("a", "b", "weight").orderBy("a", "b").toArrow()
    names = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks], pa.string()))
    names = names.take(pc.sort_indices(names))
    src, dst = (pc.index_in(edges[c], value_set=names).to_numpy().astype(np.int64) for c in "ab")
    weight = edges["weight"].to_numpy()
    out = np.bincount(src, weight, max(len(names), 1))
    share = weight / out[src] if len(src) else weight
    del edges
    ship(weights.sparkSession)
    shared = weights.sparkSession.sparkContext.broadcast((names, src, dst, share))

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        names, src, dst, share = shared.value
        n = len(names)
        at = pc.fill_null(pc.index_in(table["node"], value_set=names), -1).to_numpy()
        start = np.bincount(at[at >= 0], table["mass"].to_numpy()[at >= 0], n)
        start = start / start.sum() if start.sum() > 0 else np.full(n, 1 / max(n, 1))
        p = start
        for _ in range(rounds):
            p = damping * np.bincount(dst, share * p[src], n) + (1 - damping) * start
        return pa.table({"query_id": pa.repeat(pa.scalar(key[0].as_py(), pa.int64()), n), "node": names, "mass": np.round(p, DECIMALS)})

    return seeds.groupBy("query_id").applyInArrow(walk, "query_id long, node string, mass double")


def _page_rank_joined(weights: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Page rank by joins: in each round the mass of a node goes over its edges."""
    out = weights.groupBy("a").agg(F.sum("weight").alias("out"))
    steps = checkpointed(weights.join(out, "a").select(F.col("a").alias("node"), "b", (F.col("weight") / F.col("out")).alias("share")))
    nodes = steps.select("node").union(steps.select("b")).distinct()
    known = seeds.groupBy("query_id", "node").agg(F.sum("mass").alias("mass")).join(nodes, "node").filter("mass > 0")
    total = known.groupBy("query_id").agg(F.sum("mass").alias("total"))
    led = known.join(total, "query_id").select("query_id", "node", (F.col("mass") / F.col("total")).alias("start"))
    lost = seeds.select("query_id").distinct().join(total, "query_id", "left_anti")
    n = nodes.count()
    start = checkpointed(led.unionByName(lost.crossJoin(nodes).select("query_id", "node", F.lit(1 / max(n, 1)).alias("start"))))
    p = start.select("query_id", "node", F.col("start").alias("mass"))
    for turn in range(rounds):
        moved = p.join(steps, "node").groupBy("query_id", F.col("b").alias("node")).agg(F.sum(F.col("mass") * F.col("share")).alias("in"))
        mass = damping * F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.coalesce("start", F.lit(0.0))
        p = moved.join(start, ["query_id", "node"], "full").select("query_id", "node", mass.alias("mass"))
        if turn % 5 == 4:
            p = checkpointed(p)
    every = seeds.select("query_id").distinct().crossJoin(nodes)
    return every.join(p, ["query_id", "node"], "left").select("query_id", "node", F.round(F.coalesce("mass", F.lit(0.0)), DECIMALS).alias("mass"))


def seeds_of(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, node, mass)``: 1.5 for a node that the query names exactly, .5 for each
    that holds the name, in any case. A name starts with its kind (``run:``), so both
    sides meet on what follows a kind in a node, cut at each length."""
    q = F.coalesce(F.col("text"), F.lit(""))
    run = F.coalesce(T.run_id("text"), F.nullif(F.regexp_extract(q, r"(?i)\brun\s+0*(\d+)\b", 1), F.lit("")))
    names = F.concat(
        F.when(run.isNotNull(), F.array(F.concat(F.lit("run:"), run))).otherwise(F.array().cast("array<string>")),
        F.transform(F.regexp_extract_all(q, F.lit(ENCODER), F.lit(1)), lambda x: F.concat(F.lit("encoder:"), F.lower(x))),
        F.transform(F.regexp_extract_all(q, F.lit(BARK), F.lit(1)), lambda x: F.concat(F.lit("bark:"), F.lower(x))),
    )
    named = queries.select("query_id", F.explode_outer(F.array_distinct(names)).alias("seed"))
    low = F.lower("node")

    def after(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(low)), lambda i: F.when(F.substring(low, i, F.lit(len(kind))) == kind, F.substring(low, i, F.char_length(low))))

    tails = F.filter(F.flatten(F.array(*map(after, ("run:", "encoder:", "bark:")))), lambda x: x.isNotNull())
    heads = F.flatten(F.transform(tails, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda n: F.substring(t, F.lit(1), n))))
    keyed = nodes.filter("node <> ''").select("node", F.explode(F.array_distinct(heads)).alias("key"))
    held = named.filter("seed is not null").withColumn("key", F.lower("seed")).join(keyed, "key").select("query_id", "node", F.when(F.col("node") == F.col("seed"), 1.5).otherwise(0.5).alias("mass"))
    return held.unionByName(named.select("query_id").distinct().select("query_id", F.lit("").alias("node"), F.lit(0.0).alias("mass")))


def path_mass(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(query_id, path, mass)``: for each file the mass of both ends of its triples."""
    ends = found.select("evidence", F.explode(F.array("src", "dst")).alias("node"))
    return ends.join(ranks, "node").groupBy("query_id", F.col("evidence").alias("path")).agg(F.round(F.sum("mass"), DECIMALS).alias("mass"))


def intent(query: Column, path: Column) -> Column:
    """How well a path's kind suits the question. The words and weights are fixed values."""
    q, p = F.lower(query), F.lower(path)
    end = T.suffix(p)
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return (
        add(q.rlike(r"\b(slurm|job|launch(?:ed)?)\b") & (end == ".sbatch"), 2.0)
        + add(q.rlike(r"\b(source|module|code|documents?)\b") & (end == ".py"), 2.0)
        + add(q.contains("checkpoint") & (p.contains("checkpoint") | end.isin(".ckpt", ".pt", ".pth")), 2.0)
        + add(q.rlike(r"\b(paper|draft)\b") & (p.startswith("paper/") | (end == ".md")), 1.5)
        + add(q.contains("config") & p.startswith("configs/"), 1.5)
        + add(q.rlike(r"\b(log|rmse)\b") & (p.startswith("logs/") | end.isin(".log", ".out")), 0.75)
    )


def boosted(hits: DataFrame) -> DataFrame:
    """Hits ``(query_id, query, path, rank, mass)`` in the order of three fused ranks:
    their own, by intent and graph mass, and by intent (weight 1.1)."""
    by = Window.partitionBy("query_id")
    rows = hits.withColumn("intent", intent(F.col("query"), F.col("path")))
    graph = F.row_number().over(by.orderBy(F.desc("intent"), F.round(F.coalesce("mass", F.lit(0.0)), DECIMALS).desc(), F.desc("path")))
    kind = F.row_number().over(by.orderBy(F.desc("intent"), F.desc("path")))
    scored = rows.withColumns({"graph_rank": graph, "intent_rank": kind})
    score = F.round(1 / (60 + F.col("rank")) + 1 / (60 + F.col("graph_rank")) + F.lit(1.1) / (60 + F.col("intent_rank")), 10)
    return scored.withColumn("score", score).withColumn("new_rank", F.row_number().over(by.orderBy(F.desc("score"), "rank")))


def hierarchy(chunks: DataFrame) -> DataFrame:
    """``(level, name, n_chunks, summary)`` for files, folders and the corpus, of ``chunks
    (path, chunk_id, text)``: heads of the first six chunks, 800 characters. Each level
    keeps six heads of each group before they are gathered."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    heads = chunks.select("path", "chunk_id", T.parent("path").alias("folder"), F.substring(F.array_join(F.slice(lines, 1, 3), " "), 1, 400).alias("head"))
    out = None
    for level, name in (("file", F.col("path")), ("folder", F.col("folder")), ("corpus", F.lit("corpus"))):
        named = heads.withColumn("name", name)
        counts = named.groupBy("name").agg(F.count("*").alias("n_chunks"))
        few = named.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("path", "chunk_id"))).filter("at <= 6")
        text = few.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "head"))).alias("h"))
        summary = F.substring(F.concat("name", F.lit(": "), F.array_join(F.transform("h", lambda x: x["head"]), " | ")), 1, 800)
        part = counts.join(text, "name").select(F.lit(level).alias("level"), "name", "n_chunks", summary.alias("summary"))
        out = part if out is None else out.unionByName(part)
    return out
