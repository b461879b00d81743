"""Evidence for research questions, cards of what to build, and whether code is supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.operators.evidence import FIELDS
from harrier.operators.ranking import small
from harrier.operators.versions import prefer_current

#: Terms that lead to sources, encoders that code may name, and what cards hold.
SOURCE_TERMS = ("fusion", "dinov2", "trellis", "encoder", "render")
ENCODERS = ("dinov2", "resnet50", "clip")
ASKED_RUN = r"(?i)\brun[_\s-]?0*(\d+)\b"
CARD_FILES = {"streamlit": "app.py", "jupyter-analysis": "analysis.py", "pytest": "test_artifact.py", "research-repro": "reproduce.py", "python-lib": "lib.py"}
FUSION_TESTS = ("assert fuse([1, 2], True) == [1, 2]", "assert fuse([1, 2], False) == 1")
RATE_TEST = "assert '3e-4' in str(LR) or LR == 3e-4 or abs(float(LR) - 3e-4) < 1e-9"

#: The rank of an item that the search itself didn't find.
UNRANKED = 10_000
#: Terms of queries that are broadcast at most.
TERM_ROWS = 100_000


def _role(path: Column, run: Column) -> Column:
    config = F.concat(F.lit("configs/run_"), F.lpad(run, 3, "0"), F.lit(".yaml"))
    # longer numbers aren't cut to three digits
    config = F.when(F.char_length(run) > 3, F.concat(F.lit("configs/run_"), run, F.lit(".yaml"))).otherwise(config)
    roles = [path == config, path.startswith("paper/"), path.endswith(".py"), path.startswith("logs/"), path.endswith(".sbatch"), path.contains("checkpoint")]
    out = F.lit(len(roles))
    for i in reversed(range(len(roles))):
        out = F.when(roles[i], i).otherwise(out)
    return out


def research_evidence(queries: DataFrame, base: DataFrame, chunks: DataFrame, versions: DataFrame, k: int = 12, terms: tuple[str, ...] = SOURCE_TERMS) -> DataFrame:
    """``(query_id, item, path, role, rank)``: the base hits, widened and ordered by role.

    ``queries (query_id, query)``; ``base (query_id, item, rank)``; ``chunks (item, path,
    text)``; ``versions`` as from ``versions.clusters``. A query that names a run gets the
    chunks of that run. The terms that these candidates' texts hold bring in the Python
    chunks that hold one of them. Superseded paths go. The order: role, shared source
    terms, shared query tokens, rank in the base, path, item. A null query names no run
    and has no tokens; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    named = F.concat("path", F.lit(" "), text)
    run = F.nullif(F.regexp_extract(F.coalesce("query", F.lit("")), ASKED_RUN, 1), F.lit(""))
    asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), F.regexp_replace(run, "^0+(?=.)", "").alias("run"))
    found = base.select("query_id", "item")
    of_run = asked.filter("run is not null").select("query_id", "run").join(chunks.select("item", T.run_id("path", "text").alias("run")), "run").select("query_id", "item")
    first = found.unionByName(of_run).distinct()

    def holds(x: Column) -> Column:
        return F.array_compact(F.array(*(F.when(x.contains(t), F.lit(t)) for t in terms)))

    said = first.join(chunks.select("item", F.explode(holds(F.lower(text))).alias("term")), "item").select("query_id", "term").distinct()
    sources = chunks.filter(F.lower("path").endswith(".py")).select("item", F.explode(holds(F.lower(named))).alias("term"))
    more = sources.join(small(said, TERM_ROWS), "term").select("query_id", "item")
    source_terms = said.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    words = chunks.select("item", "path", F.array_distinct(T.tokens(named)).alias("words"))
    rows = first.unionByName(more).distinct().join(words, "item").join(asked, "query_id").join(source_terms, "query_id", "left").join(base.select("query_id", "item", F.col("rank").alias("found")), ["query_id", "item"], "left")
    scored = rows.select(
        "query_id", "query", "item", "path", F.coalesce("found", F.lit(UNRANKED)).alias("rank"),
        _role(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), F.col("run")).alias("role"),
        F.coalesce(F.size(F.array_intersect("terms", "words")), F.lit(0)).alias("by_terms"), F.size(F.array_intersect(T.tokens("query"), "words")).alias("by_query"),
        F.coalesce("found", F.lit(UNRANKED)).alias("found"),
    )
    order = Window.partitionBy("query_id").orderBy("role", F.desc("by_terms"), F.desc("by_query"), "found", "path", "item")
    kept = prefer_current(scored, versions).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return kept.select("query_id", "item", "path", "role", "rank")


def spec_cards(queries: DataFrame, hits: DataFrame, n: int = 4) -> DataFrame:
    """``(query_id, goal, template, citations, tests, file_path, ready)`` for each query.

    ``hits (query_id, path, start_byte, end_byte, chunk_id, rank)``; the first ``n`` are the
    citations, in their order. A card is ready if it has a goal and a citation; a query
    without hits has no citations.
    """
    q = F.coalesce("query", F.lit(""))
    low = F.lower(q)
    any_of = lambda *words: F.greatest(*(low.contains(w) for w in words)) if len(words) > 1 else low.contains(words[0])
    template = (
        F.when(any_of("streamlit", "dashboard"), "streamlit").when(any_of("notebook", "jupyter", "plot"), "jupyter-analysis")
        .when(any_of("test"), "pytest").when(any_of("reproduc", "from the paper", "paper2code"), "research-repro").otherwise("python-lib")
    )
    none = F.array().cast("array<string>")
    tests = F.concat(F.when(low.contains("fusion"), F.array(*map(F.lit, FUSION_TESTS))).otherwise(none), F.when(q.rlike(r"(?i)learning.?rate|3e-4"), F.array(F.lit(RATE_TEST))).otherwise(none))
    cite = F.struct("rank", F.struct("path", "start_byte", "end_byte", "chunk_id").alias("c"))
    cited = hits.filter(F.col("rank") <= n).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(cite)), lambda x: x["c"]).alias("citations"))
    files = F.create_map(*(F.lit(x) for pair in CARD_FILES.items() for x in pair))
    cards = queries.join(cited, "query_id", "left").select("query_id", F.trim(q).alias("goal"), template.alias("template"), F.coalesce("citations", F.array()).alias("citations"), tests.alias("tests"))
    return cards.withColumns({"file_path": F.concat(F.lit("artifacts/"), files[F.col("template")]), "ready": (F.col("goal") != "") & (F.size("citations") > 0)})


def unsupported_claims(code: DataFrame, hits: DataFrame) -> DataFrame:
    """``(id, field, value, nth)``: what ``code (id, text)`` states and no hit ``(id, text)``
    supports. A value is supported if a hit holds it or the field's name; an encoder, if a
    hit names it. ``nth`` counts a field's statements from 0. Null texts state nothing."""
    text = F.coalesce("text", F.lit(""))

    def statements(field: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(rf"(?i){field}\s*[:=]\s*([A-Za-z0-9.eE+\-]+)"), F.lit(1))
        return F.transform(values, lambda v, i: F.struct(F.lit(field).alias("field"), v.alias("value"), i.cast("long").alias("nth"), F.lower(v).alias("a"), F.lit(field).alias("b")))

    stated = F.flatten(F.array(*map(statements, FIELDS)))
    literal = F.array_compact(F.array(*(F.when(text.rlike(rf"ENCODER\s*=\s*['\"]{e}['\"]"), F.struct(F.lit("encoder literal").alias("field"), F.lit(e).alias("value"), F.lit(0).cast("long").alias("nth"), F.lit(e).alias("a"), F.lit(e).alias("b"))) for e in ENCODERS)))
    claims = code.select("id", F.explode(F.concat(stated, literal)).alias("c")).select("id", "c.*")
    low = hits.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("hit"))
    backed = claims.join(low, "id").filter(F.contains("hit", "a") | F.contains("hit", "b")).select("id", "field", "nth", "value").distinct()
    return claims.join(backed, ["id", "field", "nth", "value"], "left_anti").select("id", "field", "value", "nth")


def information(hits: DataFrame, n: int = 4, chars: int = 400) -> DataFrame:
    """``(id, information)``: the first ``n`` hits ``(id, rank, path, start_byte, end_byte,
    text)``, a line with the start of each."""
    line = F.concat(F.col("path"), F.format_string(" [%d:%d] ", "start_byte", "end_byte"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.filter(F.col("rank") <= n).groupBy("id").agg(F.array_join(lines, "\n").alias("information"))


def rollouts(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """``(id, text, paths, cited)``: for each of ``questions (id, question)`` the trajectory of
    one search and the answer ``(id, answer)``; ``paths`` are the hits' distinct paths in
    order. A question without hits or answer has empty tags and isn't cited."""
    first = hits.groupBy("id", "path").agg(F.min("rank").alias("rank"))
    paths = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    rows = questions.join(information(hits), "id", "left").join(paths, "id", "left").join(answers.select("id", "answer"), "id", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(F.lit("<search>"), empty("question"), F.lit("</search>\n<information>"), empty("information"), F.lit("</information>\n<answer>"), empty("answer"), F.lit("</answer>"))
    listed = F.coalesce("paths", F.array().cast("array<string>"))
    return rows.select("id", text.alias("text"), listed.alias("paths"), ((F.size(listed) > 0) & (F.trim(empty("answer")) != "")).alias("cited"))


def fusion_changes(bm25: DataFrame, dense: DataFrame, relevant: DataFrame, keep: int = 50, k: int = 60, depth: int = 50) -> DataFrame:
    """``(query_id, path, change, dense_rank, bm25_rank, chunk_rank, rrf, kept, tied)`` of the
    relevant files ``(query_id, path)`` that fusing drops from the dense list or gains.

    Both lists are ``(query_id, item, path, rank)``. A file's rank is that of its first
    chunk among the list's distinct files; ``chunk_rank`` and ``rrf`` are those of its best
    chunk in the fused list, ``kept`` if that is within ``keep``, ``tied`` if its score is
    that of the last one kept. Equal scores go by first appearance, BM25 first.
    """
    lists = bm25.withColumn("leg", F.lit(0)).unionByName(dense.withColumn("leg", F.lit(1)))
    best = lists.groupBy("query_id", "item", "path").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 10).alias("rrf"), F.min(F.struct("leg", "rank")).alias("seen"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "seen.leg", "seen.rank")
    fused = best.withColumn("rank", F.row_number().over(turn))
    cut = fused.filter(F.col("rank") == keep).select("query_id", F.col("rrf").alias("cut"))

    def files(hits: DataFrame, name: str) -> DataFrame:
        first = hits.groupBy("query_id", "path").agg(F.min("rank").alias("first"))
        return first.select("query_id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path")).alias(name))

    of_chunk = fused.groupBy("query_id", "path").agg(F.min(F.struct("rank", "rrf")).alias("b"))
    rows = relevant.select("query_id", "path").distinct()
    for hits, name in ((dense, "dense_rank"), (bm25, "bm25_rank"), (fused.filter(F.col("rank") <= keep), "file_rank")):
        rows = rows.join(files(hits, name), ["query_id", "path"], "left")
    rows = rows.withColumns({"was": F.coalesce(F.col("dense_rank") <= depth, F.lit(False)), "now": F.coalesce(F.col("file_rank") <= depth, F.lit(False))}).filter("was <> now")
    rows = rows.join(of_chunk, ["query_id", "path"]).join(cut, "query_id", "left")
    return rows.select("query_id", "path", F.when(F.col("was"), "dropped").otherwise("gained").alias("change"), "dense_rank", "bm25_rank", F.col("b.rank").alias("chunk_rank"), F.col("b.rrf").alias("rrf"), (F.col("b.rank") <= keep).alias("kept"), F.coalesce(F.col("b.rrf") == F.col("cut"), F.lit(False)).alias("tied"))
