"""Query understanding as columns: routes, gates, splits, rewrites.

Fixed values: the patterns and word lists below decide routes and labels, so they are
stated as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as T

PATH = r"(?i)(?:^|[\s`'\"(])((?:[\w.\-]+/)+[\w.\-]+|[\w.\-]+\.(?:ya?ml|jsonl?|py|md|txt|out|sbatch|csv|pdf|ckpt|pt|png)|(?:config_)?run[_\-]?0*\d+\.(?:ya?ml|json))"
AGGREGATION = r"(?i)\b(how many|which run|which ablation|lowest|highest|average|mean|fewest|most|count|min(?:imum)?|max(?:imum)?|compare|versus|vs\.?)\b"
ARTIFACT = r"(?i)\b(reproduc(?:e|ibility)|paper2code|from the paper|acm badge|artifact bundle|collect run|research artifact)\b"
CODE = r"(?i)\b(implement|refactor|write (?:a )?(?:test|function|patch|script)|generate (?:code|a test)|unit test|add a test|fix the bug|propose a patch|code artifact)\b"
EXACT = r"(--[\w\-]+(?:=\S+)?|`[^`]+`|\"[^\"]+\"|'[^']+')"
COMPARATIVE = r"(?i)\b(compare|versus|vs\.?|between|changed|difference|diff|older|newer)\b"

#: Patterns that need no retrieval, with their reasons, in order.
SKIPS = [
    ("greeting", r"(?i)^\s*(hi|hello|hey|greetings|good\s+(morning|afternoon|evening))\b"),
    ("thanks", r"(?i)^\s*(thanks?|thank\s+you|thx)\b"),
    ("meta_identity", r"(?i)^\s*(?:who|what)\s+are\s+you\b"),
    ("meta_capability", r"(?i)^\s*(?:what\s+can\s+you\s+do|help|how\s+do\s+(?:I|you)\s+use)\b"),
    ("textbook_concept", r"(?i)^\s*(?:define|what\s+(?:is|are)\s+(?:a|an|the)\s+)(?:neural\s+network|gradient\s+descent|backprop|transformer|attention|convolution|rnn|lstm|gan|vae|diffusion)\b"),
]
SIGNALS = [
    r"(?i)run[_\s]?\d+",
    r"(?i)config",
    r"(?i)\.yaml|\.py|\.csv|\.sbatch|\.out",
    r"(?i)learning[_\s]?rate|lr\b|rmse|epoch|encoder|fusion",
    r"(?i)file|document|corpus|data|log|script|draft|paper",
    r"(?i)which|where|show|open|list|find|search|retrieve",
    r"(?i)current|latest|archive|version",
]
LEVELS = [
    ("corpus", ["what's in", "what is in", "overview", "summarize the corpus", "what do i have"]),
    ("folder", ["this folder", "directory", "under configs", "in logs"]),
    ("file", ["whole file", "entire file", "this file"]),
]


def _q(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def route(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with ``route``, ``skip_embed`` and ``skip_rerank``: the first kind that fits."""
    q = _q(text)
    kind = F.when(q.rlike(PATH), "lexical_path").when(q.rlike(AGGREGATION), "aggregation_query").when(q.rlike(ARTIFACT), "research_artifact").when(q.rlike(CODE), "code_production").otherwise("semantic")
    out = queries.withColumn("route", kind)
    return out.withColumns({"skip_embed": F.col("route") == "lexical_path", "skip_rerank": F.col("route").isin("lexical_path", "aggregation_query")})


def gate(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with ``decision``, ``reason`` and ``confidence``: is retrieval needed?"""
    q = _q(text)
    hits = sum((q.rlike(p).cast("int") for p in SIGNALS), F.lit(0))
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    ladder = [(q == "", "skip", "empty_query", 1.0)]
    ladder += [(q.rlike(p), "skip", reason, 0.9) for reason, p in SKIPS]
    ladder += [(hits >= 2, "retrieve", "strong_corpus_signal", 0.95), (hits == 1, "retrieve", "corpus_signal", 0.7), ((words <= 3) & ~q.endswith("?"), "uncertain", "short_ambiguous", 0.4)]
    best = F.struct(F.lit("retrieve").alias("decision"), F.lit("default_retrieve").alias("reason"), F.lit(0.6).alias("confidence"))
    for cond, decision, reason, confidence in reversed(ladder):
        best = F.when(cond, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))).otherwise(best)
    return queries.withColumn("gate", best).select(*queries.columns, "gate.*")


def level(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with ``level``: corpus, folder, file or chunk."""
    q = F.lower(F.coalesce(F.col(text), F.lit("")))
    out: Column = F.lit("chunk")
    for name, words in reversed(LEVELS):
        cond = F.lit(False)
        for w in words:
            cond = cond | q.contains(w)
        out = F.when(cond, name).otherwise(out)
    return queries.withColumn("level", out)


COMPARE = r"(?i)^(?:compare|difference between|diff between)\s+(.+?)\s+(?:and|with|vs\.?)\s+(.+)"
CONJUNCTION = r"(?i)\s+and\s+(?:also\s+)?"
SUPERLATIVE = r"(?i)^(?:which|what)\s+(\w+)\s+.*?(?:had|has|with)\s+the\s+(?:lowest|highest|best|worst|most|least|maximum|minimum)\s+(.+)"
CHAIN = r"(?i)^(.+?)\s+(?:then|and then|,\s*then)\s+(.+)"


def parts_of(q: Column, distinct: bool = True) -> Column:
    """The sub-queries of a query, in order; distinct without regard to case, or as they stand."""
    conj = F.split(q, CONJUNCTION)
    whole = (F.size(conj) >= 2) & F.forall(conj, lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) >= 3)
    pair = lambda p: F.array(F.trim(F.regexp_extract(q, p, 1)), F.trim(F.regexp_extract(q, p, 2)))
    metric = F.regexp_replace(F.trim(F.regexp_extract(q, SUPERLATIVE, 2)), r"\?+$", "")
    listing = F.array(F.concat(F.lit("list all "), F.regexp_extract(q, SUPERLATIVE, 1), F.lit(" "), metric), q)
    subs = F.when(q.rlike(COMPARE), pair(COMPARE)).when(whole, F.transform(conj, lambda x: F.trim(x))).when(q.rlike(SUPERLATIVE), listing).when(q.rlike(CHAIN), pair(CHAIN)).otherwise(F.array(q))
    return distinct_folded(subs) if distinct else subs


def distinct_folded(items: Column, trim: bool = True) -> Column:
    """The items without empty ones and later equals, without regard to case and, if trimmed, to blanks around them."""
    bare = F.trim if trim else lambda s: s
    lowered = F.transform(items, lambda s: F.lower(bare(s)))
    kept = F.filter(F.transform(items, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (bare(x["s"]) != "") & (F.array_position(lowered, F.lower(bare(x["s"]))) == x["i"] + 1))
    return F.transform(kept, lambda x: x["s"])


def decompose(queries: DataFrame, text: str = "text", distinct: bool = True) -> DataFrame:
    """A row ``(query_id, part, sub_query)`` for each sub-query of the trimmed query; if not
    ``distinct``, of the query as it is, with empty and equal ones."""
    subs = parts_of(_q(text)) if distinct else parts_of(F.coalesce(F.col(text), F.lit("")), False)
    safe = F.when(F.size(subs) == 0, F.array(F.lit(""))).otherwise(subs)
    return queries.select("query_id", F.posexplode(safe).alias("part", "sub_query"))


IDENTIFIERS = r"(?i)\b(?:run[_\s-]?\d+|dinov2|fusion|rmse|learning[_\s]?rate)\b"


def expansions(q: Column, n: int = 3, trim: bool = True) -> Column:
    """The query, its identifiers alone, and its "current" form; padded with the query."""
    ids = F.array_join(F.regexp_extract_all(q, F.lit(IDENTIFIERS), F.lit(0)), " ")
    low = F.lower(q)
    asks = low.contains("learning rate") | low.contains("lr") | low.contains("draft") | low.contains("config")
    current = F.when((q != "") & ~low.contains("current") & asks, F.concat(F.lit("current "), q)).otherwise(F.lit(""))
    unique = distinct_folded(F.array(q, ids, current), trim)
    return F.when(q == "", F.array(F.lit(""))).otherwise(F.slice(F.concat(unique, F.array_repeat(q, n)), 1, n))


def expand(queries: DataFrame, n: int = 3, text: str = "text", trim: bool = True) -> DataFrame:
    """A row ``(query_id, part, expansion)`` for each form of the query, trimmed or as it is."""
    q = _q(text) if trim else F.coalesce(F.col(text), F.lit(""))
    return queries.select("query_id", F.posexplode(expansions(q, n, trim)).alias("part", "expansion"))


def corrective(rows: DataFrame) -> DataFrame:
    """Of hits ``(query_id, query, path, chunk)``: ``relevance`` and ``label`` of each.

    The share of the query's tokens in the chunk, .15 for any in the path, .2 for a run
    that both name; .6 is correct, .3 ambiguous.
    """
    q, c, p = T.overlap_tokens("query"), T.overlap_tokens("chunk"), T.overlap_tokens("path")
    runs = lambda col: F.regexp_extract_all(F.col(col), F.lit(r"(?i)run[_\s]?(\d+)"), F.lit(1))
    share = F.size(F.array_intersect(q, c)) / F.size(q)
    relevance = F.round(share + F.when(F.size(F.array_intersect(q, p)) > 0, 0.15).otherwise(0.0) + F.when(F.size(F.array_intersect(runs("query"), runs("chunk"))) > 0, 0.2).otherwise(0.0), 10)
    out = rows.withColumn("relevance", F.when(F.size(q) > 0, relevance))
    r = F.col("relevance")
    return out.withColumn("label", F.when(r.isNull(), "ambiguous").when(r >= 0.6, "correct").when(r >= 0.3, "ambiguous").otherwise("incorrect"))


def correction(labelled: DataFrame, least_correct: float = 0.3) -> DataFrame:
    """``(query_id, correct, ambiguous, incorrect, action)`` of labelled hits."""
    n = lambda label: F.sum((F.col("label") == label).cast("long"))
    by = labelled.groupBy("query_id", "query").agg(n("correct").alias("correct"), n("ambiguous").alias("ambiguous"), n("incorrect").alias("incorrect"))
    q, low = F.trim("query"), F.lower("query")
    words = F.size(F.filter(F.split(F.col("query"), r"\s+"), lambda w: w != ""))
    intricate = (words > 8) | low.contains(" and ") | low.contains("compare") | low.contains("which") | low.contains("between")
    total = F.col("correct") + F.col("ambiguous") + F.col("incorrect")
    action = F.when(F.col("correct") / total >= least_correct, "none").when(F.col("ambiguous") > F.col("incorrect"), "refine").when(intricate & (F.size(parts_of(q)) > 1), "decompose").otherwise("rewrite")
    return by.select("query_id", "correct", "ambiguous", "incorrect", action.alias("action"))


def rewritten(q: Column) -> Column:
    """Abbreviations written out; a named run's configuration path added."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r"(?i)\bLR\b", "learning_rate"), r"(?i)\bval\b", "validation"), r"(?i)\bconfig\b", "configuration yaml")
    run = F.regexp_extract(out, r"(?i)run[_\s]?(\d+)", 1)
    padded = F.when(F.char_length(run) < 3, F.lpad(run, 3, "0")).otherwise(run)
    named = (run != "") & ~F.lower(out).contains("config") & ~F.lower(out).contains("yaml")
    return F.when(named, F.concat(out, F.lit(" configs/run_"), padded, F.lit(".yaml"))).otherwise(out)


#: Words that say little in a question.
WEAK = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "about", "what", "which", "who",
    "whom", "this", "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "it", "its", "they",
    "them", "their",
)


def hypothesis(q: Column, weak: tuple[str, ...] = WEAK) -> Column:
    """A stand-in for an answer's text: the query's telling tokens, three times over. The
    sentence around them is a fixed value, since embeddings of it are compared."""
    words = F.regexp_extract_all(q, F.lit(T.TOKEN), F.lit(0))
    telling = F.filter(words, lambda t: (F.char_length(t) > 2) & ~F.lower(t).isin(*weak))
    key = F.when(F.size(telling) > 0, telling).otherwise(F.slice(words, 1, 5))
    joined = F.array_join(key, " ")
    return F.when(F.trim(q) == "", "").otherwise(F.concat(F.lit("This document contains information about "), joined, F.lit(". "), joined, F.lit(" "), joined, F.lit(" "), joined))


def with_path_tokens(hits: DataFrame, n_hits: int = 3, n_tokens: int = 6) -> DataFrame:
    """``(query_id, rewritten)``: the query with up to six new tokens of the paths of its
    first three hits ``(query_id, query, path, rank)``; one step of a search loop."""
    few = hits.filter(F.col("rank") <= n_hits).groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("l"))
    found = F.array_distinct(F.flatten(F.transform("l", lambda x: T.tokens(x["path"]))))
    present = T.tokens("query")
    fresh = F.slice(F.filter(found, lambda t: (F.char_length(t) > 2) & ~F.array_contains(present, t)), 1, n_tokens)
    return few.select("query_id", F.when(F.size(fresh) > 0, F.concat_ws(" ", F.col("query"), F.array_join(fresh, " "))).otherwise(F.concat(F.col("query"), F.lit(" details"))).alias("rewritten"))
