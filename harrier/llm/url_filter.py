"""URL filters: fixed rules first, then association rules mined from labels.

A fixed rule names a host, all its subdomains and a path's beginning; the longest
that fits decides. URLs that none fits are judged by mined rules. A labelled URL is
a set of tokens (host, the host's labels, words of the path, keys of the query) and,
where its label says so, the item *block*. FP-growth finds the frequent sets; a rule
``tokens -> block`` is kept if its support suffices (a share and a count) and if its
confidence does: the lower end of the confidence's interval (Wilson, ``Z``) must
reach ``MIN_CONFIDENCE`` and the share of all labelled URLs that are blocked, so the
bar is the higher the fewer pages speak for a rule. A rule of which a part is a rule
too is dropped, since the part fits wherever it does.

Tokens that are rules by themselves are found by one count and leave the sets that
FP-growth works on. So do tokens of every labelled URL, which change no set's numbers.
Tokens that stand in the same labelled URLs are one item of the fit, and its rules are
written out for each choice of them. Nothing else is left out: there is no cap on a URL's
tokens, on a rule's or on the number of rules; the fit's work is that of the frequent
sets of the classes that are left.

Matching goes by an inverted index: each rule is filed under its rarest token, so a
URL looks up its tokens, and only the rules found there are compared whole. Up to
``CONSTANT_RULES`` rules the index is a constant, evaluated in the scan: there is no
shuffle of pages. More are joined with the exploded tokens. All is DataFrame
operations; FP-growth is Spark's own.

A null URL, or one without ``://``, has an empty host and path, and no tokens. A
page is labelled by the labels with its id; of several, one that says block is
enough. Null labels say nothing. Repeated rows are judged alike. Of fixed rules of one length
the last by name wins. Without labels
there are no mined rules, and what no fixed rule blocks is allowed. Empty pages give
no rows; a URL of any length is judged whole; other columns aren't touched, whatever
their names.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import materialize
from harrier.operators.ranking import small

#: Fixed rules of the filter: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

MIN_SUPPORT = 0.005
MIN_COUNT = 5
#: What the lower end of a confidence's interval must reach, and the interval's width.
MIN_CONFIDENCE = 0.6
Z = 1.96
#: Rules that may be a constant, and rows that are broadcast where more are joined.
CONSTANT_RULES = 500
BROADCAST_RULES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_BLOCK = "label:block"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), _PARTS, group)


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def tokens_of(url: Column) -> Column:
    """The URL's tokens, each once."""
    host = host_of(url)
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: (x != "") & ~x.rlike("^[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.filter(F.split(_part(url, 3), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.element_at(F.split(x, "="), 1)))
    every = F.concat(F.array(F.concat(F.lit("H:"), host)), labels, words, keys)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, begins in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begins)
        out = F.when(fits, F.struct(F.lit(of + begins).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def labelled_tokens(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bad, tokens)``: a row for each labelled page."""
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    said = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return pages.select("page_id", tokens_of(F.col("url")).alias("tokens")).join(said, "page_id").select("bad", "tokens")


def lower_confidence(blocked: Column, seen: Column, z: float = Z) -> Column:
    """The lower end of Wilson's interval of the share ``blocked / seen``."""
    share, n = blocked / seen, seen
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """``(tokens)`` of all kept rules, in the shared folder; None where the bars can't be met."""
    # numbered once, on disk, so that a recomputed task doesn't number anew
    rows = materialize(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled-urls")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    need = max(math.ceil(min_support * n - 1e-9), min_count)
    if need > bad:
        return None
    bar = max(min_confidence, bad / n)
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    of_row = F.xxhash64("row"), F.xxhash64(F.lit(1), "row")
    stats = each.groupBy("token").agg(F.count("*").alias("seen"), F.sum(F.col("bad").cast("long")).alias("blocked"), *(F.bit_xor(h).alias(f"rows{i}") for i, h in enumerate(of_row)))
    stats = materialize(stats.filter(F.col("blocked") >= need).withColumn("sure", lower_confidence(F.col("blocked"), F.col("seen")) >= bar), "url-tokens")
    alone = stats.filter("sure").select(F.array("token").alias("tokens"))
    # tokens of the same rows: a class, named by its first token
    classes = stats.filter(~F.col("sure") & (F.col("seen") < n)).groupBy("seen", "rows0", "rows1").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("same"))
    classes = materialize(classes.select("token", "same"), "url-token-classes")
    sets = each.join(small(classes.select("token"), BROADCAST_RULES), "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.max("bad").alias("bad"))
    sets = materialize(sets.select(F.when(F.col("bad"), F.array_append("items", F.lit(_BLOCK))).otherwise(F.col("items")).alias("items")), "url-sets")
    fed = sets.count()
    if fed < need:
        return materialize(alone, "url-rules")
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / fed, minConfidence=min(bar, 1.0)).fit(sets)
    blocked = F.round(F.col("support") * fed)
    mined = model.associationRules.filter((F.element_at("consequent", 1) == _BLOCK) & (F.size("antecedent") > 1))
    mined = mined.select(F.array_sort("antecedent").alias("tokens"), blocked.alias("blocked"), F.round(blocked / F.col("confidence")).alias("seen"))
    mined = materialize(mined.filter(lower_confidence(F.col("blocked"), F.col("seen")) >= bar).select("tokens"), "mined-url-rules")
    return materialize(alone.unionByName(written_out(without_redundant(mined), classes)), "url-rules")


def written_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Rules over classes as rules over tokens: one for each choice of a token of each class
    (``classes (token, same)``)."""
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(small(classes, BROADCAST_RULES), "token")
    choices = F.aggregate(F.collect_list("same"), F.array(F.array().cast("array<string>")), lambda upto, same: F.flatten(F.transform(upto, lambda t: F.transform(same, lambda x: F.array_append(t, x)))))
    chosen = each.groupBy("tokens").agg(choices.alias("chosen")).select(F.explode("chosen").alias("tokens"))
    return chosen.select(F.array_sort("tokens").alias("tokens"))


def without_redundant(rules: DataFrame) -> DataFrame:
    """The rules but those of whose tokens a part is a rule. A rule has few parts (six of
    three tokens), so they are looked up rather than all rules compared."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2)
    parts = F.transform(masks, lambda m: F.filter("tokens", lambda x, i: F.getbit(m, i) == 1))
    wider = rules.filter(F.size("tokens") > 1).select("tokens", F.explode(parts).alias("part"))
    narrower = rules.select(F.col("tokens").alias("part"))
    return rules.join(wider.join(narrower, "part").select("tokens").distinct(), "tokens", "left_anti")


def matches(tokens: Column, rules: list[list[str]]) -> Column:
    """Does any rule (its tokens) have all its tokens in ``tokens``?"""
    if not rules:
        return F.lit(False)
    seen: dict[str, int] = {}
    for names in rules:
        for name in names:
            seen[name] = seen.get(name, 0) + 1
    index: dict[str, list[int]] = {}
    for number, names in enumerate(rules):
        index.setdefault(min(names, key=lambda t: (seen[t], t)), []).append(number)
    filed = F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")
    whole = F.from_json(F.lit(json.dumps(rules)), "array<array<string>>")
    found = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(filed, t), F.array().cast("array<int>"))))
    return F.exists(found, lambda i: F.size(F.array_except(F.element_at(whole, i + 1), tokens)) == 0)


def matched_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``(tokens)`` of ``sets`` that hold all tokens of any rule: both sides
    meet on the rule's rarest token."""
    each = rules.select(F.col("tokens").alias("names"), F.explode("tokens").alias("key"))
    rarity = each.groupBy("key").agg(F.count("*").alias("seen"))
    filed = each.join(rarity, "key").groupBy("names").agg(F.min(F.struct("seen", "key")).alias("rarest")).select("names", F.col("rarest.key").alias("key"))
    asked = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("key"))
    return asked.join(small(filed, BROADCAST_RULES), "key").filter(F.size(F.array_except("names", "tokens")) == 0).select("tokens").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row for each page."""
    mined = mine_rules(labelled_tokens(pages, labels), min_support)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens_of(F.col("url")).alias("tokens"))
    fixed = parts.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    few = [] if mined is None else mined.select("tokens").limit(CONSTANT_RULES + 1).collect()
    if len(few) <= CONSTANT_RULES:
        judged = fixed.withColumn("hit", matches(F.col("tokens"), [r.tokens for r in few]))
    else:
        # pages that a fixed rule decides, or without tokens, needn't be joined
        open_ = F.col("fixed").isNull() & (F.size("tokens") > 0)
        hits = matched_sets(fixed.filter(open_), mined).withColumn("hit", F.lit(True))
        judged = fixed.filter(open_).join(hits, "tokens", "left").unionByName(fixed.filter(~open_).withColumn("hit", F.lit(False)))
    by_method = F.when(F.col("hit"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", by_method).alias("verdict"))
