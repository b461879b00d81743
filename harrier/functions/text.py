"""Tokenisers, analysers and path functions as columns.

Regular expressions meant for any script carry ``(?U)``: Java's ``\\w`` and ``\\b``
are ASCII without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from harrier.functions.porter import Stemmer

#: The token pattern, and the English stop words of the "beir" analyser.
TOKEN = "[A-Za-z0-9_./-]+"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """The default analyser: tokens are cut first and lower-cased then."""
    return F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def alnum_tokens(text: Column | str, stem: bool = False) -> Column:
    """The "beir" analyser: lower-case runs of ``[a-z0-9]`` without stop words, and
    stemmed if asked for."""
    cut = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(cut, lambda t: ~t.isin(*STOPWORDS))
    return porter(kept) if stem else kept


def analyzer(name: str):
    """The analyser of a name; an unknown name is an error."""
    known = {"default": tokens, "beir": lambda text: alnum_tokens(text, stem=True), "alnum": alnum_tokens}
    if name not in known:
        raise ValueError(f"unknown analyser {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def word_runs(text: Column | str) -> Column:
    """Runs of letters, digits and underscores of any script, with their marks."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_\p{M}]*"), F.lit(0))


def lexical_query(text: Column | str) -> Column:
    """Distinct lower-case word runs, without ``or``, joined by ``or``."""
    runs = F.array_distinct(F.transform(word_runs(text), F.lower))
    return F.array_join(F.filter(runs, lambda t: t != "or"), " or ")


def overlap_tokens(text: Column | str, longer_than: int = 1) -> Column:
    """Distinct lower-case ``[A-Za-z0-9_]+`` of more than so many characters."""
    cut = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(cut, lambda t: F.char_length(t) > longer_than))


def claim_text(text: Column | str) -> Column:
    """Lower case without Markdown marks, other characters than ``[a-z0-9.]`` as spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[*_`~]+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9.]+", " "))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """The folder of a path; empty for a bare name."""
    return F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)


def suffix(path: Column | str) -> Column:
    """The last extension with its dot, lower case; empty if there is none (a leading
    dot of a name starts no extension)."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def path_words(path: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(path), "[_/.-]+", " "))


def run_id(*texts: Column | str) -> Column:
    """The number of the first text that names a run, without leading zeros; or null."""
    found = [F.nullif(F.regexp_extract(F.coalesce(_col(t), F.lit("")), r"(?i)run[_\-]?0*(\d+)", 1), F.lit("")) for t in texts]
    return F.coalesce(*(F.when(x.isNotNull(), F.regexp_replace(x, "^0+(?=.)", "")) for x in found))


def glob_match(path: Column | str, pattern: str) -> Column:
    """Shell-style match of the whole path: ``*``, ``?`` and ``[...]``, case kept."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = pattern[i + 1 : close].replace("\\", r"\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = close
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return _col(path).rlike(f"(?s)^{out}$")


def literal_within(value: Column, text: Column) -> Column:
    """Is ``value`` in ``text`` as it is, not as part of a longer word or number?"""
    quoted = F.concat(F.lit("(?i)(?<![\\w.])\\Q"), value, F.lit("\\E(?![\\w.])"))
    return F.rlike(text, quoted)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """The share of ``a``'s distinct tokens that ``b`` has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def porter(words: Column | str) -> Column:
    """Porter stems of the tokens, in Arrow batches."""
    return F.pandas_udf(_stemmed, ArrayType(StringType()))(_col(words))


def _stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stems = Stemmer()  # remembers the stems it has made
    for words in batches:
        yield words.map(lambda ws: [stems(w) for w in ws] if ws is not None else None)
