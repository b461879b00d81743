"""Host-level quality rules with an empirical beta prior.

Each document is measured and held against rules; the failures of each rule are
summed by host. A host's rate of failures is shrunk towards that of all hosts: a
beta prior is fitted to the hosts' rates by the method of moments, and the rate is
the posterior mean, so a host of few documents says little.

Host verdicts meet the documents again in two ways. A host that is worse than the corpus
in a rule is *suspect* in it: its documents that fail the rule go, while on other hosts a
failure is let pass (a table of prices on a host of prose isn't junk). It is worse if the
lower end of its posterior (mean less ``sure`` standard deviations of the beta) exceeds
``factor`` times the prior's mean; so the bar follows from the corpus, for each rule. A host whose shrunk rate reaches ``reject_rate`` for any rule is
*rejected*, with all its documents. Documents that fail a base rule (``too_short``,
``repetitive``) go by themselves.

A null text has no words; very long texts are measured whole. A null host is a host of
its own. Repeated rows count and are judged as often as they occur. Empty tables have
no hosts and give no rows. Other columns pass through, whatever their names. Texts are
measured in one pass; verdicts are broadcast only if there are at most
``BROADCAST_HOSTS`` hosts with any, and joined by a shuffle beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from harrier.llm.common import free_name, materialize, ship, slices, text_of
from harrier.operators.ranking import small

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: The mean length of words, in characters, that a document should have.
MEAN_WORD = (2, 20)
#: A host is suspect in a rule if its rate exceeds the corpus' rate this many times, and how
#: sure that must be: standard deviations, one-sided 95 %.
FACTOR = 1.0
SURE = 1.645
#: The shrunk rate of failures from which on a host is rejected.
REJECT_RATE = 0.75
BROADCAST_HOSTS = 10_000

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words that the text has more than once."""
    n = len(words)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    codes, spread = ids[: n - size + 1], len(number)
    for k in range(1, size):
        if codes.size and int(codes.max()) >= 2**62 // spread:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        codes = codes * spread + ids[k : n - size + 1 + k]
    _, where, count = np.unique(codes, return_inverse=True, return_counts=True)
    again = count[where] > 1
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[k : n - size + 1 + k] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return n


def measure(text: str) -> tuple[int, int, int, int, int]:
    """``MEASURES`` of a text. ``bytes.split`` splits at exactly ``[\\x20\\x09-\\x0D]``."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), repeated_lines(text), repeated_words(words)


def rule_failures(measure_of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The rules, as conditions on the measures that a failing document meets."""
    words = measure_of("n_words")
    return {
        "too_short": words < MIN_WORDS,
        "repetitive": 100 * measure_of("n_repeat_words") > REPEAT_PERCENT * words,
        "symbols": 10 * measure_of("n_symbols") > words,
        "word_length": (words > 0) & ((measure_of("word_chars") < MEAN_WORD[0] * words) | (measure_of("word_chars") > MEAN_WORD[1] * words)),
        "repeated_lines": 10 * measure_of("n_dup_lines") > words,
    }


def with_measures(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``into`` of the ``MEASURES``: one narrow pass, in which
    only texts go to Python."""
    ship(docs.sparkSession)
    kind = StructType([StructField(m, LongType()) for m in MEASURES])

    @F.arrow_udf(kind)
    def measures(texts: pa.Array) -> pa.Array:
        found = [measure(t) for part in slices(texts) for t in part.to_pylist()]
        columns = zip(*found, strict=True) if found else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)

    return docs.withColumn(into, measures(text_of(text_col)))


def host_verdicts(measures: DataFrame, factor: float = FACTOR, reject_rate: float = REJECT_RATE) -> DataFrame:
    """``(host, n_docs, <rule>_rate..., suspect_in array<string>, rejected)``: the shrunk
    rates of each host and its verdicts, of ``measures (host, *MEASURES)``."""
    rules = rule_failures()
    hosts = measures.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(cond.cast("long")).alias(rule) for rule, cond in rules.items()))
    share = {rule: F.col(rule) / F.col("n_docs") for rule in rules}
    # two numbers for each rule reach the driver
    moments = hosts.agg(*(f(share[rule]).alias(f"{rule}_{name}") for rule in rules for name, f in (("mean", F.avg), ("var", F.var_samp)))).first()
    rates, worse = {}, {}
    for rule in rules:
        alpha, beta = beta_prior(moments[f"{rule}_mean"], moments[f"{rule}_var"])
        weight = F.col("n_docs") + F.lit(alpha + beta)
        rate = rates[rule] = (F.col(rule) + F.lit(alpha)) / weight
        worse[rule] = rate - F.lit(SURE) * F.sqrt(rate * (1 - rate) / (weight + 1)) > F.lit(factor * alpha / (alpha + beta))
    suspect = F.array_compact(F.array(*(F.when(above, rule) for rule, above in worse.items())))
    return hosts.select("host", "n_docs", *(c.alias(f"{rule}_rate") for rule, c in rates.items()), suspect.alias("suspect_in"), (F.greatest(*rates.values()) >= reject_rate).alias("rejected"))


def beta_prior(mean: float | None, var: float | None, least: float = 2.0, most: float = 1e4) -> tuple[float, float]:
    """Alpha and beta of the prior whose mean and variance the hosts' rates have; its
    weight (documents' worth) is kept between ``least`` and ``most``."""
    mean = min(max(mean or 0.0, 1e-3), 1 - 1e-3)
    weight = mean * (1 - mean) / var - 1 if var else most
    weight = min(max(weight, least), most)
    return mean * weight, (1 - mean) * weight


def _verdict(measure_of: Callable[[str], Column], suspect_in: str = "suspect_in", rejected: str = "rejected") -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` of a row that has met its host's verdict (nulls: none)."""
    rules = rule_failures(measure_of)
    base = rules["too_short"] | rules["repetitive"]
    gone = F.coalesce(F.col(rejected), F.lit(False))
    for rule, fails in rules.items():
        gone = gone | (fails & F.coalesce(F.array_contains(F.col(suspect_in), rule), F.lit(False)))
    return base.alias("base_failed"), (~base & ~gone).alias("kept")


def _bad_hosts(measures: DataFrame, factor: float, reject_rate: float) -> DataFrame:
    """The hosts with any verdict, ready to be joined."""
    hosts = host_verdicts(measures, factor, reject_rate).filter("rejected or size(suspect_in) > 0")
    return small(materialize(hosts.select("host", "suspect_in", "rejected"), "host-verdicts"), BROADCAST_HOSTS)


def judged(docs: DataFrame, host_col: str = "source", factor: float = FACTOR, reject_rate: float = REJECT_RATE) -> DataFrame:
    """``(doc_id, *MEASURES, base_failed, kept)``, a row for each row of ``docs``."""
    narrow = docs.select("doc_id", F.col(host_col).cast("string").alias("host"), "text")
    measures = materialize(with_measures(narrow, "measures").select("doc_id", "host", "measures.*"), "measures")
    bad = _bad_hosts(measures, factor, reject_rate).withColumnRenamed("host", "bad_host")
    return measures.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left").select("doc_id", *MEASURES, *_verdict(F.col))


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text", factor: float = FACTOR, reject_rate: float = REJECT_RATE) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows are written once with
    their measures; texts aren't shuffled unless more hosts than may be broadcast have a
    verdict."""
    found, host, suspect, rejected = (free_name(docs, n) for n in ("measures", "bad_host", "suspect_in", "rejected"))
    rows = materialize(with_measures(docs, found, text_col), "measured")
    source = F.col(host_col).cast("string")
    bad = _bad_hosts(rows.select(source.alias("host"), f"{found}.*"), factor, reject_rate).toDF(host, suspect, rejected)
    _, kept = _verdict(lambda m: F.col(found).getField(m), suspect, rejected)
    return rows.join(bad, source.eqNullSafe(F.col(host)), "left").filter(kept).select(docs.columns)
