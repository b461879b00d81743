"""The operators bound to the driver's tables: ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrier.llm import bpe, chat, decontam, line_dedup, mixing, periodic, pii, quality, sharding, simhash, token_counts, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op8_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_line_dedup,
    op2_byte_bpe,
    op3_pii,
    op4_token_counts,
    op5_url_filter,
    op6_quality,
    op7_sharding,
    op8_chat_repair,
    op9_decontamination,
    op10_simhash,
    op11_whitening,
    op12_periodic_runs,
    op13_mixing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


#: A-Z lower-cased, as DuckDB expressions over {x}.
_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: White space at both ends, and words, by the contracts' class [\x20\x09-\x0D].
_BARE = "trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _rules_sql() -> dict[str, str]:
    return {
        "too_short": f"n_words < {quality.MIN_WORDS}",
        "repetitive": f"100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words",
        "symbols": "10 * n_symbols > n_words",
        "word_length": f"n_words > 0 AND (word_chars < {quality.MEAN_WORD[0]} * n_words OR word_chars > {quality.MEAN_WORD[1]} * n_words)",
        "repeated_lines": "10 * n_dup_lines > n_words",
    }


def _measures_sql() -> str:
    """The common tables up to ``m (doc_id, source, *MEASURES)``."""
    return rf"""
        d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, w[i : i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
        c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
        r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM c) GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE {_BARE.format(x="line")} <> '' GROUP BY doc_id),
        m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
              FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id))"""


def _quality_sql() -> str:
    """Measures, rules, the beta prior by moments, and the hosts' verdicts."""
    rules = _rules_sql()
    counts = ", ".join(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::DOUBLE AS {rule}" for rule, cond in rules.items())
    moments = ", ".join(f"least(greatest(avg({r} / n_docs), 1e-3), 1 - 1e-3) AS {r}_m, var_samp({r} / n_docs) AS {r}_v" for r in rules)
    weights = ", ".join(f"least(greatest(CASE WHEN {r}_v > 0 THEN {r}_m * (1 - {r}_m) / {r}_v - 1 ELSE 1e4 END, 2), 1e4) AS {r}_w" for r in rules)
    rate = {r: f"({r} + {r}_m * {r}_w) / (n_docs + {r}_w)" for r in rules}
    spread = {r: f"{quality.SURE}::DOUBLE * sqrt({x} * (1 - {x}) / (n_docs + {r}_w + 1))" for r, x in rate.items()}
    suspects = ", ".join(f"{x} - {spread[r]} > {quality.FACTOR}::DOUBLE * {r}_m * {r}_w / {r}_w AS {r}_suspect" for r, x in rate.items())
    fails = " OR ".join(f"({r}_suspect AND ({cond}))" for r, cond in rules.items())
    return rf"""
        WITH {_measures_sql()},
        h AS (SELECT source, count(*)::DOUBLE AS n_docs, {counts} FROM m GROUP BY source),
        p AS (SELECT {moments} FROM h), q AS (SELECT *, {weights} FROM p),
        v AS (SELECT source, greatest({", ".join(rate.values())}) >= {quality.REJECT_RATE} AS rejected, {suspects} FROM h, q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {rules["too_short"]} OR {rules["repetitive"]} AS base_failed,
               NOT ({rules["too_short"]} OR {rules["repetitive"]}) AND NOT rejected AND NOT ({fails}) AS kept
        FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""


def _mix_sql() -> str:
    """Sizes, the level of the shares by the order in which sources fill up, exponential keys, running sums."""
    failed = " + ".join(f"(CASE WHEN {cond} THEN 1 ELSE 0 END)" for cond in _rules_sql().values())
    u = "((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || n_words || '/mix'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656)"
    weight = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
        WITH {_measures_sql()},
        k AS (SELECT doc_id, source, n_words AS size, -ln({u}) / (1::DOUBLE / (1 + {failed})) AS key FROM m),
        s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM k GROUP BY source),
        a AS (SELECT *, CASE rank % {len(mixing.WEIGHTS)} {weight} END AS weight, {mixing.MOST} * source_size AS cap FROM s),
        f AS (SELECT cap / weight AS fills, rank, (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a),
        b AS (SELECT source, source_size, least(cap, weight * (SELECT coalesce(arg_min(level, struct_pack(f := fills, r := rank)) FILTER (level <= fills), 0) FROM f)) AS target FROM a),
        o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
        t AS (SELECT doc_id, size, before, b.source_size::BIGINT AS source_size, target, round(target)::BIGINT AS budget, CASE WHEN b.source_size > 0 THEN floor(round(target) / b.source_size)::BIGINT ELSE 0 END AS epochs
              FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(budget - epochs * source_size - before, size), 0) AS BIGINT) AS taken FROM t"""


def _url_sql() -> str:
    """The fixed rules, all sets of the tokens that are frequent among blocked pages, and their rules."""
    parts = r"'://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
    fits = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS of, '{p}' AS begins" for v, h, p in url_filter.RULES)
    z = f"{url_filter.Z}::DOUBLE"
    lower = f"(p + {z} * {z} / (2 * seen) - {z} * sqrt(p * (1 - p) / seen + {z} * {z} / (4 * seen * seen))) / (1 + {z} * {z} / seen)"
    return rf"""
        WITH a AS (SELECT page_id, {_FOLD.format(x=f"regexp_extract(coalesce(url, ''), {parts}, 1)")} AS host, regexp_extract(coalesce(url, ''), {parts}, 2) AS path, regexp_extract(coalesce(url, ''), {parts}, 3) AS query FROM pages),
        t AS (SELECT *, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_distinct(['H:' || host] || list_transform(string_split(host, '.'), lambda x: 'h:' || x)
              || list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]')), lambda x: 'p:' || x)
              || list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1))) END AS tokens FROM a),
        s AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
        b AS (SELECT row_number() OVER () AS num, bad, tokens FROM t JOIN s USING (page_id)),
        n AS (SELECT greatest(ceil({url_filter.MIN_SUPPORT} * count(*) - 1e-9), {url_filter.MIN_COUNT}) AS need, greatest({url_filter.MIN_CONFIDENCE}, avg(bad)) AS bar FROM b),
        e AS (SELECT num, bad, unnest(tokens) AS t FROM b),
        w AS (SELECT t, p, {lower} >= bar AS sure FROM (SELECT t, count(*)::DOUBLE AS seen, sum(bad)::DOUBLE AS blocked, sum(bad) / count(*)::DOUBLE AS p FROM e GROUP BY t), n WHERE blocked >= need),
        g AS (SELECT num, bad, list_sort(list(t)) AS ts FROM e JOIN w USING (t) WHERE NOT sure GROUP BY num, bad),
        k AS (SELECT list_filter(ts, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS tokens, count(*)::DOUBLE AS seen, sum(bad)::DOUBLE AS blocked FROM (SELECT bad, ts, unnest(range(1, 1 << len(ts))) AS mask FROM g) GROUP BY ALL),
        m AS (SELECT [t] AS tokens FROM w WHERE sure UNION ALL SELECT tokens FROM (SELECT *, blocked / seen AS p FROM k, n WHERE blocked >= need AND len(tokens) > 1) WHERE {lower} >= bar),
        u AS (SELECT tokens, unnest(tokens) AS one FROM (SELECT DISTINCT tokens FROM t)),
        h AS (SELECT DISTINCT u.tokens AS tokens FROM u JOIN m ON u.one = m.tokens[1] WHERE list_has_all(u.tokens, m.tokens)),
        f AS ({fits}),
        x AS (SELECT page_id, arg_max(struct_pack(rule := of || begins, verdict := verdict), struct_pack(n := length(of || begins), r := of || begins)) AS best
              FROM t JOIN f ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, begins) GROUP BY page_id)
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict, CASE WHEN t.tokens IN (SELECT tokens FROM h) THEN 'block' ELSE 'allow' END) AS verdict
        FROM t LEFT JOIN x USING (page_id)"""


def _shard_sql(n: int = 8) -> str:
    """Draws from MD5, the best of the shards, slots, and CRC-32 byte by byte."""
    draw = "((('0x' || substr(md5(doc_id || '/{s}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656)"
    best = lambda k: "list_max([" + ", ".join(f"struct_pack(score := 1 / -ln({draw.format(s=i)}), turn := -{i})" for i in range(k)) + "]).turn"
    return f"""
        WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
        d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM d),
        z AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM b, crc),
        s AS (SELECT *, CAST(-{best(n)} AS INT) AS shard, CAST(-{best(n + 1)} AS INT) AS grown_shard, floor({draw.replace("doc_id || ", "doc_id || '/' || size || '/' || text_crc32 || ").format(s="bucket")} * {sharding.BUCKETS}) AS bucket FROM z)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": f"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
            k AS (SELECT *, {_FOLD.format(x="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
            c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            j AS (SELECT k.*, c.owner IS NOT NULL AND doc_id < owner AS gone FROM k LEFT JOIN c USING (key))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM j GROUP BY doc_id""",
        "op5_url_filter": _url_sql(),
        "op6_quality": _quality_sql(),
        "op7_sharding": _shard_sql(),
        "op13_mixing": _mix_sql(),
        "op9_decontamination": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
                  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
            x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
            h AS (SELECT DISTINCT doc_id, x.n AS n, i, item_id FROM x JOIN p USING (n, win)),
            t AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
            s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
                   sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""",
    }
