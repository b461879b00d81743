"""Each operator against a plain version, over odd rows and the smallest tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harrier.llm import bpe, chat, decontam, line_dedup, pii, quality, queries, sharding, simhash, token_counts, url_filter

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def both(spark, odd):
    """The odd rows and the smallest table, as DataFrames and as rows."""
    small = spark.read.parquet(f"{SF}/documents.parquet")
    return [(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]) for df in (odd, small)]


# 1


def lines_brute(rows):
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    low = -(2**63)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(k := fold(line.strip(space))) >= 20:
                holders[k].add(low if d is None else d)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := fold(x.strip(space))) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != (low if d is None else d) for x in lines]
        out[d, len(lines), sum(gone), sha("\n".join(x for x, g in zip(lines, gone) if not g))] += 1
    return out


def test_line_dedup(spark, odd):
    for df, rows in both(spark, odd):
        assert plain(line_dedup.line_digest(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_brute(rows)


def test_line_dedup_batches_do_not_matter(spark, odd):
    want = lines_brute([(r.doc_id, r.text) for r in odd.collect()])
    for batches, fanout in ((1, 2), (3, 2), (7, 3)):
        judged = line_dedup.dedup_lines(odd.select("doc_id", "text"), batches=batches, fanout=fanout)
        got = judged.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).alias("n"), F.sha2(F.array_join("kept_lines", "\n"), 256))
        assert Counter(map(tuple, got.collect())) == want


def test_batches_add_only_keys_that_are_not_settled(spark):
    """A line of every document is written for the first batches only; the verdict is that of one batch."""
    line = "a line that every document has"
    docs = spark.createDataFrame([(i, f"{line}\nline number {i} alone, long enough") for i in range(40)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, fanout=100)
    for batch in line_dedup.batches_of(docs, 5):
        runs.add(batch)
    (first, *later), = runs.levels
    assert first.filter("n_docs > 1").count() == 1 and [r.filter("n_docs > 1").count() for r in later] == [0] * len(later) and later
    up = line_dedup.LineRuns(spark, fanout=2)
    for batch in reversed(line_dedup.batches_of(docs, 5)):
        up.add(batch)
    for r in (runs, up):
        assert {(x.n_lines, len(x.kept_lines)) for x in r.judge(docs).filter("doc_id < 39").collect()} == {(2, 1)}
        assert len(r.judge(docs).filter("doc_id = 39").first().kept_lines) == 2


def test_line_stage_keeps_columns(odd, none):
    out = line_dedup.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(r[c] == "mine" for r in out.collect() for c in odd.columns[4:])
    judged = line_dedup.dedup_lines(odd)
    assert judged.columns == [*odd.columns, "_n_lines", "_kept_lines"] and {r.n_lines for r in judged.collect()} == {"mine"}
    assert line_dedup.drop_lines(none).count() == 0 and line_dedup.line_digest(none).count() == 0


# 2

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.BytePairCodec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_bpe_equals_the_library(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS, key=len)[::97] + [b"a", b"e", b"th", b" ", b"\n", b"er"]), max_size=12))
def test_bpe_equals_the_library_on_joined_tokens(parts):
    text = b"".join(parts).decode("utf-8", "replace")
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "\n" * 9_000 + "x", " " * 9_000, "é" * 9_000, "\x00" * 999])
def test_bpe_on_long_pretokens(text):
    assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_bpe_query(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df, rows in both(spark, odd):
        want = Counter((d, len(ids := LIBRARY.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha((t or "").encode())) for d, t in rows)
        assert plain(bpe.round_trip_digests(df, path, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    coded = bpe.encode_documents(odd, path, public_tokenizers.PATTERN)
    assert Counter(bytes(r.data) for r in bpe.decode_documents(coded, path, public_tokenizers.PATTERN).collect()) == Counter((r.text or "").encode() for r in odd.collect())
    assert bpe.round_trip_digests(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_refuses_unknown_ids():
    with pytest.raises(KeyError):
        CODEC.decode([10**9])


# 3

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.findall("[0-9]", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def base_brute(text):
    out = [(m.start(), k, kind, m.end()) for k, (kind, pattern, ok) in enumerate(BASE) for m in re.finditer(pattern, text) if ok(m.group())]
    return [(s, e, kind) for s, _, kind, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "@@", ".", "..", "-", "+", "+1", " ", "(", ")", "1", "25", "256", "4111111111111111", "555", "é", "x@y.z", "1.2.3.4", "0", "_%"]), max_size=25))
def test_pii_base_spans(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == base_brute(text)


def test_pii_query(spark, odd, none):
    for df, rows in both(spark, odd):
        got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_digest(df).collect()}
        want = set()
        for d, t in rows:
            base = base_brute(t or "")
            want.add((d, sha(",".join(f"{k}:{s}:{e}" for s, e, k in base)), *(sum(k == kind for *_, k in base) for kind in pii.KINDS)))
        assert got == want
    for r in pii.pii_digest(odd).filter("doc_id = 11").collect():
        assert r.spans == "phone:5:22,email:31:48,ip:65:74,card:80:99"
    assert pii.pii_digest(none).count() == 0
    assert "[EMAIL]" in pii.redact(odd).filter("doc_id = 11").first().text


def test_pii_added_spans_on_held_out_sentences():
    model = pii.detector()
    rng, hits, said, there = random.Random(77), 0, 0, 0
    for _ in range(1500):
        text, truth = pii.example(rng)
        base, added = model.spans(text)
        assert not any(s < e2 and s2 < e for s, e, _ in added for s2, e2, _ in base)
        rest = [t for t in truth if not any(s < t[1] and t[0] < e for s, e, _ in base)]
        there += len(rest)
        said += len(added)
        hits += sum(any(k == t[2] and s <= t[0] and t[1] <= e for t in truth) for s, e, k in added)
    assert hits / said >= 0.97 and hits / there >= 0.75


#: Written by hand, none by the generator; the first set was looked at while the forms of numbers were widened.
SAID = [
    ("Please ring the surgery on 0131 496 0000 before noon.", "phone"),
    ("Tel. 020 7946 0958 (office)", "phone"),
    ("Her number is 555-867-5309 x2", "phone"),
    ("Call me at (212) 555-0147 tonight", "phone"),
    ("Fax 0049 30 901820 or write", "phone"),
    ("Rufen Sie 030 9018200 an", "phone"),
    ("mobile 07700 900123 any time", "phone"),
    ("phone: 415.555.0132", "phone"),
    ("Mein Handy 0151/23456789 ist an", "phone"),
    ("write to jane dot doe at example dot com please", "email"),
    ("jane.doe [at] example [dot] org", "email"),
    ("reach bob_smith(at)mail.example.net", "email"),
    ("contact: ann at widgets.io for more", "email"),
    ("the host fe80::1ff:fe23:4567:890a answered", "ip"),
    ("server 2001:db8:85a3:0:0:8a2e:370:7334 is up", "ip"),
    ("login from 192[.]168[.]10[.]4 failed", "ip"),
    ("ping 10(.)0(.)0(.)7", "ip"),
    ("pay with 4111.1111.1111.1111 today", "card"),
    ("my visa 5500/0000/0000/0004 exp 12/30", "card"),
    ("card 4222222222222", "card"),
    ("amex 3782 822463 10005 ok", "card"),
]
#: The second set was written afterwards and has been tried once.
SAID_FRESH = [
    ("You can phone the desk on 0161 555 0199 after five", "phone"),
    ("dial 718-555-0121 for help", "phone"),
    ("Telefon: 089 5550 1234", "phone"),
    ("her cell (503) 555-0188 rings", "phone"),
    ("WhatsApp 0034 600 555 123 only", "phone"),
    ("cell 646.555.0177 or visit us", "phone"),
    ("a note: 0207 555 0134 Smith", "phone"),
    ("anna.k [at] posteo [dot] de", "email"),
    ("mail tom(at)example(dot)net now", "email"),
    ("kim at example dot co dot uk", "email"),
    ("address: lee@example [dot] com", "email"),
    ("backend fe80:0:0:0:202:b3ff:fe1e:8329 timed out", "ip"),
    ("traffic from 203[.]0[.]113[.]9 was dropped", "ip"),
    ("node 2001:db8::8a2e:370:7334", "ip"),
    ("the address fd12:3456:789a::1 is local", "ip"),
    ("Mastercard 5105.1051.0510.5100", "card"),
    ("debit 4012_8888_8888_1881 please", "card"),
    ("amex 371449635398431x", "card"),
    ("card no 4000 - 0566 - 5566 - 5556", "card"),
    ("visa 4222222222222 old", "card"),
]
#: Look-alikes in which nothing is personal.
NOTHING = [
    "The meeting is at 10:30:15 on 2024-05-12.",
    "We looked at example. Com was new.",
    "version 10.2.33.4444 was out",
    "ISBN 978-3-1614-8410-0 in print",
    "Order 1234 5678 9012 3456 shipped",
    "He arrived at noon at home",
    "ratio 12:34:56:78:9a:bc is a MAC",
    "std::vector and a::b",
    "He was born 12.10.1980 in Rome",
    "Total 1,234,567.00 dollars",
    "section 3.2.1.4 of the text",
    "pp. 120-134-150",
    "ticket 555-867-5309 closed",
    "look at this dot on the map",
    "The bus 100-200-300 runs at six",
    "On 2023.11.05 at 09:15 we met",
    "Case 2021-555-0199 was heard",
    "total: 12 345 678",
    "v1.2.3 at commit ab:cd",
    "invoice 0161 555 0199",
    "He sat at table 4. Later he left",
    "code 4242.1000.2000",
    "aa:bb:cc:dd:ee:ff is hardware",
    "score 21-15, 21-19, 11-9",
    "chapter 4:5:6 verse",
    "part no. 503-555-0188",
]


def test_pii_in_sentences_written_by_hand():
    model = pii.detector()
    for texts in (SAID, SAID_FRESH):
        found = [any(k == kind for spans in model.spans(text) for *_, k in spans) for text, kind in texts]
        assert sum(found) >= 0.95 * len(texts)
    assert not [t for t in NOTHING if model.spans(t)[1]]


def test_pii_recall_of_each_kind():
    model, rng, hit, there = pii.detector(), random.Random(78), Counter(), Counter()
    for _ in range(1500):
        text, truth = pii.example(rng)
        base, added = model.spans(text)
        for s, e, kind in truth:
            if not any(a < e and s < b for a, b, _ in base):
                there[kind] += 1
                hit[kind] += any(k == kind and a <= s and e <= b for a, b, k in added)
    assert all(hit[k] >= 0.9 * there[k] for k in pii.KINDS), (hit, there)


@pytest.mark.parametrize("more", ["\n\nand 7", "\n\n@", "\n\nnothing at all :: here", "\n\n"])
def test_pii_spans_do_not_depend_on_far_text(more):
    model, rng = pii.detector(), random.Random(5)
    for text in ["the host fe:ab:cd:ef:ab:cd:ef:ab stands here", *(t for t, _ in SAID), *NOTHING, *(pii.example(rng)[0] for _ in range(100))]:
        base, added = model.spans(text)
        long = model.spans(text + " " * 50 + more)
        assert [s for s in long[0] if s[1] <= len(text)] == base and [s for s in long[1] if s[1] <= len(text)] == added, text


def test_pii_is_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1-" * 100_000, "+1" * 100_000, "1." * 100_000, "a at " * 40_000, "0:" * 100_000, "a@" * 100_000):
        pii.detector().spans(text)


# 4


def test_token_counts(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df, rows in both(spark, odd):
        want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows)
        assert plain(token_counts.count_tokens(df, path, public_tokenizers.PATTERN), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(none, path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text() | st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "\n", "it's", "<|", "|>"]), max_size=9).map("".join))
def test_counts_equal_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_counts_equal_the_library, "made"):
        test_counts_equal_the_library.made = token_counts.Counters(token_counts.read_definition(path), public_tokenizers.PATTERN, {}), Tokenizer.from_file(path)
    counter, library = test_counts_equal_the_library.made
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_lengths_stay_bounded():
    lengths = token_counts.PretokenLengths(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {"a": 1}, entries=5)
    for i in range(50):
        lengths[f"w{i}"]
    assert len(lengths) <= 6 and lengths["a"] == 1


# 5


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://EXAMPLE.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/x", "example.org", "/x", "org/", "allow"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", "com/de/", "block"),
    ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
])
def test_fixed_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tuple(url_filter.judge_urls(pages, labels).first()) == (1, host, path, rule, verdict)


def test_mined_url_rules(spark):
    """Pages of one host with one word are bad; each alone isn't. Nulls say nothing."""
    rows, labels = [], []
    for i in range(400):
        host, word = ("h1.net", "h2.net")[i % 2], ("spam", "news")[i // 2 % 2]
        rows.append((i, f"http://{host}/{word}/{i}?id=1"))
        labels.append((i, 0 if host == "h1.net" and word == "spam" else 1, None))
    rows += [(1000, "http://h1.net/spam/9"), (1001, "http://h2.net/spam/9"), (1002, "http://h1.net/news/9"), (None, "http://h1.net/spam/8"), (1000, "http://h1.net/spam/9")]
    labels += [(None, None, None), (5, None, None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, tokens string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, said)
    assert got.count() == len(rows)
    by = {(r.page_id, r.host, r.path): r.verdict for r in got.filter("page_id >= 1000 or page_id is null").collect()}
    assert by == {(1000, "h1.net", "/spam/9"): "block", (1001, "h2.net", "/spam/9"): "allow", (1002, "h1.net", "/news/9"): "allow", (None, "h1.net", "/spam/8"): "block"}


@pytest.mark.parametrize("constant", [500, 10])
def test_url_rules_of_many_hosts(spark, tmp_path, monkeypatch, constant):
    """Each bad host gives 18 rules or more, over 500 in all; none may be lost, however
    few pages it has, whether the rules are a constant or joined."""
    import duckdb

    monkeypatch.setattr(url_filter, "CONSTANT_RULES", constant)
    hosts = [f"s{i}.mail.example.net" for i in range(40) for _ in range(12 if i < 30 else 6)] + [f"t{i % 250}.mail.example.net" for i in range(500)]
    rows = [(i, f"http://{host}/{i}") for i, host in enumerate(hosts)]
    labels = [(i, 0 if host[0] == "s" else 1, None) for i, host in enumerate(hosts)]
    asked = [(5000 + i, f"http://s{i}.mail.example.net/{i}") for i in range(45)]
    odd = [(None, "http://s39.mail.example.net/1"), (None, None), (6000, ""), (6001, "http://s39.mail.example.net/1"), (6001, "http://s39.mail.example.net/1"), (6002, "http://com/de/s39.mail.example.net")]
    pages = spark.createDataFrame(rows + asked + odd, "page_id long, url string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in url_filter.judge_urls(pages, said).collect()]
    assert len(got) == len(rows + asked + odd)
    assert {r[1]: r[4] for r in got if r[0] and 5000 <= r[0] < 6000} == {f"s{i}.mail.example.net": "block" if i < 40 else "allow" for i in range(45)}
    con = duckdb.connect()
    for name, df in (("pages", pages.filter("page_id is not null").distinct()), ("labels", said)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert {r for r in got if r[0] is not None} == set(con.execute(queries.oracle_sql()["op5_url_filter"]).fetchall())
    assert Counter(r[4] for r in got if r[0] is None) == {"block": 1, "allow": 1}


def test_url_rules_need_more_than_chance(spark):
    """At one bad page in four, hosts of few pages that are bad by chance stay; a host of many bad pages goes."""
    rng = random.Random(9)
    rows = [(i, f"http://h{i % 60}.net/{i}", 0 if rng.random() < 0.25 else 1) for i in range(600)] + [(1000 + i, f"http://bad.net/{i}", 0 if i % 5 else 1) for i in range(40)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {(r.host, r.verdict) for r in url_filter.judge_urls(pages, labels).collect()}
    assert {h for h, v in got if v == "block"} == {"bad.net"} and len(got) == 61


def test_pairs_of_many_common_words_are_found(spark, tmp_path):
    """Thirteen words that most pages share, two of them bad together only, and two words of every page:
    no token is kept from the fit. Words that are always together are rules by themselves."""
    import duckdb

    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        bad = i % 6 == 0
        words = [w for w in (f"w{k}" for k in range(11)) if rng.random() < 0.7]
        words += ["x", "y"] if bad else [rng.choice(["x", "y", "z"])]
        words += ["twin1", "twin2"] if bad or i % 6 == 1 else []
        rows.append((i, f"http://h{i}.net/" + "/".join([*words, "all"])))
        labels.append((i, 0 if bad else 1, None))
    asked = [(1000, "http://a.net/x/y"), (1001, "http://a.net/x/w1"), (1002, "http://a.net/y/w1/w2/w3/w4/all"), (1003, "http://a.net/twin1/x"), (1004, "http://a.net/x/twin2"), (1005, "http://a.net/twin1")]
    pages = spark.createDataFrame(rows + asked, "page_id long, url string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in url_filter.judge_urls(pages, said).collect()}
    assert {r[0] for r in got if r[4] == "block"} >= {*range(0, 600, 6), 1000, 1003, 1004} and not {1001, 1002, 1005} & {r[0] for r in got if r[4] == "block"}
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", said)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert got == set(con.execute(queries.oracle_sql()["op5_url_filter"]).fetchall())


def test_long_urls_and_no_pages(spark):
    """Pages that share thousands of words don't give a rule for each set of them."""
    long = "http://long.net/" + "/".join(f"w{i}" for i in range(3_000))
    rows = [(i, f"{long}/{i}") for i in range(12)] + [(100 + i, f"http://ok.net/w{i % 10}") for i in range(300)] + [(500, "http://other.net/w7/w9"), (501, long), (502, "http://long.net/"), (503, "http://ok.net/x")]
    pages = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, bad int, host string")
    labels = spark.createDataFrame([(r[0], 0 if r[0] < 100 else 1, None) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, labels).collect()}
    assert {k for k, v in got.items() if v == "block"} == {*range(12), 500, 501, 502}
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, labels.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("constant", [0, 10_000])
def test_thousands_of_url_rules(spark, tmp_path, monkeypatch, constant):
    """1,100 bad hosts: as many rules, each of six pages, none lost, as SQL says."""
    import duckdb

    monkeypatch.setattr(url_filter, "CONSTANT_RULES", constant)
    monkeypatch.setattr(url_filter, "MIN_SUPPORT", 0.0)
    rows = [(i, f"http://s{i % 1100}.net/p{i % 7}") for i in range(6_600)] + [(20_000 + i, f"http://t{i % 400}.net/p{i % 7}") for i in range(8_000)]
    asked = [(50_000 + i, f"http://s{i}.net/q") for i in range(1150)]
    pages = spark.createDataFrame(rows + asked, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 20_000 else 1, None) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in url_filter.judge_urls(pages, labels, min_support=0.0).collect()}
    assert {r[1][0] for r in got if r[4] == "block" and r[0] >= 20_000 and r[2] == "/q"} == {"s"} and sum(r[4] == "block" and r[2] == "/q" for r in got) == 1100
    for name, df in (("pages", pages), ("labels", labels)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert got == set(con.execute(queries.oracle_sql()["op5_url_filter"]).fetchall())


# 6


def measures_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def kept_brute(rows):
    """The ids that stay of ``rows (doc_id, host, measures)``, by the rules and the hosts' shrunk rates."""
    fails = [lambda m: m[0] < 50, lambda m: 2 * m[4] > m[0], lambda m: 10 * m[2] > m[0], lambda m: m[0] > 0 and not 2 <= m[1] / m[0] <= 20, lambda m: 10 * m[3] > m[0]]
    hosts = defaultdict(list)
    for _, host, m in rows:
        hosts[host].append([f(m) for f in fails])
    rates, worse = defaultdict(list), defaultdict(list)
    for k in range(len(fails)):
        shares = [np.mean([x[k] for x in v]) for v in hosts.values()]
        alpha, beta = quality.beta_prior(float(np.mean(shares)), float(np.var(shares, ddof=1)))
        for host, v in hosts.items():
            a, b = sum(x[k] for x in v) + alpha, sum(not x[k] for x in v) + beta
            rates[host].append(a / (a + b))
            worse[host].append(a / (a + b) - 1.645 * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5 > alpha / (alpha + beta))
    bad = lambda host, m: max(rates[host]) >= 0.75 or any(f(m) and (k < 2 or worse[host][k]) for k, f in enumerate(fails))
    return {d for d, host, m in rows if not bad(host, m)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", " ", "  ", "\n", "\x0b", "\x85", "\u00a0", "#", "a b c ", "\n\n"]), max_size=60).map("".join))
def test_measures(text):
    assert quality.measure(text) == measures_brute(text)


def test_quality_query(spark, odd, none):
    for df, rows in both(spark, odd):
        got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(df).collect()}
        assert got == {(d, *(m := measures_brute(t or "")), m[0] < 50 or 2 * m[4] > m[0]) for d, t in rows}
    assert quality.judged(none).count() == 0 and quality.keep_good(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judged(odd).filter("kept").collect())
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.source, measures_brute(r.text or "")) for r in small.collect()]
    assert {r.doc_id for r in quality.judged(small).filter("kept").collect()} == kept_brute(rows)


def test_bad_hosts_go(spark):
    """A rejected host goes whole; a suspect one loses the documents that fail; elsewhere a rare failure stays."""
    good, bad = " ".join(f"w{i}" for i in range(80)), "# " * 30 + " ".join(f"w{i}" for i in range(80))
    rows = [(i, bad if i % 20 else good, "bad.net", 1) for i in range(200)] + [(1000 + i, good, f"h{i % 9}.org", 1) for i in range(300)] + [(5000, good, None, 1)]
    rows += [(2000 + i, good if i % 5 else bad, "mixed.com", 1) for i in range(200)] + [(3000 + i, good if i else bad, "clean.com", 1) for i in range(400)]
    gone = {r[0] for r in rows if r[0] < 1000 or (r[2] == "mixed.com" and r[1] is bad)}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = {r.doc_id for r in quality.judged(df).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - gone == {r.doc_id for r in quality.keep_good(df).collect()}
    verdicts = {r.host: (r.rejected, r.suspect_in) for r in quality.host_verdicts(quality.with_measures(df, "m").select(F.col("source").alias("host"), "m.*")).collect()}
    assert verdicts["bad.net"][0] and verdicts["mixed.com"] == (False, ["symbols"]) and verdicts["clean.com"] == (False, [])


def test_hosts_lie_on_both_sides_of_the_corpus(spark):
    """Of twenty hosts whose rates of a failure run from 0 to 38 %, those well above the mean are suspect, the others not."""
    good, bad = " ".join(f"w{i}" for i in range(80)), "# " * 30 + " ".join(f"w{i}" for i in range(80))
    rows = [(1000 * h + i, bad if i % 50 < h else good, f"h{h}.net") for h in range(20) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = quality.host_verdicts(quality.with_measures(df, "m").select(F.col("source").alias("host"), "m.*"))
    suspect = {int(r.host[1:-4]) for r in verdicts.collect() if r.suspect_in}
    assert suspect == set(range(min(suspect), 20)) and 10 <= min(suspect) <= 14
    kept = {r.doc_id for r in quality.judged(df).filter("kept").collect()}
    assert kept == kept_brute([(d, s, measures_brute(t)) for d, t, s in rows])
    assert {r.doc_id for r in quality.judged(df).filter("not kept").collect()} == {d for d, t, _ in rows if t is bad and d // 1000 in suspect}


def test_beta_prior():
    assert quality.beta_prior(0.5, 0.05) == pytest.approx((2.0, 2.0))
    assert quality.beta_prior(None, None)[0] == pytest.approx(10.0)


# 7


def test_sharding(spark, odd, none):
    for df, rows in both(spark, odd):
        got = sharding.shard_report(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
        by = defaultdict(list)
        for r in got:
            assert r.grown_shard in (r.shard, 8) and r.law == "key"
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_report(none).count() == 0


def test_shards_of_one_key(spark):
    """A third of the rows have one id, some have none: slots stay gapless."""
    rows = [(7 if i % 3 == 0 else None if i % 10 == 1 else i, f"text {i % 200}") for i in range(900)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 900 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.doc_id for r in sharding.shard_report(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).collect()} == {None}


def test_weighted_shards(spark):
    df = spark.range(20_000)
    mine = sharding.with_slots(sharding.assign(df.withColumns({"shard": F.lit("mine"), "slot": F.lit("own")}), "id", [("a", 1.0)]), "id", [], shard="_shard")
    assert set(mine.columns) == {"id", "shard", "slot", "_shard", "_slot"} and mine.filter("shard = 'mine' and slot = 'own' and _shard = 0").count() == df.count()
    sizes = {r.shard: r["count"] for r in sharding.assign(df, "id", [("a", 1.0), ("b", 3.0)]).groupBy("shard").count().collect()}
    assert 2.7 < sizes[1] / sizes[0] < 3.3
    moved = sharding.assign(sharding.assign(df, "id", [("a", 1.0), ("b", 1.0)]), "id", [("a", 1.0), ("b", 1.0), ("c", 1.0)], "grown").filter("shard <> grown")
    assert moved.filter("grown <> 2").count() == 0 and 0.3 < moved.count() / 20_000 < 0.37
    for shards in ([], [("a", 0.0)]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), shards)


# 8


def repair_brute(roles):
    """The least cost over all choices, turn by turn, without states of the programme."""
    best = {(): 0}
    for role in roles:
        after = {}
        for done, cost in best.items():
            last = done[-1:]
            for new in (1, 2, 3):
                named = 0 if new == role else chat.COSTS["unknown"] if role == 0 else chat.COSTS["relabel"]
                ways = [((new,), named + chat.COSTS["merge"])] if last == (new,) else []
                for between in ((), (1,), (2,), (3,)):
                    seq = (last or (0,)) + between + (new,)
                    if all(pair in chat.LEGAL for pair in zip(seq, seq[1:])):
                        ways.append(((new,), named + chat.COSTS["insert"] * len(between)))
                for key, c in ways:
                    after[key] = min(after.get(key, 10**9), cost + c)
        best = after
    return min(cost + chat.CLOSING[done[-1] if done else 0] for done, cost in best.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.integers(1, 4))
def test_chat_costs(roles, size):
    parts = [roles[i : i + size] for i in range(0, len(roles), size)]
    states, cost = chat.through([chat.matrix(p) for p in parts])
    assert cost == repair_brute(roles)
    steps = [s for p, a, b in zip(parts, states, states[1:]) for s in chat.path(p, a, b)]
    assert sum(s[0] for s in steps) + chat.CLOSING[states[-1]] == cost


def test_chat_query(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
        (2, 0, "human", "a"), (2, 1, "user", "b"), (2, 2, "GPT", "c"),
        (3, 0, "assistant", "x"),
        (4, 0, None, None), (4, 0, "user", "tie"), (4, None, "system", "s"),
        (None, 0, "user", "alone"),
        (5, 0, "user", "same"), (5, 0, "user", "same"),
        *((6, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(50)),
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    fragments = {}
    for stretch in (1, 3, 1024):
        out = chat.repair(df, stretch)
        assert out.count() == len(rows)
        got = defaultdict(list)
        for r in sorted(out.collect(), key=lambda r: r.seq):
            got[r.conv_id].append(r)
        fragments[stretch] = {k: "".join(r.fragment for r in v) for k, v in got.items()}
        for k, v in got.items():
            text = fragments[stretch][k]
            roles = re.findall(r"<\|(system|user|assistant)\|>", text)
            states = [0] + [chat.ROLES.index(x) + 1 for x in roles]
            assert all(p in chat.LEGAL for p in zip(states, states[1:])) and states[-1] == 3
            order = sorted(((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), r[3] or "") for r in rows if r[0] == k)
            assert v[0].cost == repair_brute([chat.role_state(o[1][1] or None) for o in order])
    assert fragments[1][1] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert fragments[1][2] == "<|user|>\na\n\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert fragments[1024][3] == "<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n"
    assert chat.repair(df.limit(0)).count() == 0


def test_chat_stretches_of_long_texts(spark):
    """Stretches end where their texts get long; the cost is the least, wherever they end."""
    rng = random.Random(12)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool", None]), "x" * rng.choice([0, 10, 50_000])) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chars in (1, 60_000, chat.STRETCH_CHARS):
        found = sorted(chat.repair(df, stretch_chars=chars).collect(), key=lambda r: r.seq)
        assert [(r.seq, r.turn, r.role_in, r.text) for r in found] == [(t, t, role, text) for _, t, role, text in rows]
        assert {r.cost for r in found} == {repair_brute([chat.role_state(r[2]) for r in rows])}
        roles = re.findall(r"<\|(system|user|assistant)\|>", "".join(r.fragment for r in found))
        states = [0] + [chat.ROLES.index(x) + 1 for x in roles]
        assert all(p in chat.LEGAL for p in zip(states, states[1:])) and states[-1] == 3


def test_long_conversations(spark):
    """Thousands of turns and a very long text in one conversation, in stretches."""
    rows = [(1, i, ("user", "assistant", "tool")[i % 3], f"t{i}" if i != 77 else "x" * 300_000) for i in range(5_000)]
    got = sorted(chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 256).collect(), key=lambda r: r.seq)
    assert len(got) == 5_000 and {r.cost for r in got} == {repair_brute([chat.role_state(r[2]) for r in rows])}
    assert len("".join(r.fragment for r in got)) > 300_000


# 9


def hits_brute(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    patterns = [(str(i) if i is not None else "null", tuple(w[k : k + window])) for i, t in items if (w := cut(t)) for k in range(max(1, len(w) - window + 1))]
    by = defaultdict(set)
    for i, p in patterns:
        by[p].add(i)
    out = Counter()
    for d, t in rows:
        words = cut(t)
        hit, found = set(), set()
        for n in {len(p) for p in by}:
            for k in range(len(words) - n + 1):
                if (p := tuple(words[k : k + n])) in by:
                    hit.update(range(k, k + n))
                    found |= by[p]
        out[d, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block_windows", [100_000, 30])
def test_decontamination(spark, odd, none, block_windows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    extra = [(900, None), (901, ""), (902, "tail"), (None, "own LINE of"), (903, "word word"), (904, " ".join(["word"] * 12)), (905, "日本語"), (905, "日本語")]
    bench = bench.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    for df, rows in both(spark, odd):
        out = decontam.find_contamination(df, bench, block_windows=block_windows)
        n = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
        got = out.select("doc_id", "n_words", n, F.size("items"), F.sha2(F.array_join("items", ","), 256), n > 0)
        assert Counter(map(tuple, got.collect())) == hits_brute(rows, items)
    assert decontam.contamination_digest(none, bench).count() == 0
    assert decontam.contamination_digest(odd, bench.limit(0)).filter("contaminated").count() == 0
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in decontam.contamination_digest(odd, bench).filter("not contaminated").collect())


def test_carried_columns(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "has one two inside", "t", 5)], "doc_id long, text string, `a.b` string, c0 int").withColumnRenamed("a.b", "k0")
    found = decontam.find_contamination(docs, bench, carry=("text", "k0", "c0", "doc_id"))
    assert found.columns == ["text", "k0", "c0", "doc_id", "n_words", "spans", "items"]
    assert tuple(found.first())[:5] == ("has one two inside", "t", 5, 1, 4)
    with pytest.raises(ValueError):
        decontam.find_contamination(docs.withColumn("items", F.lit(1)), bench, carry=("doc_id", "items"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9).map(lambda s: tuple(c.encode() for c in s)), min_size=1, max_size=6), st.text("abc", max_size=40))
def test_wu_manber(patterns, text):
    words = [c.encode() for c in text]
    for n in {len(p) for p in patterns}:
        own = {p: [i] for i, p in enumerate(patterns) if len(p) == n}
        got = [(end, tuple(items)) for end, items in decontam.WuManber(n, own).search(words)]
        assert got == [(k + n, tuple(own[p])) for k in range(len(words) - n + 1) if (p := tuple(words[k : k + n])) in own]


# 10


def prints_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(prints, radius=4):
    a, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= radius).tolist():
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def test_simhash_query(spark, odd, none):
    for df, rows in both(spark, odd):
        prints = [prints_brute(t) for _, t in rows]
        roots = components_brute(prints)
        least = {r: min((d for (d, _), own in zip(rows, roots) if own == r and d is not None), default=None) for r in roots}
        want = Counter((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots))
        assert plain(simhash.near_duplicate_digest(df), "doc_id", "fingerprint", "component_id") == want
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicate_digest(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("shard_max", [4096, 7])
def test_links_of_dense_groups(spark, shard_max):
    """Chains and balls of fingerprints, with shards cut into chunks."""
    rng = random.Random(4)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(40)}
        at = centre
        for _ in range(15):
            at ^= sum(1 << b for b in rng.sample(range(64), 4))
            prints.add(at)
    prints = sorted(prints | {0, 2**64 - 1, 15, 1 << 63})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, shard_max=shard_max).collect()]
    assert all((a ^ b).bit_count() for a, b in edges)
    named = {r.node: r.root for r in simhash.components(simhash.links(df, shard_max=shard_max)).collect()}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    groups = defaultdict(set)
    for p in signed:
        groups[named.get(p, p)].add(p)
    want = defaultdict(set)
    for p, r in zip(signed, components_brute(prints)):
        want[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(k == min(v) for k, v in groups.items())


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in itertools.islice(values, 40):
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


def test_masks_share_blocks():
    masks = simhash.shard_masks(6, 4)
    assert len(masks) == 15
    rng = random.Random(2)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**7, 10**8, 10**9, 10**10, 10**15)] == [6, 6, 6, 7, 7, 8, 8]
    rng = random.Random(2)
    for blocks in (7, 8):
        masks = simhash.shard_masks(blocks, 4)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
