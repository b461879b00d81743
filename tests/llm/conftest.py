import random

import pytest

LONG = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "Über", "x1"]) + str(i % 97) for i in range(40_000))
LINE = "this very line stands in many documents"

#: Nulls in every column, empty and very long texts, ties, repeated rows, odd characters.
ROWS = [
    (1, None, "src0", None),
    (2, "", "src0", 0),
    (None, f"a null id\n{LINE}", "src1", 5),
    (3, f"  {LINE.upper()}\t\n{LINE}\nown line of three, which is long enough", None, 7),
    (4, f"{LINE}\n\n{LINE}", "src1", 7),
    (5, f"{LINE}\nend", "src1", 7),
    (5, f"{LINE}\nend", "src1", 7),
    (6, LONG, "src2", 1),
    (7, LONG + " tail", "src2", 1),
    (8, "İstanbul K\u212aelvin \x85 \u00a0 nbsp 日本語 😀 \x00 <|endoftext|> it's  \n\n x", "src2", 1),
    (9, " \t\n\x0b\x0c\r", "src3", 1),
    (10, "word " * 300, "src3", 1),
    (11, "call +1 (743) 555-3824 or mail a.b@c.example.com from 10.0.0.256 10.0.0.25 card 4111 1111 1111 1111.", "src4", 1),
    (-4, "negative id, short", "src4", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, source string, n_chars long"
    df = spark.createDataFrame(ROWS, schema)
    for name in ("doc", "digest", "n_lines", "kept_lines", "line", "pos", "h1", "fp", "owner", "bad_host", "host", "shard", "c0", "key", "Bucket", "stays", "lines_at"):
        df = df.selectExpr("*", f"'mine' as `{name}`")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
