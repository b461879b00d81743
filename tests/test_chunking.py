"""The cutters of formats: what holds of every text, and plain cutters that read a text
word by word instead."""

import csv
import io
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harrier.operators import chunking as C

SUFFIXES = [*C.CUTTERS, ".txt", ""]
ENDS = st.sampled_from(["\n", "\r\n", "\r"])


def cuts(text, path, strategy="auto"):
    return [(a, b, kind) for _, a, b, kind, _ in C.chunks_of(path, text, strategy)]


def texts(text, path, strategy="auto"):
    return [t for *_, t in C.chunks_of(path, text, strategy)]


def lines_of(text):
    """Lines with their ends, by hand."""
    out, held = [], ""
    for i, c in enumerate(text):
        held += c
        if c == "\n" or (c == "\r" and text[i + 1 : i + 2] != "\n"):
            out.append(held)
            held = ""
    return [*out, held] if held else out


pieces = st.sampled_from(["# h\n", "## g\r\n", "```\n", "~~~\n", "````sh\r", "`x`", "word", " ", "\n", "\r", "a,b", '"', ",", "def f():\n    pass\n", "@d\n", "class K: pass\n", "key: 1\n", "run_id: 2\n", "- i\n", "{", "}", '{"a": 1}', "[1]", " ", "\x85", "\x00", "é", "    "])


@settings(max_examples=600, deadline=None)
@given(st.lists(pieces, max_size=30).map("".join), st.sampled_from(SUFFIXES), st.integers(1, 700))
def test_what_holds_of_every_cutter(part, suffix, times):
    """No text makes a cutter fail; cuts lie in the text in order, aren't blank, and hold each character that
    isn't white space; the text of a cut ends with what lies there."""
    text = part * times if len(part) * times < 30_000 else part
    found = list(C.chunks_of(f"dir/file{suffix}", text))
    covered = [False] * len(text)
    for _, a, b, kind, body in found:
        assert 0 <= a < b <= len(text) and text[a:b].strip() and body.endswith(text[a:b])
        covered[a:b] = [True] * (b - a)
    assert all(c or not text[i].strip() for i, c in enumerate(covered))
    assert [a for _, a, *_ in found] == sorted(a for _, a, *_ in found)
    if suffix not in (".csv", ".yaml", ".yml"):  # heads go before rows and blocks there
        assert all(len(body) <= C.LONGEST for *_, body in found) or suffix == ".jsonl" or {k for _, _, _, k, _ in found} == {"jsonl"}


def markdown_plain(text):
    """Sections, from a reading of each line with its state in words."""
    sections, fence = [""], None
    for line in lines_of(text):
        bare = line.rstrip("\r\n") if line.strip("\r\n") else ""
        indent = len(bare) - len(bare.lstrip(" "))
        rest = bare[indent:]
        run = len(rest) - len(rest.lstrip(rest[0])) if rest[:1] in ("`", "~") else 0
        after = rest[run:]
        if fence:
            if indent <= 3 and run >= fence[1] and rest[:1] == fence[0] and not after.strip():
                fence = None
        elif indent <= 3 and run >= 3 and not (rest[0] == "`" and "`" in after):
            fence = (rest[0], run)
        elif re.match(r"#{1,6}\s+\S", line) and sections != [""]:
            sections.append("")
        sections[-1] += line
    return [s for s in sections if s.strip()]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["# one", "###### six", "####### seven", "#none", "#  ", "```", "````", "``` py", "```x```", "~~~", "   ~~~~", "    ```", "plain", "", "a # b"]), ENDS), max_size=14))
def test_sections(lines):
    text = "".join(line + end for line, end in lines)
    assert texts(text, "a/b.md") == markdown_plain(text) == texts(text, "a/b.rst") == texts(text, "plain", "markdown")


cells = st.text(st.sampled_from('xy ,"\n'), max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(cells, min_size=2, max_size=2), max_size=6))
def test_records_that_a_writer_wrote(rows):
    held, starts = io.StringIO(), []
    writer = csv.writer(held, lineterminator="\n")
    for row in rows:
        starts.append(held.tell())
        writer.writerow(row)
    text = held.getvalue()
    records = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    got = texts(text, "t.csv")
    assert got == [r if i == 0 else records[0] + r for i, r in enumerate(records)]
    assert [k for *_, k in cuts(text, "t.csv")] == ["csv_header", *["csv_row"] * (len(records) - 1)][: len(records)]


def test_stray_quotes_draw_in_no_further_records():
    broken = 'name,size\nann,"1\nbob,2\ncy,3\n'
    assert texts(broken, "t.csv") == ["name,size\n", 'name,size\nann,"1\n', "name,size\nbob,2\n", "name,size\ncy,3\n"]
    uneven = 'name,size\nann,"1\nbob",2,9\ncy,3\n'
    assert len(texts(uneven, "t.csv")) == 4


names = st.lists(st.sampled_from(["imports", "value", "plain", "wrapped", "later", "thing"]), max_size=7)
SOURCE = {
    "imports": "import sys\n",
    "value": "LIMIT = 4\n",
    "plain": "def plain(x):\n    return x\n",
    "wrapped": "@first\n@second(2)\ndef wrapped():\n    '''text\n\ntext'''\n",
    "later": "async def later():\n    pass\n",
    "thing": "class Thing:\n    size = 1\n\n    def of(self):\n        return 1\n",
}


@settings(max_examples=200, deadline=None)
@given(names, st.integers(0, 3))
def test_definitions_and_what_is_between(order, blank):
    gap = "\n" * blank
    text = "".join(SOURCE[n] + gap for n in order)
    if not any(n in ("plain", "wrapped", "later", "thing") for n in order):
        assert cuts(text, "m.py") == cuts(text, "m.txt")
        return
    want, between = [], ""
    for n in [*order, None]:
        if n in ("imports", "value"):
            between += SOURCE[n] + gap
            continue
        if between:
            want.append(between)
        between = ""
        if n:
            want.append(SOURCE[n])
    assert [t.rstrip("\n") for t in texts(text, "m.py")] == [w.rstrip("\n") for w in want]
    assert {k for *_, k in cuts(text, "m.py")} == {"ast"} and cuts(text, "m.py") == cuts(text, "notes", "ast")


@pytest.mark.parametrize("text", ["1 +\n", "class :\n", "ok = 1\x00\n", "y = " + "0-" * 90_000 + "0\n", "[" * 4_000 + "]" * 4_000])
def test_what_cannot_be_parsed_gives_windows(text):
    assert cuts(text, "m.py") == cuts(text, "m.txt")


def test_long_stretches_are_cut_with_an_overlap():
    rng = random.Random(1)
    for _ in range(30):
        body = "# title\n" + "".join(rng.choice("ab \n") for _ in range(rng.randrange(1_900, 9_000))) + "z"
        found, n = cuts(body, "x.md"), len(body)
        assert found[0][0] == 0 and found[-1][1] == n
        assert all(b - a == C.LONGEST and c == b - C.RECUT_OVERLAP for (a, b, _), (c, _, _) in zip(found, found[1:]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 400), st.integers(1, 60), st.integers(0, 70))
def test_windows(n, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    step = size - overlap if overlap < size else size - size // 5
    found = [(a, b) for a, b, *_ in C._fixed(text, size, overlap)]
    want, at = [(0, min(size, n))], 0
    while want[-1][1] < n:
        at += max(1, step)
        want.append((at, min(at + size, n)))
    assert found == want
    with pytest.raises(ValueError):
        list(C._fixed(text, 0, overlap))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["run_id", "model", "data", "steps"]), max_size=5, unique=True), st.integers(1, 60), st.sampled_from(["", "# note\n"]))
def test_yaml_blocks_have_the_head_before_them(keys, lines, note):
    blocks = {k: f"{k}:\n" + f"  leaf_{k}: 17\n" * lines for k in keys}
    text = note + "".join(blocks.values())
    got = texts(text, "c.yaml")
    if len(text) < C.LONGEST:
        assert got == [text] * bool(text)
        return
    head = blocks.get("run_id", blocks[keys[0]])
    assert got == [head + note] * bool(note) + [b if b == head else head + b for b in blocks.values()]
    assert got == texts(text, "c.YML")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['{"k": 1}', "[2, 3]", '"s t"', "7", " ", ""]), max_size=6), ENDS)
def test_json_and_lines(rows, end):
    text = end.join(rows)
    try:
        json.loads(text)
        assert cuts(text, "x.json") == [(0, len(text), "json")]
    except ValueError:
        assert texts(text, "x.json") == [line for line in lines_of(text) if line.strip()]
    assert texts(text, "x.jsonl") == [line for line in lines_of(text) if line.strip()]


def test_json_beyond_the_reader():
    for deep in ("[" * 150_000 + "]" * 150_000, '{"n": ' + "3" * 6_000 + "}"):
        assert {k for *_, k in cuts(deep, "x.json")} == {"json"} and cuts(deep, "x.json")[-1][1] == len(deep)


def test_strategies_and_odd_rows(spark):
    rows = [("n.md", None), ("e.py", ""), (None, "no path"), ("deep.json", "[" * 150_000), ("q.csv", 'k,v\n"two\nlines",1\n')]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.kind) for r in C.structured_chunks(files).collect()}
    assert got == {(None, "fixed"), ("deep.json", "json"), ("q.csv", "csv_header"), ("q.csv", "csv_row")}
    with pytest.raises(ValueError):
        C.structured_chunks(files, "semantic")
