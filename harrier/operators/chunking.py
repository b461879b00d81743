"""Chunkers: a row of a file becomes rows of chunks with their place in it.

Fixed windows are column expressions; lines and formats with state (Markdown fences,
quoted CSV records, Python and YAML blocks) are cut in Arrow batches. Chunks carry
character positions; ``with_bytes`` adds UTF-8 byte ranges and stable ids.
"""

from __future__ import annotations

import ast
import csv
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.functions import text as T
from harrier.shipping import ship

SIZE, OVERLAP = 512, 50
LONGEST, RECUT_OVERLAP = 2_000, 80

#: Start, end, kind, and what the chunk's text has before it.
Cut = tuple[int, int, str, str]


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """``array<struct<start, end, text>>`` of windows of ``size`` characters, each
    starting ``size - overlap`` after the one before; the last ends the text. Windows
    of white space are left out."""
    step = _step(size, overlap)
    n = F.char_length(text)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.filter(cut, lambda c: c["text"].rlike(r"(?U)\S"))


def fixed_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``(keys..., start, end, text)``."""
    return files.select(*keys, F.explode(windows(F.coalesce("text", F.lit("")), size, overlap)).alias("c")).select(*keys, "c.*")


def line_chunks(files: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Each line that isn't blank; ``\\r\\n``, ``\\r`` and ``\\n`` end lines, nothing else. One pass over a text."""
    ship(files.sparkSession)

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        found = [[{"start": a, "end": a + len(line), "text": line} for a, b in _lines(t) if (line := t[a:b].rstrip("\r\n")).strip(" ")] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))

    return files.select(*keys, F.explode(cut(F.coalesce("text", F.lit("")))).alias("c")).select(*keys, "c.*")


def with_bytes(chunks: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Chunks with ``start_byte``, ``end_byte`` and ``chunk_id`` (SHA-1 of path and range). A file's
    text meets all places of its chunks once, and they are measured in one pass; what is joined
    with the chunks is numbers."""
    ship(chunks.sparkSession)

    @F.arrow_udf("array<bigint>")
    def offsets(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, at in zip(texts.to_pylist(), places.to_pylist()):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the first byte of each character
            out.append(begins[np.minimum(at, len(begins) - 1)])
        return pa.array(out, pa.list_(pa.int64()))

    places = chunks.select(key, F.explode(F.array("start", "end")).alias("at")).groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("at"))
    whole = files.select(key, F.coalesce("text", F.lit("")).alias("whole")).join(places, key)
    byte_of = whole.select(key, "at", offsets("whole", "at").alias("byte")).select(key, F.explode(F.arrays_zip("at", "byte")).alias("x")).select(key, "x.*").distinct()
    starts, ends = (byte_of.select(key, F.col("at").alias(name), F.col("byte").alias(f"{name}_byte")) for name in ("start", "end"))
    out = chunks.join(starts, [key, "start"]).join(ends, [key, "end"]).select(*chunks.columns, "start_byte", "end_byte")
    return out.withColumn("chunk_id", chunk_id(F.col(key), F.col("start_byte"), F.col("end_byte")))


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws(":", path, start.cast("string"), end.cast("string")))


def with_context(chunks: DataFrame, context: Column | None = None) -> DataFrame:
    """Chunks with ``search_text``: a context (the path's words, if none is given), a
    blank line and the text."""
    return chunks.withColumn("search_text", F.concat(context if context is not None else T.path_words("path"), F.lit("\n\n"), F.col("text")))


# The cutters below yield cuts over characters; whoever calls them drops blank ones.


def _step(size: int, overlap: int) -> int:
    if size < 1:
        raise ValueError("a window has one character at least")
    return max(1, size - (overlap if overlap < size else size // 5))


def _fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[Cut]:
    step, at = _step(size, overlap), 0
    while True:
        end = min(at + size, len(text))
        yield at, end, "fixed", ""
        if end == len(text):
            return
        at += step


def _windows(start: int, end: int, kind: str) -> Iterator[Cut]:
    """A stretch, in overlapping windows if it has more than ``LONGEST`` characters."""
    while end - start > LONGEST:
        yield start, start + LONGEST, kind, ""
        start += LONGEST - RECUT_OVERLAP
    yield start, end, kind, ""


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """The ranges of lines, with their ends."""
    at = 0
    for m in re.finditer(r"\r\n|\r|\n", text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _each_line(text: str) -> Iterator[Cut]:
    return ((a, b, "jsonl", "") for a, b in _lines(text))


#: A fence and what follows it, a heading, a top-level key.
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.S)
_HEADING = re.compile(r"#{1,6}\s+\S")
_ANY_HEADING = re.compile(r"#{1,6}(?:\s|$)")
_KEY = re.compile(r"([A-Za-z0-9_-]+):")


def markdown(text: str, empty_headings: bool = False) -> Iterator[Cut]:
    """A cut starts at each heading outside a fence; headings without words count if asked for. A fence, indented by three spaces at
    most, is closed by a bare line of its own character, at least as long; backticks with
    more of them later in the line are code within the line."""
    start, mark, heading = 0, "", _ANY_HEADING if empty_headings else _HEADING
    for a, b in _lines(text):
        line = text[a:b]
        fence, rest = m.groups() if (m := _FENCE.match(line)) else ("", "")
        if mark:
            if fence.startswith(mark) and not rest.strip():
                mark = ""
        elif fence and (fence[0] == "~" or "`" not in rest):
            mark = fence
        elif a and heading.match(line):
            yield from _windows(start, a, "markdown")
            start = a
    yield from _windows(start, len(text), "markdown")


def _record_sizes(text: str, lines: list[tuple[int, int]]) -> list[int]:
    """How many lines each CSV record has; one each, where the text isn't strict CSV, or a
    record over several lines has another number of fields than the first (a stray quote
    would draw in all that follows it)."""
    reader = csv.reader((text[a:b] for a, b in lines), strict=True)
    sizes, width, before = [], 0, 0
    try:
        for row in reader:
            sizes.append(reader.line_num - before)
            before = reader.line_num
            width = width or len(row)
            if sizes[-1] > 1 and len(row) != width:
                return [1] * len(lines)
    except csv.Error:
        return [1] * len(lines)
    return sizes


def csv_rows(text: str) -> Iterator[Cut]:
    """The header, which is the first record that isn't blank, and each further record
    with the header before it. Quoted fields may hold line ends."""
    lines, at, header = list(_lines(text)), 0, ""
    for size in _record_sizes(text, lines):
        a, b = lines[at][0], lines[at + size - 1][1]
        at += size
        if not text[a:b].strip():
            continue
        yield a, b, "csv_row" if header else "csv_header", header
        header = header or text[a:b]


def python_blocks(text: str) -> Iterator[Cut]:
    """A cut for each top-level function or class, from its first decorator on, and for
    each stretch between, without the blank lines it begins with. A text without
    definitions, or that can't be parsed, is cut into windows."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        body = []
    blocks = [n for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    if not blocks:
        yield from _fixed(text)
        return
    begins = [a for a, _ in _lines(text)]
    line = lambda n: begins[n - 1] if n <= len(begins) else len(text)
    at = 0
    for node in blocks:
        a = max(at, line(min([node.lineno, *(d.lineno for d in node.decorator_list)])))
        b = max(a, line(node.end_lineno + 1))
        yield from _stretch(text, begins, at, a)
        yield from _windows(a, b, "ast")
        at = b
    yield from _stretch(text, begins, at, len(text))


def _stretch(text: str, begins: list[int], a: int, b: int) -> Iterator[Cut]:
    word = re.compile(r"\S").search(text, a, b)
    if word:
        yield from _windows(max(a, begins[bisect_right(begins, word.start()) - 1]) if a else 0, b, "ast")


def yaml_blocks(text: str) -> Iterator[Cut]:
    """A short file is one cut; a longer one is cut before its top-level keys, and each
    block has that of ``run_id`` before it, or else that of the first key."""
    if len(text) < LONGEST:
        yield 0, len(text), "yaml", ""
        return
    keys = {a: m[1] for a, b in _lines(text) if (m := _KEY.match(text, a, b))}
    edges = sorted({0, *keys, len(text)})
    blocks = [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()]
    named = [x for x in blocks if x[0] in keys]
    head = next((x for x in named if keys[x[0]] == "run_id"), named[0] if named else None)
    for a, b in blocks:
        yield a, b, "yaml", "" if head is None or (a, b) == head else text[slice(*head)]


def json_text(text: str) -> Iterator[Cut]:
    """JSON is one cut, in windows if it is long; what isn't JSON is cut into lines. JSON
    too deep, or with numbers too long, to be read is JSON all the same."""
    try:
        json.loads(text)
    except json.JSONDecodeError:
        yield from _each_line(text)
        return
    except (ValueError, RecursionError, MemoryError):
        pass
    yield from _windows(0, len(text), "json")


CUTTERS: dict[str, Callable[[str], Iterator[Cut]]] = {
    ".md": markdown,
    ".rst": markdown,
    ".csv": csv_rows,
    ".py": python_blocks,
    ".yaml": yaml_blocks,
    ".yml": yaml_blocks,
    ".json": json_text,
    ".jsonl": _each_line,
}


def structured_chunks(files: DataFrame, strategy: str = "auto", empty_headings: bool = False) -> DataFrame:
    """``(path, start, end, kind, text)`` by the path's extension, or always by one strategy.
    A null text is empty, and an empty or blank text has no chunks; no text makes a cutter fail."""
    if strategy not in ("auto", "fixed", "markdown", "ast"):
        raise ValueError(f"unknown strategy {strategy!r}")

    ship(files.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for path, text in zip(*(c.to_pylist() for c in batch.columns)) for row in chunks_of(path, text or "", strategy, empty_headings)]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                    names=["path", "start", "end", "kind", "text"],
                )

    return files.select("path", "text").mapInArrow(cut, "path string, start int, end int, kind string, text string")


def chunks_of(path: str, text: str, strategy: str = "auto", empty_headings: bool = False) -> Iterator[tuple[str, int, int, str, str]]:
    ending = re.search(r"[^/](\.[^./]+)$", path or "")
    suffix = ending[1].lower() if ending else ""
    cutter = {"fixed": _fixed, "markdown": markdown, "ast": python_blocks}.get(strategy) or CUTTERS.get(suffix, _fixed)
    if cutter is markdown:
        cutter = partial(markdown, empty_headings=empty_headings)
    # where a cutter finds nothing, windows do
    for cuts in (cutter, _fixed):
        found = [c for c in cuts(text) if text[c[0] : c[1]].strip()]
        if found:
            break
    for a, b, kind, head in found:
        yield path, a, b, kind, head + text[a:b]


def pooled_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Late chunking: ``tokens (doc_id, pos, vec)`` and ``spans (doc_id, chunk, first,
    last)`` (at least one token each) give ``(doc_id, chunk, dim, value)``: the mean of
    the span's token vectors, scaled to length 1."""
    spans = spans.select(F.col("doc_id").alias("of"), "chunk", "first", F.greatest("first", "last").alias("last"))
    met = tokens.join(spans, (F.col("doc_id") == F.col("of")) & F.col("pos").between(F.col("first"), F.col("last")))
    inside = met.select("doc_id", "chunk", F.posexplode("vec").alias("dim", "x"))
    mean = inside.groupBy("doc_id", "chunk", "dim").agg(F.avg("x").alias("m"))
    length = mean.groupBy("doc_id", "chunk").agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-12)).alias("length"))
    return mean.join(length, ["doc_id", "chunk"]).select("doc_id", "chunk", "dim", F.round(F.col("m") / F.col("length"), 8).alias("value"))
