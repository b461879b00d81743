"""Table functions for SQL: chunkers and fusion over table arguments.

``register(spark)`` makes them known to the session:

    SELECT * FROM chunks(TABLE(files), 'markdown')
    SELECT * FROM fused(TABLE(lists) PARTITION BY (query_id), 60)

Their schemas follow from their arguments (``analyze``): the columns of the table that a
function doesn't use are carried along, and a table without the columns that it needs is an
error before anything runs. Null texts have no chunks; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from harrier.operators import chunking
from harrier.shipping import ship

STRATEGIES = ("auto", "fixed", "markdown", "ast")


def _columns(table: AnalyzeArgument, needed: tuple[str, ...], name: str) -> StructType:
    """The table's schema, which must have the ``needed`` columns."""
    if not table.isTable:
        raise ValueError(f"the first argument of {name} must be a table")
    if missing := set(needed) - set(table.dataType.names):
        raise ValueError(f"{name} needs the columns {sorted(missing)}")
    return table.dataType


@udtf
class Chunks:
    """``chunks(TABLE(t), strategy)``: for each row ``(path, text, ...)`` the other columns, then
    ``path, start, end, kind, text`` of its chunks, as ``chunking.structured_chunks`` cuts them."""

    @staticmethod
    def analyze(files: AnalyzeArgument, strategy: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _columns(files, ("path", "text"), "chunks")
        if strategy is not None and strategy.value not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy.value!r}")
        taken = ("path", "text", "start", "end", "kind")
        kept = [f for f in schema.fields if f.name not in taken]
        own = [StructField("path", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType()), StructField("text", StringType())]
        return AnalyzeResult(schema=StructType(kept + own))

    def eval(self, files: Row, strategy: str = "auto") -> Iterator[tuple]:
        kept = [v for name, v in files.asDict().items() if name not in ("path", "text", "start", "end", "kind")]
        for chunk in chunking.chunks_of(files["path"], files["text"] or "", strategy):
            yield (*kept, *chunk)


@udtf
class Fused:
    """``fused(TABLE(lists) PARTITION BY (query_id), k)``: reciprocal rank fusion of the rows ``(query_id,
    item, rank)`` of each query: ``query_id, item, rrf``. What is held is one sum for each
    item of a query's lists."""

    def __init__(self) -> None:
        self.query, self.sums = None, {}

    @staticmethod
    def analyze(lists: AnalyzeArgument, k: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _columns(lists, ("query_id", "item", "rank"), "fused")
        return AnalyzeResult(schema=StructType([StructField("query_id", schema["query_id"].dataType), StructField("item", schema["item"].dataType), StructField("rrf", DoubleType())]))

    def eval(self, lists: Row, k: int = 60) -> None:
        self.query = lists["query_id"]
        self.sums[lists["item"]] = self.sums.get(lists["item"], 0.0) + 1.0 / (k + lists["rank"])

    def terminate(self) -> Iterator[tuple]:
        for item, total in self.sums.items():
            yield self.query, item, round(total, 10)


def register(spark: SparkSession) -> None:
    """Make ``chunks`` and ``fused`` callable from the session's SQL."""
    ship(spark)
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("fused", Fused)
