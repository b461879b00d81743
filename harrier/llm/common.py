"""Helpers shared by the operators: scratch tables, shipped code, row passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrier.shipping import ship

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (as in
    tests) a temporary folder takes its place.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="harrier-")
        spark.sparkContext.setCheckpointDir(_own_dir)
    return _own_dir


#: Paths handed out and not yet deleted.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. ``Scratch`` deletes what isn't needed any more; the
    folder's owner clears the rest after the session."""
    path = f"{shared_dir(spark)}/harrier/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


class Scratch:
    """Deletes the scratch tables of a step when the next step's table is written: on
    ``settle``, all made since the last one but ``kept``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.since, self.held = spark, len(_scratch), None

    def settle(self, kept: str) -> None:
        for path in [p for p in [*_scratch[self.since :], self.held] if p and p != kept]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        del _scratch[self.since :]
        self.held = kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts the
    lineage, and a lost executor costs no recomputation."""
    return written(df, scratch_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, columns: list[str | Column], rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``rows`` over the given columns as one narrow pass; Arrow batches carry
    the values. ``rows`` takes and yields tuples, so that its memory is one batch."""
    ship(df.sparkSession)
    picked = df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)))
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch):
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in rows(values()):
            held.append(row)
            if len(held) >= 2048:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return picked.mapInArrow(run, schema)


#: Rows of a batch that are Python objects at a time.
SLICE = 256


def slices(batch):
    """A batch or array in slices of few rows: long texts shouldn't all be Python objects at once."""
    return (batch.slice(at, SLICE) for at in range(0, len(batch), SLICE))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores, so that it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
