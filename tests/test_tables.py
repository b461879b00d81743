"""Table functions against the operators that they stand for."""

import pytest
from pyspark.errors import AnalysisException
from support import rows_of

from harrier.functions import tables
from harrier.operators import chunking as C
from harrier.operators import ranking as R

FILES = [("a.md", "# A\nx\n## B\ny\n", 1), ("b.py", "import os\ndef f():\n    pass\n", 2), ("c.txt", "word " * 300, 3), ("d.md", None, 4), (None, "plain", 5)]


def test_chunks_of_a_table(spark):
    tables.register(spark)
    files = spark.createDataFrame(FILES, "path string, text string, n int")
    files.createOrReplaceTempView("files_of_test")
    for strategy in tables.STRATEGIES:
        got = spark.sql(f"SELECT path, start, `end`, kind, text FROM chunks(TABLE(files_of_test), '{strategy}')")
        assert rows_of(got) == rows_of(C.structured_chunks(files, strategy))
    carried = spark.sql("SELECT * FROM chunks(TABLE(SELECT * FROM files_of_test WHERE n = 1))")
    assert carried.columns == ["n", "path", "start", "end", "kind", "text"] and {r.n for r in carried.collect()} == {1}
    assert spark.sql("SELECT * FROM chunks(TABLE(SELECT * FROM files_of_test WHERE n = 9))").count() == 0
    for wrong in ("chunks(TABLE(files_of_test), 'semantic')", "chunks(TABLE(SELECT n FROM files_of_test))", "chunks('x')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_fusion_by_query(spark):
    tables.register(spark)
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "b", 1), (2, "c", 1), (None, "z", 4)], "query_id int, item string, rank int")
    lists.createOrReplaceTempView("lists_of_test")
    for k in (60, 1):
        assert rows_of(spark.sql(f"SELECT * FROM fused(TABLE(lists_of_test) PARTITION BY (query_id), {k})")) == rows_of(R.rrf(lists, k))
