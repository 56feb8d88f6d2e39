import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs_table(spark):
    """A small documents table with every odd case: NULLs, empty and repeated rows, and columns of clashing names."""

    def make(rows, extra=True):
        table = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F

            # Names that operators use for columns of their own.
            for name in ("score", "spans", "base", "hash", "bucket", "family", "run", "part", "m", "kept", "block"):
                table = table.withColumn(name, F.lit("own"))
        return table

    return make
