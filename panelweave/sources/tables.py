"""Persist and load panels and report tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def save_panel(df: DataFrame, path: str, by: str | None = "YEAR") -> None:
    """Write a panel as Parquet, one directory per ``by`` value."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def load_panel(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a saved panel; filters on its ``by`` column skip whole directories.

    An empty panel leaves no file to take column names from, so a caller that knows the
    ``schema`` should give it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save_report(table: DataFrame, path: str) -> None:
    """Write a finished report table, a few rows, as one Parquet file."""
    table.coalesce(1).write.mode("overwrite").parquet(path)


def staged(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a table and read it back, so later stages start from files, not from its lineage."""
    save_panel(df, path, by)
    return load_panel(df.sparkSession, path, df.schema).select(*df.columns)


def stage_folder(spark: SparkSession) -> str:
    """A new folder for one job's stages, in a folder that all executors share; what is left in it goes when the driver ends.

    ``spark.checkpoint.dir`` names it; where that is unset it is the warehouse, which
    has to be shared too. There is always one, so a plan never depends on the setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    base = shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    folder = f"{base.rstrip('/')}/panelweave-{uuid.uuid4().hex}"
    atexit.register(_remove_at_end, spark, folder)
    return folder


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder while the session still runs; without one there is no way to reach the file system."""
    with contextlib.suppress(Exception):
        if not spark.sparkContext._jsc.sc().isStopped():
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a stage folder once no table is read from it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reused(df: DataFrame) -> DataFrame:
    """Write a table that several parts of a query read, so that it is computed once.

    The write runs here, while the query is being built; the table it returns is lazy.
    """
    return staged(df, stage_folder(df.sparkSession))
