"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.tables import stage_folder

#: Words between ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Most rows of a written table that a join may broadcast.
BROADCAST_ROWS = 200_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; lambdas would evaluate it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_number(value: int) -> Column:
    return F.lit(value).cast("long")


def split_words(text: Column, separators: str) -> Column:
    """The non-empty parts of a text between runs of separators; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. A text of as many bytes as characters holds only ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, match) of a pattern: what lies between matches gives their places."""

    def place(gaps: Column, found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("spans"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.char_length(x["gap"])
            span = F.array(F.struct(start.alias("start"), x["match"].alias("match")))
            return F.struct((start + F.char_length(x["match"])).alias("at"), F.concat(a["spans"], span).alias("spans"))

        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.aggregate(pairs, zero, step, lambda a: a["spans"])

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: let(F.split(text, pattern, -1), lambda g: place(g, m)),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,match:string>>"))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they have no installed copy."""
    home = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if home not in paths.split(":"):
        environment["PYTHONPATH"] = f"{home}:{paths}" if paths else home


class Stages:
    """Tables that one job writes for its own later steps, in the shared folder of the session.

    ``spark.checkpoint.dir`` names that folder; where it is unset the warehouse, which is shared
    too, takes its place. Later steps start from these files, so that a lost executor costs
    the running tasks only. ``drop`` removes a table once nothing reads it any more; what a result
    still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.folder = spark, f"{stage_folder(spark)}/{name}"
        self.written = 0

    def path(self, name: str) -> str:
        self.written += 1
        return f"{self.folder}/{self.written}-{name}"

    def write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = self.path(name)
        df.write.options(compression="zstd", **(options or {})).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._stage_path = path
        return table

    def unsent(self, table: DataFrame) -> DataFrame:
        """A written table, marked so that its joins broadcast neither side if it has many rows.

        Spark takes the bytes of the packed files for the table's size, which in memory may be ten times as much and more.
        """
        return table.hint("merge") if table.count() > BROADCAST_ROWS else table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._stage_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
