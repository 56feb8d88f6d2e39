"""Read directories of delimited files whose columns drift, bound by column name.

Spark binds the columns of a multi-file CSV read by position, so files are grouped by
their header first: the first lines of each file are opened through the session's own file
system, then there is one scan per distinct header, with that header's own column list.
Nothing is cut or guessed: a file that cannot be read as told raises with its path.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.missing import number
from panelweave.functions.periods import period_in_text, period_year
from panelweave.sources.quoted_lines import SPLITTABLE, quoted_records

# Separators tried when none is given, and the text that stands for a missing value.
SEPARATORS = (",", ";", "\t", "|")
MISSING_TEXT = "NA"

QUOTES = {"quote": '"', "escape": '"'}
TRIM = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
#: Read as the separator of a scan that wants whole lines; no text file holds it.
NO_SEPARATOR = "\0"
#: Files whose first lines are opened at once.
OPENED_AT_ONCE = 16


@dataclass
class Layout:
    """Files of one header: its column names, and how many filled lines, and lines at all, each file has up to it."""

    sep: str
    names: list[str]
    leading: dict[str, int] = field(default_factory=dict)
    lines: dict[str, int] = field(default_factory=dict)


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """Paths and sizes of the files whose name fits a glob; file contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")


def first_lines(spark: SparkSession, path: str, skip: int, encoding: str) -> list[str]:
    """The lines of a file up to its header, opened as Spark would open it, and closed after them.

    Without a preamble the header is the first line that is not blank.
    """
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    raw = where.getFileSystem(hadoop).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop).getCodec(where)
        stream = codec.createInputStream(raw) if codec is not None else raw
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        lines: list[str] = []
        while (line := reader.readLine()) is not None:
            lines.append(line.lstrip("﻿") if not lines else line)
            if len(lines) > skip and (skip or line.strip()):
                break
        return lines
    finally:
        raw.close()


def split_header(header: str, sep: str | None) -> tuple[str, list[str]]:
    """Separator (the most frequent candidate outside quotes when not given) and upper-cased column names."""
    bare = re.sub(r'"[^"]*"', "", header)
    sep = sep or max(SEPARATORS, key=bare.count)
    # csv's own limit on a field's length would refuse long names.
    csv.field_size_limit(max(csv.field_size_limit(), len(header) + 1))
    names = [n.strip().upper() for n in next(csv.reader([header], delimiter=sep, skipinitialspace=True))]
    repeated = {n for n in names if n and names.count(n) > 1}
    if repeated:
        raise ValueError(f"repeated column names in header: {sorted(repeated)}")
    return sep, [n or f"_UNNAMED_{i}" for i, n in enumerate(names)]


def file_layouts(
    spark: SparkSession, path: str, pattern: str, recursive: bool, skip: int, encoding: str, sep: str | None = None
) -> list[Layout]:
    """The files of a directory by header. One header for each file reaches the driver, like the file index."""
    files = sorted(r["path"] for r in list_files(spark, path, pattern, recursive).where("length > 0").select("path").toLocalIterator())
    with ThreadPoolExecutor(OPENED_AT_ONCE) as pool:
        tops = pool.map(lambda f: first_lines(spark, f, skip, encoding), files)
        found: dict[str, Layout] = {}
        for file, lines in zip(files, tops):
            if not any(line.strip() for line in lines):
                continue  # a file of blank lines only has nothing to lose
            if len(lines) <= skip or not lines[-1].strip():
                raise ValueError(f"no header after {skip} lines in {file}")
            if any(line.count('"') % 2 for line in lines):
                raise ValueError(f"a quoted line break up to the header of {file}")
            if lines[-1] not in found:
                try:
                    found[lines[-1]] = Layout(*split_header(lines[-1], sep))
                except ValueError as wrong:
                    raise ValueError(f"{wrong} in {file}") from wrong
            found[lines[-1]].leading[file] = sum(bool(line.strip()) for line in lines)
            found[lines[-1]].lines[file] = len(lines)
    return list(found.values())


def _literal(path: str) -> str:
    """A path as it is, where Spark would take some characters for a glob."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _drop_leading(leading: dict[str, int]):
    """Task function: drop each file's lines up to its header, counting only where a file begins."""

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            top = batch.loc[batch["__start"] == 0, "__path"]
            order = top.groupby(top).cumcount() + top.map(seen).fillna(0)
            for path, n in top.value_counts().items():
                seen[path] = seen.get(path, 0) + int(n)
            header = top.map(leading)
            yield batch.loc[~batch.index.isin(order.index[order < header])].drop(columns=["__path", "__start"])

    return drop


def _scan(spark: SparkSession, layout: Layout, skip: int, encoding: str, multi_line: bool) -> DataFrame:
    """All columns as text, with the file name as ``__file``."""
    paths, names = [_literal(p) for p in layout.leading], layout.names
    if multi_line and encoding.upper() in SPLITTABLE:
        lines = quoted_records(spark, paths, _by_scan_name(spark, layout, layout.lines), encoding.upper())
        return _parsed(lines, layout, {"multiLine": "true"})
    options = _field_options(layout)
    file = F.col("_metadata.file_name").alias("__file")
    place = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start")]
    reader = spark.read.option("encoding", encoding).option("header", str(skip == 0).lower())
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if multi_line:
        # Files that cannot be cut are read whole by one task each, so their first records come first.
        scan = reader.options(**options, multiLine="true").schema(text).csv(paths)
    else:
        scan = reader.options(sep=NO_SEPARATOR, quote="", maxCharsPerColumn="-1").schema("value string").csv(paths)
    if skip == 0:
        lines = scan.select("*", file)
    else:
        named = _by_scan_name(spark, layout, layout.leading)
        columns = [T.StructField(c, T.StringType()) for c in [*scan.columns, "__file"]]
        lines = scan.select("*", file, *place).mapInPandas(_drop_leading(named), T.StructType(columns))
    if multi_line:
        return lines
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = F.concat(F.lit("a quoted line break, or an open quote, in "), "__file", F.lit("; read it with multi_line. Line: "), F.left("value", F.lit(200)))
    value = F.when(quotes % 2 == 1, F.raise_error(broken)).otherwise(F.col("value"))
    return _parsed(lines.withColumn("value", value), layout, {})


def _parsed(lines: DataFrame, layout: Layout, more: dict[str, str]) -> DataFrame:
    """The fields of each record (value, __file) that is not blank."""
    ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in layout.names)
    options = {**_field_options(layout), "maxCharsPerColumn": "-1", **more}
    row = F.from_csv("value", ddl, options)
    return lines.where(F.length(F.trim("value")) > 0).select(row.alias("__row"), "__file").select("__row.*", "__file")


def _field_options(layout: Layout) -> dict[str, str]:
    return {**TRIM, **QUOTES, "sep": layout.sep, "maxColumns": str(max(20480, len(layout.names)))}


def _by_scan_name(spark: SparkSession, layout: Layout, counts: dict[str, int]) -> dict[str, int]:
    """Counts by file, by the paths as a scan names them."""
    files = spark.read.format("binaryFile").load([_literal(p) for p in layout.leading])
    names = files.select(F.col("path").alias("f"), F.col("_metadata.file_path").alias("p"))
    return {r["p"]: counts[r["f"]] for r in names.toLocalIterator()}


def typed(col: Column, kind: T.DataType, name: str = "") -> Column:
    """Text as a declared type. Blank text stays blank, ``NA`` and unreadable numbers are NULL.

    A whole number may have been written as 3.0 or 3.5e7; one with a fraction is refused, not cut.
    """
    if isinstance(kind, T.StringType):
        return F.nullif(F.coalesce(col, F.lit("")), F.lit(MISSING_TEXT))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number(col).cast(kind)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        read = number(col)
        cut = F.raise_error(F.concat(F.lit(f"column {name} holds whole numbers, but also "), col)).cast(kind)
        whole = F.when(read != F.floor(read), cut).otherwise(read.try_cast(kind))
        plain = F.trim(col).rlike(r"^[+-]?[0-9]+$")  # not by way of a double, which holds 53 bits
        return F.when(plain, F.trim(col).try_cast(kind)).otherwise(whole)
    return F.trim(col).try_cast(kind)


#: Kinds of column from narrow to wide, each with the texts that it takes; what none takes is text.
LOGICAL_TEXT = r"\A(TRUE|True|true|FALSE|False|false)\z"
WHOLE_TEXT = r"\A[+-]?[0-9]+\z"
DATE_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def _kinds(text: Column) -> list[tuple[T.DataType, Column]]:
    return [
        (T.BooleanType(), text.rlike(LOGICAL_TEXT)),
        (T.LongType(), text.rlike(WHOLE_TEXT) & text.try_cast("long").isNotNull()),
        (T.DoubleType(), number(text).isNotNull()),
        (T.DateType(), text.rlike(DATE_TEXT) & text.try_cast("date").isNotNull()),
    ]


def _inferred(tables: list[DataFrame]) -> T.StructType:
    """Types of all text columns of all tables, from one aggregate over them."""
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    if not names:
        return T.StructType([])
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    flags = []
    for i, name in enumerate(names):
        text = F.trim(F.col(f"`{name}`"))
        known = (text != "") & (text != MISSING_TEXT)
        flags += [F.bool_and(F.when(known, fits)).alias(f"f{i}_{k}") for k, (_, fits) in enumerate(_kinds(text))]
    found = stacked.agg(*flags).first()
    kinds = [kind for kind, _ in _kinds(F.lit(""))]
    fitting = lambda i: next((kind for k, kind in enumerate(kinds) if found[f"f{i}_{k}"]), T.StringType())
    return T.StructType([T.StructField(name, fitting(i)) for i, name in enumerate(names)])


def infer_schema(
    spark: SparkSession,
    path: str,
    pattern: str = "*.csv",
    recursive: bool = False,
    skip: int = 0,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> T.StructType:
    """The columns of all files of a directory, upper-cased, with the narrowest type that takes all their values.

    Types are logical, whole number (64 bits), number, date (``yyyy-mm-dd``) and text; a column that holds two kinds without
    a common one, or nothing, is text. Blank and ``NA`` fit any. A file that lacks a column does not widen
    it. One scan and one aggregate for all files and columns; one row comes back.
    """
    layouts = file_layouts(spark, path, pattern, recursive, skip, encoding, sep)
    return _inferred([_scan(spark, layout, skip, encoding, multi_line).drop("__file") for layout in layouts])


def read_period_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    pattern: str = "*.csv",
    recursive: bool = False,
    skip: int = 0,
    sep: str | None = None,
    encoding: str = "UTF-8",
    stamp: bool = True,
    multi_line: bool = False,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """Stack the files of a directory into one table with the declared columns, or without a schema with all, typed by :func:`infer_schema`.

    Columns are found by upper-cased name in each file; one a file lacks is NULL there, but
    a file without any, or without one of ``required``, is refused. ``skip`` preamble
    lines precede the header; without any, blank lines before it are passed over. ``stamp``
    adds ``DATE``, the first four digits of the file name (``MMYY``, NULL without any),
    and the integer ``YEAR``. Doubled quotes stand for one. Quoted line breaks need
    ``multi_line``, with which the quotes of the files are counted first (``quoted_lines``; files
    in encodings of several bytes for a line feed are read by one task each); without it they are refused.
    """
    tables = []
    layouts = file_layouts(spark, path, pattern, recursive, skip, encoding, sep)
    scans = [_scan(spark, layout, skip, encoding, multi_line) for layout in layouts]
    if schema is None:
        schema = _inferred([scan.drop("__file") for scan in scans])
    for layout, scan in zip(layouts, scans):
        first = next(iter(layout.leading))
        absent = [n for n in required if n not in layout.names]
        if absent or not any(f.name in layout.names for f in schema):
            raise ValueError(f"no column {', '.join(absent) or 'that is declared'} in {first}")
        columns = [typed(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in schema if f.name in layout.names]
        if stamp:
            # Scans escape file names; an escape's digits are no period.
            period = period_in_text(F.url_decode(F.replace("__file", F.lit("+"), F.lit(" "))))
            columns = [period.alias("DATE"), period_year(period).alias("YEAR"), *columns]
        tables.append(scan.select(*columns))
    stamped = [T.StructField("DATE", T.StringType()), T.StructField("YEAR", T.IntegerType())] if stamp else []
    empty = spark.createDataFrame([], T.StructType([*stamped, *schema.fields]))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables, empty)
    return stacked.select(*empty.columns)
