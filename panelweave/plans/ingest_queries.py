"""Ingest and persistence over the order table: written as raw files or panels, and read back.

The files lie in a stage folder of the session and hold all rows of ``orders``, one file or more
for each month. Writing happens when a query is built; it returns the table read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.periods import period_of
from panelweave.plans.table_queries import group_difference
from panelweave.sources import load_panel, read_period_files, reused, save_panel, save_report, stage_folder, workbook, workbook_rows

#: Lines before the header of the files with a preamble.
PREAMBLE = ("Orders of the month", "", "source,in,columns", ",,,", '"5"', "6", "7", "8")

RAW = T.StructType(
    [
        T.StructField("O_ORDERKEY", T.LongType()),
        T.StructField("O_CUSTKEY", T.LongType()),
        T.StructField("O_ORDERPRIORITY", T.StringType()),
        T.StructField("O_TOTALPRICE", T.DoubleType()),
    ]
)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their ``MMYY``, and a priority that needs quoting."""
    priority = F.concat(F.lit('class "'), "o_orderpriority", F.lit('", as told'))
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", "o_custkey", priority.alias("o_orderpriority"), "o_totalprice", period_of("o_orderdate").alias("mmyy")
    )


def _name_by_period(spark: SparkSession, written: str, raw: str, name: str) -> None:
    """Move the part files of each ``mmyy=`` folder to ``raw``, with the period in their names; a few names for each month."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(raw))
    for folder in fs.listStatus(path(written)):
        period = folder.getPath().getName().removeprefix("mmyy=")
        if folder.isDirectory():
            for k, part in enumerate(fs.listStatus(folder.getPath())):
                fs.rename(part.getPath(), path(f"{raw}/{name}_{period} {k}.csv"))


def _odd_month() -> Column:
    return F.left("mmyy", F.lit(2)).cast("int") % 2 == 1


def ingest_monthly(spark, sf):
    """Monthly files whose columns drift: odd months have another order, one column more and no priority."""
    folder, orders = stage_folder(spark), _orders(spark, sf)
    raw = f"{folder}/raw"
    even = orders.where(~_odd_month())
    odd = orders.where(_odd_month()).select(
        F.col("o_totalprice").alias("O_TOTALPRICE"), F.lit("x").alias("note, more"), "o_orderkey", F.col("o_custkey").alias("O_CustKey"), "mmyy"
    )
    for name, rows in (("even", even), ("odd", odd)):
        rows.write.partitionBy("mmyy").csv(f"{folder}/{name}", header=True, escape='"')
        _name_by_period(spark, f"{folder}/{name}", raw, name)
    return read_period_files(spark, raw, RAW).withColumnsRenamed({c: c.lower() for c in ("DATE", "YEAR", *RAW.names)})


def ingest_nested(spark, sf):
    """Monthly files in folders below folders: those of even months deeper, and with another name pattern beside them."""
    folder, orders = stage_folder(spark), _orders(spark, sf)
    for name, rows, place in (("odd", orders.where(_odd_month()), "raw/odd"), ("even", orders.where(~_odd_month()), "raw/even/deep")):
        rows.write.partitionBy("mmyy").csv(f"{folder}/{name}", header=True, escape='"')
        _name_by_period(spark, f"{folder}/{name}", f"{folder}/{place}", name)
    orders.select("mmyy").distinct().write.json(f"{folder}/raw/notes")
    found = read_period_files(spark, f"{folder}/raw", RAW, recursive=True)
    return found.withColumnsRenamed({c: c.lower() for c in ("DATE", "YEAR", *RAW.names)})


def report_round_trip(spark, sf):
    """A finished report table, written as one file and loaded again."""
    path = f"{stage_folder(spark)}/report"
    report = group_difference(spark, sf)
    save_report(report, path)
    return load_panel(spark, path, report.schema)


def ingest_preamble(spark, sf):
    """Monthly files with eight lines before the header, one of them blank and one quoted."""
    folder, orders = stage_folder(spark), _orders(spark, sf)
    quoted = F.concat(F.lit('"'), F.replace("o_orderpriority", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "o_totalprice", quoted, "o_custkey", "o_orderkey")
    body = orders.select("mmyy", F.lit(len(PREAMBLE) + 1).alias("k"), line.alias("line"))
    head = F.array(*[F.lit(x) for x in (*PREAMBLE, "o_totalprice,o_orderpriority,o_custkey,o_orderkey")])
    top = orders.select("mmyy").distinct().select("mmyy", F.posexplode(head).alias("k", "line"))
    # One file for each month, as such exports are; its first lines come first.
    lines = top.unionByName(body).repartition("mmyy").sortWithinPartitions("mmyy", "k").drop("k")
    lines.write.partitionBy("mmyy").text(f"{folder}/lines")
    _name_by_period(spark, f"{folder}/lines", f"{folder}/raw", "orders")
    found = read_period_files(spark, f"{folder}/raw", RAW, skip=len(PREAMBLE))
    return found.withColumnsRenamed({c: c.lower() for c in ("DATE", "YEAR", *RAW.names)})


def ingest_line_breaks(spark, sf):
    """Monthly files with line breaks, blank lines and quotes in quoted fields, put together over the blocks of a file."""
    folder, orders = stage_folder(spark), _orders(spark, sf)
    told = F.concat("o_orderpriority", F.lit('\n\n"'), F.col("o_custkey").cast("string"), F.lit('",\n'), F.repeat(F.lit("so on\n"), F.pmod("o_orderkey", F.lit(5)).cast("int")), F.lit("."))
    rows = orders.withColumn("o_orderpriority", told)
    rows.write.partitionBy("mmyy").csv(f"{folder}/lines", header=True, escape='"', quoteAll=True)
    _name_by_period(spark, f"{folder}/lines", f"{folder}/raw", "orders")
    found = read_period_files(spark, f"{folder}/raw", RAW, multi_line=True)
    return found.withColumnsRenamed({c: c.lower() for c in ("DATE", "YEAR", *RAW.names)})


def ingest_inferred(spark, sf):
    """Monthly files read without a schema: flags, dates, whole numbers, prices and texts, with gaps and drifting columns."""
    folder = stage_folder(spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.col("o_orderkey")
    rows = orders.select(
        F.when(key % 7 > 0, key.cast("string")).otherwise("NA").alias("Order Key"),
        F.when(key % 5 > 0, F.when(F.col("o_orderstatus") == "O", "TRUE").otherwise("false")).alias("open"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"),
        F.when(key % 11 > 0, F.col("o_totalprice").cast("string")).otherwise(F.floor("o_totalprice").cast("string")).alias("price"),
        F.when(key % 1000 == 1, F.lit("none")).otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        period_of("o_orderdate").alias("mmyy"),
    )
    for name, part in (("even", rows.where(~_odd_month())), ("odd", rows.where(_odd_month()).select("price", "placed", "Order Key", "customer", "mmyy"))):
        part.write.partitionBy("mmyy").csv(f"{folder}/{name}", header=True)
        _name_by_period(spark, f"{folder}/{name}", f"{folder}/raw", name)
    found = read_period_files(spark, f"{folder}/raw")
    return found.select(
        "DATE",
        F.col("ORDER KEY").alias("order_key"),
        F.col("OPEN").alias("is_open"),
        F.date_add("PLACED", 1).cast("string").alias("next_day"),
        (F.col("PRICE") * 2).alias("twice"),
        F.concat("CUSTOMER", F.lit("!")).alias("customer"),
    ).withColumnRenamed("DATE", "date")


#: Rows of a workbook of the workbook query.
BOOK_ROWS = 5000


def ingest_workbooks(spark, sf):
    """Monthly workbooks with eight rows before the header, merged cells and a sheet to pass over; a month has as many as it needs."""
    orders = _orders(spark, sf).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    sizes = orders.groupBy("mmyy").agg(F.ceil(F.count("*") / BOOK_ROWS).cast("int").alias("books"))
    dealt = orders.join(sizes, "mmyy").withColumn("book", F.pmod(F.xxhash64("o_orderkey"), F.col("books")).cast("int"))

    def bind(rows):
        import pandas as pd

        first = rows.iloc[0]
        head = [["Orders of the month", None, first["mmyy"]], [], ["as told"], [], [None, 5], [], [], ["8"]]
        names = ["o_totalprice", None, "O_CustKey", "o_orderpriority", "o_orderkey"]
        cells = zip(rows["o_totalprice"].tolist(), rows["o_custkey"].tolist(), rows["o_orderpriority"], rows["o_orderkey"].tolist())
        body = [[price, None, customer, priority, key] for price, customer, priority, key in cells]
        content = workbook({"orders": [*head, names, [], *body], "notes": [["o_orderkey"], [1]]}, merged=("A1:B1",))
        return pd.DataFrame({"path": [f"orders_{first['mmyy']} {first['book']}.xlsx"], "content": [content]})

    books = reused(dealt.groupBy("mmyy", "book").applyInPandas(bind, "path string, content binary"))
    found = workbook_rows(books, RAW, "orders", skip=len(PREAMBLE))
    return found.withColumnsRenamed({c: c.lower() for c in ("DATE", "YEAR", *RAW.names)})


def panel_round_trip(spark, sf):
    """Orders saved as a panel by year and loaded again, those of three years only."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("YEAR", F.year("o_orderdate"))
    path = f"{stage_folder(spark)}/panel"
    save_panel(orders.select("o_orderkey", "o_custkey", "o_totalprice", "YEAR"), path)
    return load_panel(spark, path).where(F.col("YEAR").between(1996, 1998))


def null_predicate(spark, sf):
    """An inequality filter that meets NULLs: rows of unknown status go, as a comparison with them is not true."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    kept = orders.where(F.col("status") != "F")
    return kept.groupBy("status", "o_orderpriority").agg(F.count("*").alias("n"))


INGEST_QUERIES = {
    "ingest_monthly": ingest_monthly,
    "ingest_nested": ingest_nested,
    "report_round_trip": report_round_trip,
    "ingest_preamble": ingest_preamble,
    "ingest_line_breaks": ingest_line_breaks,
    "ingest_inferred": ingest_inferred,
    "ingest_workbooks": ingest_workbooks,
    "panel_round_trip": panel_round_trip,
    "null_predicate": null_predicate,
}
