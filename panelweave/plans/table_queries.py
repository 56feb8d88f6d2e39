"""Every panel operator over the supplied order, shipment, customer, part and event tables.

Customers and suppliers stand in for teachers, months of order or shipment for periods,
nations for schools, market segments for contract types and order priorities for motives.
Sums of doubles are rounded, because the order of a distributed sum is not fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.codes import keep_last, lookup, replace_prefix
from panelweave.functions.missing import (
    count_distinct,
    flag,
    if_else,
    is_in,
    not_in,
    number,
    number_to_text,
    row_max,
    row_mean,
    row_sum,
)
from panelweave.functions.rounding import round_nearest
from panelweave.functions.periods import days_in_month, leading_date, period_in_text, period_of, period_start, period_year
from panelweave.operators import (
    Dim,
    Fact,
    Link,
    Variable,
    across,
    assemble_panel,
    attribute_conflict_profile,
    balance_check,
    balance_panel,
    composition_table,
    distinct_entity_row,
    distinct_rows,
    drop_conflicting_entities,
    drop_suffix,
    first_activity,
    grid_join,
    group_difference_table,
    keep_singleton_keys,
    key_multiplicity_profile,
    key_salts,
    keyed_join,
    link_coverage,
    ordinal_from_labels,
    panel_cells,
    present,
    recode,
    retention,
    stack_report,
    upper_case_names,
    zero_fill,
)
from panelweave.operators import cells
from panelweave.sources import reused

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT_LEVELS = {"building": "BUILDING", "machinery": "MACHINERY"}
REGION_LEVELS = {"asia": "ASIA", "europe": "EUROPE"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(*names: str, digits: int = 4) -> dict[str, Column]:
    return {n: F.round(n, digits) for n in names}


def day_text(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("date").cast("string")


# Sources, projections, filters


def period_stamp(spark, sf):
    """Stamp rows with a period found in text and derive year, month start and month length."""
    named = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("orders_"), period_of("o_orderdate"), F.lit(".csv")).alias("file"), "o_orderpriority"
    )
    stamped = named.withColumns({"mmyy": period_in_text("file"), "no_stamp": period_in_text("o_orderpriority")})
    return stamped.select(
        "o_orderkey",
        "mmyy",
        "no_stamp",
        period_year("mmyy").alias("stamp_year"),
        day_text(period_start("mmyy")).alias("month_start"),
        days_in_month(period_start("mmyy")).alias("month_days"),
    )


def scan_filter_dedup(spark, sf):
    """Equality, disjunctive and comparison filters that reject NULL, then full-row de-duplication."""
    orders = table(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    kept = orders.where((F.col("status") == "F") & (F.col("o_totalprice") > 1000) & (F.col("o_custkey") != 0))
    kept = kept.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return kept.select("o_custkey", F.year("o_orderdate").alias("order_year"), "status", "o_orderpriority").distinct()


def row_duplicates(spark, sf):
    """Rows of which some were written twice or three times, each kept once."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("A")).alias("flag"), F.nullif("l_linestatus", F.lit("F")).alias("status"), "l_quantity"
    )
    again = lines.where(F.col("l_orderkey") % 50 == 0)
    return distinct_rows(lines.unionByName(again).unionByName(again.where(F.col("l_linenumber") < 3)))


def exact_cells(spark, sf):
    """Sums, means and a derived ratio by ship year and flag that no order of rows changes."""
    lines = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    known = F.when(F.col("l_linenumber") != 4, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    signed = F.when(F.col("l_orderkey") % 2 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")) / 3
    metrics = [
        cells.total("income", known),
        cells.total("signed", signed),
        cells.mean("mean_tax", F.col("l_tax") / 7),
        cells.derived("per_tax", F.try_divide(F.col("income"), F.col("mean_tax"))),
    ]
    out = panel_cells(lines, ["ship_year", "l_returnflag"], "l_suppkey", metrics, exact=True)
    return out.withColumns(rounded("income", "signed", digits=5) | rounded("per_tax", digits=3) | rounded("mean_tax", digits=12))


def rounding_rule(spark, sf):
    """Ties and prices rounded to the nearest double with that many places."""
    lines = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        round_nearest(F.col("l_quantity") / 8).alias("eighths"),
        round_nearest(-F.col("l_quantity") / 40, 1).alias("fortieths"),
        round_nearest(price, 1).alias("price"),
        round_nearest(price / 7, 3).alias("weekly"),
    )


def filter_keep_null(spark, sf):
    """Exclusion filter that keeps unknown values, counted per value."""
    orders = table(spark, sf, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return orders.where(not_in("priority", ["1-URGENT", "2-HIGH"])).groupBy("priority").agg(F.count("*").alias("n"))


def union_fill(spark, sf):
    """Stack tables by name; columns a table lacks are NULL."""
    orders = table(spark, sf, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("amount")
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment")
    )
    return orders.unionByName(customers, allowMissingColumns=True).select("kind", "key", "amount", "segment")


def rename_and_drop(spark, sf):
    """Upper-case names, add columns by pattern, drop a suffix, rename."""
    supplier = upper_case_names(table(spark, sf, "supplier"))
    marked = across(supplier, "^s_(nationkey|acctbal)$", lambda c: c * 2, "{col}_twice")
    marked = marked.withColumn("S_NATIONKEY_copy", F.col("S_NATIONKEY"))
    return (
        drop_suffix(marked, "_copy")
        .drop("S_NAME")
        .withColumnsRenamed({"S_SUPPKEY": "SUPPLIER", "S_NATIONKEY": "NATION"})
        .withColumns(rounded("S_ACCTBAL", "S_ACCTBAL_twice", digits=2))
    )


# Columns


def first_activity_query(spark, sf):
    """Earliest order per customer on every order, with tenure in calendar years."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.year("o_orderdate").alias("year")
    )
    dated = first_activity(orders, "o_custkey", "day", "year", born="day", first="first_day", deal=["o_orderkey"])
    return dated.select("o_orderkey", "o_custkey", "year", day_text("first_day").alias("first_day"), "tenure", "age")


def recode_values(spark, sf):
    """Recodes with keep, default, membership and three-valued choice over partly NULL status."""
    orders = table(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    coded = recode(orders, "status", [(["O", ""], "S/INFO"), (["F"], "P")], name="kept")
    rules = [(["1-URGENT"], "top"), (["2-HIGH", "3-MEDIUM"], "mid"), (["5-LOW"], "low")]
    coded = recode(coded, "o_orderpriority", rules, otherwise=None, name="band")
    return coded.select(
        "o_orderkey",
        "kept",
        "band",
        is_in("status", ["F"]).alias("is_f"),
        not_in("status", ["F"]).alias("not_f"),
        if_else(F.col("status") == "F", F.lit("yes"), F.lit("no")).alias("choice"),
        flag(F.col("status") == "F").alias("flag_f"),
    )


PART_LEVELS = ["plain", "coloured", "notable"]
PART_WORDS = {
    "small": "plain",
    "large": "plain",
    "blue": "coloured",
    "red": "coloured",
    "widget": "coloured",
    "gizmo": "notable",
    "anvil": "notable",
}


def label_ordinal(spark, sf):
    """Split a label list, map labels to ordered levels, keep the highest; unknown labels give NULL."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" extra words")).alias("p_name"))
    return ordinal_from_labels(parts, "p_name", " ", 3, PART_WORDS, PART_LEVELS)


def dictionary_lookup(spark, sf):
    """Dictionary lookup where an unknown key gives NULL."""
    words = {"ECONOMY": "cheap", "STANDARD": "usual", "PROMO": "cheap"}
    return table(spark, sf, "part").select("p_partkey", lookup("p_type", words).alias("price_band"))


def row_reducers(spark, sf):
    """Sum, mean and maximum across columns that are partly NULL."""
    cols = (F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)))
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(row_sum(*cols), 4).alias("sum_known"),
        F.round(row_mean(*cols), 4).alias("mean_known"),
        F.round(row_max(*cols), 4).alias("max_known"),
    )


def code_normalise(spark, sf):
    """Number to text, keep the last eight digits after padding, overwrite the prefix."""
    text = number_to_text(F.col("c_custkey") * 1000003.0)
    return table(spark, sf, "customer").select(
        "c_custkey", text.alias("raw_code"), replace_prefix(keep_last(text, 8), "35").alias("site_code")
    )


def parse_text(spark, sf):
    """Dates with one- or two-digit parts and trailing text, and numbers with unreadable ones as NULL."""
    day, money = F.col("o_orderdate"), F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string")
    short = F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))
    written = F.when(F.col("o_orderstatus") == "F", F.concat(short, F.lit(" 00:00"))).when(
        F.col("o_orderstatus") == "O", short
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        day_text(leading_date(F.coalesce(written, F.lit("unknown")))).alias("parsed_day"),
        number(F.when(F.col("o_orderpriority") == "5-LOW", "--").otherwise(money)).alias("parsed_number"),
    )


# Quality control


def shipped_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate"))


def attribute_conflicts(spark, sf):
    """Rows whose order carries several return flags or line statuses, per year."""
    return attribute_conflict_profile(
        shipped_lines(spark, sf), "l_orderkey", ["l_returnflag", "l_linestatus"], by="ship_year"
    )


def drop_conflicting(spark, sf):
    """Lines of orders with exactly one known line status."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return drop_conflicting_entities(lines, "l_orderkey", ["l_linestatus"])


def drop_conflicting_null(spark, sf):
    """The same when one status is unknown: orders without any known status go too."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_linestatus", F.lit("O")).alias("status"), "l_returnflag"
    )
    return drop_conflicting_entities(lines, "l_orderkey", ["status", "l_returnflag"])


def customer_months(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), period_of("o_orderdate").alias("mmyy"), "o_custkey", "o_orderkey", "o_totalprice"
    )


def key_multiplicity(spark, sf):
    """Customer-month keys and those seen more than once, per year."""
    return key_multiplicity_profile(customer_months(spark, sf), ["year", "mmyy", "o_custkey"], by="year")


def singleton_keys(spark, sf):
    """Lines whose (order, line number) occurs once."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return keep_singleton_keys(lines, ["l_orderkey", "l_linenumber"])


# Linking


def dated_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("order_year", F.year("o_orderdate"))


def order_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")


def order_customers(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return customers.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))


def link_coverage_query(spark, sf):
    """Orders with lines, with a customer of known segment, and with both, per year."""
    with_lines = order_lines(spark, sf).groupBy("o_orderkey").agg(F.count("*").alias("n_lines"))
    links = [
        Link("lines", with_lines, ("o_orderkey",), "n_lines"),
        Link("customer", order_customers(spark, sf), ("o_custkey",), "segment"),
    ]
    return link_coverage(dated_orders(spark, sf), links, by="order_year", both="all_links")


def link_coverage_fan_out(spark, sf):
    """The same with every line counted as a joined row."""
    lines = order_lines(spark, sf).withColumn("returned", F.nullif("l_returnflag", F.lit("N")))
    links = [
        Link("lines", lines, ("o_orderkey",), "returned"),
        Link("customer", order_customers(spark, sf), ("o_custkey",), "segment"),
    ]
    return link_coverage(dated_orders(spark, sf), links, by="order_year", both="all_links")


def link_coverage_whole_key(spark, sf):
    """User-days of one event kind that also hold two other kinds; keys repeat on every side."""
    events = table(spark, sf, "events").select(
        day_text("ts").alias("day"), "user_id", "event_type", "value"
    )
    of_kind = lambda kind: events.where(F.col("event_type") == kind)
    key = ("user_id", "day")
    links = [Link("click", of_kind("click"), key, "value"), Link("buy", of_kind("purchase"), key, "value")]
    return link_coverage(of_kind("view"), links, by="day", both="click_and_buy")


def left_join_facts(spark, sf):
    """Left joins on a shared four-column key, clashing names told apart by suffix."""
    keys = ["user_id", "year", "day", "hour_band"]
    events = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.year("ts").alias("year"),
        day_text("ts").alias("day"),
        F.when(F.hour("ts") < 12, "am").when(F.hour("ts") < 18, "pm").alias("hour_band"),
        "event_type",
        F.round("value", 2).alias("value"),
    )
    of_kind = lambda kind: keep_singleton_keys(events.where(F.col("event_type") == kind).drop("event_id", "event_type"), keys)
    base = events.where(F.col("event_type") == "view").drop("event_type")
    salts = key_salts(base, keys)
    with_clicks = keyed_join(base, of_kind("click"), keys, "left", salts, deal=["event_id"])
    return keyed_join(with_clicks, of_kind("purchase").withColumnRenamed("value", "bought"), keys, "left", salts, deal=["event_id"])


def grid_join_facts(spark, sf):
    """Dear lines beside returned lines of the same supplier and month; a third of both sides is of one supplier.

    Counted for each year, with the lines that have no partner.
    """
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 > 0, F.col("l_suppkey")).alias("supplier"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_returnflag",
    )
    keys = ["supplier", "year", "month"]
    dear = lines.where(F.col("l_quantity") > 45).drop("l_returnflag")
    back = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 20)).drop("l_returnflag")
    deal = ["l_orderkey", "l_linenumber"]
    pairs = grid_join(dear, back, keys, "left", deal=(deal, deal))
    known = F.col("l_orderkey_y").isNotNull()
    return pairs.groupBy("year").agg(
        F.count_if(known).alias("pairs"),
        F.count_if(~known).alias("alone"),
        F.sum("l_quantity_x").cast("long").alias("dear_quantity"),
        F.sum(F.when(known, F.pmod(F.col("l_orderkey_x") * 7 + F.col("l_orderkey_y") * 3 + F.col("l_linenumber_y"), F.lit(1000))).otherwise(0)).alias("told_apart"),
    )


def panel_assembly(spark, sf):
    """Orders linked to line sums, returns and customer sites, zero-filled, with a monthly rate."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", period_of("o_orderdate").alias("mmyy"), F.year("o_orderdate").alias("year")
    )
    lines = order_lines(spark, sf)
    shipped = lines.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("TT_quantity"))
    returned = lines.where(F.col("l_returnflag") == "R").groupBy("o_orderkey").agg(F.sum("l_quantity").alias("TOT_returned"))
    site = lambda df: df.withColumn(
        "site", replace_prefix(keep_last(number_to_text("o_custkey"), 8), "35")
    ).drop("o_custkey")
    sites = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            replace_prefix(keep_last(number_to_text("c_custkey"), 8), "35").alias("site"), "c_mktsegment", "n_name", "n_regionkey"
        )
    )
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("n_regionkey"), "r_name")
    return assemble_panel(
        orders,
        [Fact(shipped, "inner", few=True), Fact(returned, "left", few=True)],
        ["o_orderkey"],
        [Dim(sites.join(regions, "n_regionkey"), ("site",))],
        prepare=site,
        zero="^(TT|TOT)",
        period="mmyy",
        month_days="TOTAL_DAYS",
        rate=("RATE", "TOT_returned"),
        fact_salts=False,  # one row for each order
        dim_salts=key_salts(site(orders), ["site"]),
    ).withColumns(rounded("TT_quantity", "TOT_returned", "RATE"))


# Balancing


def supplier_months(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_suppkey", period_of("l_shipdate").alias("mmyy"), F.year("l_shipdate").alias("ship_year"), "l_orderkey", "l_linenumber", "l_quantity"
    )


def balanced_computed(spark, sf):
    """Lines of suppliers that ship in every month of the panel."""
    return balance_panel(supplier_months(spark, sf), "l_suppkey", "mmyy", deal=["l_orderkey", "l_linenumber"])


def balanced_entities_query(spark, sf):
    """Balanced suppliers with their row and month counts."""
    kept = balance_panel(supplier_months(spark, sf), "l_suppkey", "mmyy", deal=["mmyy"])
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.count_distinct("mmyy").alias("n_months"))


def balanced_users(spark, sf):
    """Events of users active on every day."""
    events = table(spark, sf, "events").select("event_id", "user_id", day_text("ts").alias("day"), "event_type")
    return balance_panel(events, "user_id", "day")


def customer_years(spark, sf) -> DataFrame:
    return dated_orders(spark, sf).select("o_orderkey", "o_custkey", "order_year", "o_orderstatus")


def balanced_fixed(spark, sf):
    """Orders of customers with orders in exactly seven years."""
    return balance_panel(customer_years(spark, sf), "o_custkey", "order_year", length=7)


def balance_report(spark, sf):
    """Balanced suppliers per year."""
    kept = balance_panel(supplier_months(spark, sf), "l_suppkey", "mmyy", deal=["ship_year"])
    return balance_check(kept, "l_suppkey", "ship_year", "suppliers")


def balance_retention(spark, sf):
    """Share of lines left after balancing."""
    lines = supplier_months(spark, sf)
    return retention(balance_panel(lines, "l_suppkey", "mmyy", deal=["mmyy"]), lines).withColumns(rounded("retained"))


# Cells and reports


def site_orders(spark, sf, orders_where: Column | None = None, sites_where: Column | None = None) -> DataFrame:
    """Orders with customer, nation and region; contract and education stand-ins partly NULL.

    Conditions come before the join, so that they reach the scans, and rows are dealt by price
    alone, so that columns nobody reads stay in the files.
    """
    sites = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "n_name", "r_name")
    )
    orders = dated_orders(spark, sf).withColumn("contract", F.nullif("o_orderstatus", F.lit("P")))
    orders = orders if orders_where is None else orders.where(orders_where)
    sites = sites if sites_where is None else sites.where(sites_where)
    return keyed_join(orders, sites, ["o_custkey"], "inner", deal=["o_totalprice"])


def site_cells(spark, sf) -> DataFrame:
    price, balance = F.col("o_totalprice").cast("decimal(12,2)"), F.col("c_acctbal").cast("decimal(12,2)")
    total_price = F.col("total_price").cast("double")
    return panel_cells(
        site_orders(spark, sf),
        ["order_year", "n_name", "r_name"],
        "o_custkey",
        [
            cells.entities("n_customers"),
            cells.total("total_price", price),
            cells.derived("price_per_day", total_price / 365),
            cells.derived("price_per_customer", F.try_divide(total_price, "n_customers")),
            cells.share("share_large", F.col("o_totalprice") >= 250000),
            cells.entities("n_open", F.col("contract") == "O"),
            cells.entities("n_open_na", F.col("contract") == "O", count_na=True),
            cells.share("share_open", F.col("contract") == "O"),
            cells.share("share_urgent", F.col("o_orderpriority") == "1-URGENT"),
            cells.mean("mean_balance", balance),
            cells.mean("mean_price", price),
        ],
    )


def panel_cells_query(spark, sf):
    """Year by nation cells: distinct customers, totals, shares, means and ratios.

    Money is summed as decimals, so every result is exact and needs no rounding.
    """
    return site_cells(spark, sf).withColumn("total_price", F.col("total_price").cast("double"))


def reported(df: DataFrame) -> DataFrame:
    """A report table without the section column, rounded."""
    numbers = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns(rounded(*numbers))


LINE_VARIABLES = [
    Variable("l_quantity", "Quantity"),
    Variable("l_extendedprice", "Price"),
    Variable("nullif(l_discount, 0)", "Discount when given"),
    Variable("cast(l_returnflag = 'R' as double)", "Returned"),
]


def group_difference(spark, sf):
    """Line means by status, with difference and standard error; NULL discounts stay in n."""
    levels = {"finished": "F", "open": "O"}
    return reported(
        group_difference_table(table(spark, sf, "lineitem"), "l_linestatus", levels, LINE_VARIABLES, minuend="finished")
    ).drop("section")


CELL_VARIABLES = [
    Variable("n_customers", "Number of customers", "Customers"),
    Variable("share_open", "Open orders", "Customers"),
    Variable("mean_price", "Price", "Orders"),
    Variable("price_per_customer", "Price per customer", "Orders"),
]


def group_difference_site(spark, sf):
    """Cell means in two regions."""
    return reported(
        group_difference_table(site_cells(spark, sf), "r_name", REGION_LEVELS, CELL_VARIABLES, minuend="europe")
    )


def priority_parts() -> list[Variable]:
    price = F.col("o_totalprice")
    return [Variable(F.when(F.col("o_orderpriority") == p, price), p, "Motives") for p in PRIORITIES]


def composition(spark, sf):
    """Shares of order value by priority in two segments, large orders only."""
    rows = site_orders(spark, sf, orders_where=F.col("o_totalprice") > 2000)
    return reported(composition_table(rows, "c_mktsegment", SEGMENT_LEVELS, priority_parts()))


def report_entities(spark, sf):
    """Distinct customers in two segments as one report row."""
    customers = table(spark, sf, "customer")
    return distinct_entity_row(customers, "c_custkey", "c_mktsegment", SEGMENT_LEVELS, "N (customers)")


def report_people(spark, sf):
    """Person-level report: differences, composition and number of customers."""
    rows = reused(site_orders(spark, sf, sites_where=not_in("c_mktsegment", ["FURNITURE", "HOUSEHOLD"])))
    variables = [
        Variable("c_acctbal", "Balance", "General"),
        Variable("o_totalprice", "Price", "General"),
        Variable(flag(is_in("contract", ["O"])), "Open", "Contract"),
        Variable(flag(is_in("o_orderpriority", ["1-URGENT", "2-HIGH"])), "Pressing", "Contract"),
    ]
    return reported(
        stack_report(
            group_difference_table(rows, "c_mktsegment", SEGMENT_LEVELS, variables, minuend="building"),
            composition_table(rows, "c_mktsegment", SEGMENT_LEVELS, priority_parts()),
            distinct_entity_row(rows, "o_custkey", "c_mktsegment", SEGMENT_LEVELS, "N (customers)", "Motives"),
        )
    )


def report_sites(spark, sf):
    """Site-level report over cells, rounded to two places under display titles."""
    rows = reused(site_cells(spark, sf))
    report = stack_report(
        group_difference_table(rows, "r_name", REGION_LEVELS, CELL_VARIABLES, minuend="europe"),
        distinct_entity_row(rows, "n_name", "r_name", REGION_LEVELS, "N (nations)", "Orders"),
    )
    return present(report, 2, {"asia": "Asia", "europe": "Europe", "diff": "Difference", "se_diff": "SE"})


def null_rules(spark, sf):
    """How NULL counts in distinct counts, shares, exclusions, errors and row means, per year."""
    orders = dated_orders(spark, sf).withColumns(
        {
            "contract": F.nullif("o_orderstatus", F.lit("P")),
            "person": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")),
            "amount": F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")),
        }
    )
    open_now = F.col("contract") == "O"
    return (
        orders.groupBy("order_year")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("amount").alias("n_amounts"),
            count_distinct("person").alias("people"),
            count_distinct("person", count_na=True).alias("people_na"),
            count_distinct("person", open_now).alias("open_people"),
            count_distinct("person", open_now, count_na=True).alias("open_people_na"),
            F.count_if(not_in("contract", ["O"])).alias("kept_rows"),
            F.avg(flag(open_now)).alias("share_known"),
            F.avg(flag(is_in("contract", ["O"]))).alias("share_all"),
            F.avg(row_mean("amount", F.nullif("o_totalprice", F.col("amount")))).alias("mean_of_means"),
            F.try_divide(F.stddev_samp("amount"), F.sqrt(F.count("*"))).alias("error"),
        )
        .withColumns(rounded("share_known", "share_all", "mean_of_means", "error"))
    )


def zero_fill_across(spark, sf):
    """Columns chosen by name pattern: missing becomes 0, the total is recomputed afterwards."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("TT_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("TOT_tax"),
        F.nullif("l_linenumber", F.lit(1)).alias("other"),
    )
    filled = zero_fill(lines, "^(tt|tot)")
    return filled.withColumn("TOTAL", F.round(row_sum("TT_discount", "TOT_tax"), 4)).withColumns(
        rounded("TT_discount", "TOT_tax")
    )


TABLE_QUERIES = {
    "period_stamp": period_stamp,
    "scan_filter_dedup": scan_filter_dedup,
    "filter_keep_null": filter_keep_null,
    "row_duplicates": row_duplicates,
    "rounding_rule": rounding_rule,
    "exact_cells": exact_cells,
    "union_fill": union_fill,
    "rename_and_drop": rename_and_drop,
    "first_activity": first_activity_query,
    "recode_values": recode_values,
    "label_ordinal": label_ordinal,
    "dictionary_lookup": dictionary_lookup,
    "row_reducers": row_reducers,
    "code_normalise": code_normalise,
    "parse_text": parse_text,
    "zero_fill_across": zero_fill_across,
    "attribute_conflicts": attribute_conflicts,
    "drop_conflicting": drop_conflicting,
    "drop_conflicting_null": drop_conflicting_null,
    "key_multiplicity": key_multiplicity,
    "singleton_keys": singleton_keys,
    "link_coverage": link_coverage_query,
    "link_coverage_fan_out": link_coverage_fan_out,
    "link_coverage_whole_key": link_coverage_whole_key,
    "left_join_facts": left_join_facts,
    "grid_join_facts": grid_join_facts,
    "panel_assembly": panel_assembly,
    "balanced_computed": balanced_computed,
    "balanced_entities": balanced_entities_query,
    "balanced_users": balanced_users,
    "balanced_fixed": balanced_fixed,
    "balance_report": balance_report,
    "balance_retention": balance_retention,
    "panel_cells": panel_cells_query,
    "group_difference": group_difference,
    "group_difference_site": group_difference_site,
    "composition": composition,
    "report_entities": report_entities,
    "report_people": report_people,
    "report_sites": report_sites,
    "null_rules": null_rules,
}
