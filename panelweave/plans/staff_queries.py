"""The staff panel plans over raw tables derived from orders, shipments and customers.

Customers play teachers, nations schools, and order months the monthly files. Hot keys
are measured on the derived raw tables, once per key, instead of on every later stage, and
tables with several readers are written once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.periods import period_of
from panelweave.operators.joins import key_salts, keyed_join
from panelweave.operators.quality import attribute_conflict_profile, key_multiplicity_profile
from panelweave.plans import fixed_values as fv
from panelweave.plans import panels, staff
from panelweave.plans.table_queries import reported, rounded, table
from panelweave.sources import reused

def by_priority(values: dict[str, str], otherwise: Column) -> Column:
    first = F.left(F.col("o_orderpriority"), F.lit(1))
    result = F
    for digit, value in values.items():
        result = result.when(first == digit, F.lit(value))
    return result.otherwise(otherwise)


def date_text(day: Column) -> Column:
    """``d/M/yyyy`` without padding."""
    return F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))


class StaffTables:
    """Raw stand-in tables and the cleaned stages built on them."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = table(self.spark, self.sf, name)
        return self.tables[name]

    @cached_property
    def dated_orders(self) -> DataFrame:
        return self.read("orders").select(
            "*",
            period_of("o_orderdate").alias("DATE"),
            F.year("o_orderdate").alias("YEAR"),
            F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ID_INTERNO"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            "c_acctbal",
            "c_mktsegment",
            F.col("c_nationkey").cast("bigint").alias("CIE_ESCOLA"),
            F.concat(F.lit("U"), F.col("c_nationkey").cast("string")).alias("UNIT"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return reused(keyed_join(self.dated_orders, self.customers, ["o_custkey"], "inner"))

    @cached_property
    def raw_active(self) -> DataFrame:
        status, low = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
        segment = F.col("c_mktsegment")
        born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("o_custkey") % 12000).cast("int"))
        usual_race = F.when(segment == "BUILDING", "D").when(segment == "AUTOMOBILE", "").when(segment == "MACHINERY", "N")
        return self.orders.select(
            F.when((status == "P") & low, "QAE").otherwise("QM").alias("QUADRO_E"),
            "DATE",
            "YEAR",
            "ID_INTERNO",
            F.col("UNIT").alias("UAC"),
            by_priority(fv.STAND_IN_CONTRACTS, F.when(status != "F", F.lit("D"))).alias("CATEG_E"),
            F.when(F.col("c_acctbal") >= 0, F.when(segment.isin("BUILDING", "FURNITURE"), "F").otherwise("M")).alias("SEXO"),
            F.when(F.col("o_totalprice") > 499000, "N").otherwise(F.coalesce(usual_race, F.lit("B"))).alias("ID_COR"),
            F.concat(date_text(born), F.lit(" 00:00")).alias("DATA_NASCIMENTO"),
            F.when(F.col("o_totalprice") < 2000, "sem data").otherwise(date_text(F.col("o_orderdate"))).alias("DATA_INICIO_EXERCICIO_E"),
        )

    @cached_property
    def raw_education(self) -> DataFrame:
        return self.orders.select(
            "YEAR",
            "DATE",
            F.lit("QM").alias("QUADRO_E"),
            "ID_INTERNO",
            "CIE_ESCOLA",
            F.col("UNIT").alias("UA_EXERC"),
            by_priority(fv.STAND_IN_LABELS, F.lit(None)).alias("FORMACAO"),
        )

    @cached_property
    def raw_absences(self) -> DataFrame:
        kind = F.concat("l_returnflag", "l_linestatus")
        days = lambda code: F.sum(F.when(kind == code, F.col("l_linenumber"))).cast("int")
        per_order = (
            self.read("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.when(F.max("l_linestatus") == "O", "QM-SUPORTE").otherwise("QM-DOCENTE").alias("QUADRO"),
                days("AF").alias("TT_DIAS_FALTA_MEDICA"),
                days("AO").alias("TT_DIAS_FALTA_JUST"),
                days("NF").alias("TT_DIAS_FALTA_INJUST"),
                days("NO").alias("TT_DIAS_LIC_PREMIO"),
                days("RF").alias("TT_DIAS_LIC_GESTANTE"),
                days("RO").alias("TT_DIAS_LIC_ACID_TRAB"),
                F.count_if(F.col("l_quantity") > 45).cast("int").alias("TT_DIAS_LIC_INTER_PARTIC"),
                F.sum("l_linenumber").cast("int").alias("TOT_DIAS_AUSENCIAS"),
            )
        )
        columns = [c for c in per_order.columns if c not in ("o_orderkey", "QUADRO")]
        return keyed_join(self.orders, per_order, ["o_orderkey"], "inner").select(
            F.when(F.col("o_orderstatus") == "P", "QAE").otherwise(F.col("QUADRO")).alias("QUADRO_EXERC"),
            "YEAR",
            "DATE",
            "ID_INTERNO",
            F.col("UNIT").alias("UA_EXERC"),
            "CIE_ESCOLA",
            *columns,
            F.lit(30).alias("TOTAL_DIAS_MES"),
        )

    @cached_property
    def schools(self) -> DataFrame:
        """Nation by year counts."""
        status = F.col("o_orderstatus")
        sites = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        sites = sites.withColumn("CIE_ESCOLA", F.col("n_nationkey").cast("bigint"))
        counts = self.orders.groupBy("CIE_ESCOLA", "YEAR").agg(
            F.count("*").cast("int").alias("orders"),
            *[F.count_if(status == s).cast("int").alias(f"orders_{s}") for s in "FOP"],
        )
        return counts.join(sites, "CIE_ESCOLA").withColumn("CO_ENTIDADE", F.col("CIE_ESCOLA") + 35000000)

    @cached_property
    def dropout(self) -> DataFrame:
        nation = F.col("n_nationkey")
        raw = self.schools.select(
            F.col("YEAR").alias("NU_ANO_CENSO"),
            F.lit("SP").alias("SG_UF"),
            (F.col("n_regionkey") + 100).cast("int").alias("CO_MUNICIPIO"),
            "CO_ENTIDADE",
            F.when(F.col("r_name").isin("ASIA", "EUROPE"), "Rural").otherwise("Urbana").alias("NO_CATEGORIA"),
            F.when(nation == 24, "Privada").otherwise("Estadual").alias("NO_DEPENDENCIA"),
            F.when(nation != 5, F.col("orders_F") / 100.0).alias("3_CAT_FUN"),
            F.when((F.col("n_regionkey") != 0) & (nation != 5), F.col("orders_P") / 100.0).alias("3_CAT_MED"),
        )
        return staff.clean_dropout(raw)

    @cached_property
    def census(self) -> DataFrame:
        raw = self.schools.select(
            F.col("YEAR").alias("NU_ANO_CENSO"),
            F.when(F.col("n_nationkey") == 3, 33).otherwise(35).alias("CO_UF"),
            "CO_ENTIDADE",
            F.lit(2).alias("TP_DEPENDENCIA"),
            F.col("orders").alias("QT_MAT_FUND"),
            F.when(F.col("n_regionkey") != 1, F.col("orders_P")).alias("QT_MAT_MED"),
            F.col("orders_O").alias("QT_MAT_BAS_PRETA"),
        )
        return staff.clean_census(raw)

    @cached_property
    def index(self) -> DataFrame:
        raw = self.read("nation").select(
            F.lit(35).alias("CO_UF"),
            F.lit(2).alias("TP_DEPENDENCIA"),
            (F.col("n_nationkey").cast("bigint") + 35000000).alias("CO_ESCOLA"),
            (F.col("n_regionkey") + 4.5).cast("double").alias("INSE_VALOR_ABSOLUTO"),
        )
        return staff.clean_index(raw)

    @cached_property
    def teacher_salts(self) -> Column:
        return key_salts(self.orders, ["ID_INTERNO"])

    @cached_property
    def active_rows(self) -> DataFrame:
        return staff.active_rows(self.raw_active)

    @cached_property
    def active_records(self) -> DataFrame:
        return staff.active_records(self.active_rows)

    @cached_property
    def active(self) -> DataFrame:
        return staff.clean_active(self.active_records, self.active_rows, self.teacher_salts)

    @cached_property
    def education_records(self) -> DataFrame:
        return staff.education_records(self.raw_education)

    @cached_property
    def education(self) -> DataFrame:
        return staff.clean_education(self.education_records)

    @cached_property
    def absence_records(self) -> DataFrame:
        return staff.absence_records(self.raw_absences)

    @cached_property
    def absences(self) -> DataFrame:
        return staff.clean_absences(self.absence_records)

    @cached_property
    def linked(self) -> DataFrame:
        salts = key_salts(self.orders.withColumnRenamed("UNIT", "UAC"), panels.TEACHER_MONTH_UNIT)
        return panels.link_records(self.active, self.education, self.absences, salts)

    @cached_property
    def teachers(self) -> DataFrame:
        coded = self.orders.withColumn("CIE_ESCOLA", staff.school_code("CIE_ESCOLA"))
        salts = key_salts(coded, panels.SCHOOL_YEAR)
        return panels.teacher_panel(self.linked, self.dropout, self.census, self.index, salts)

    @cached_property
    def school_panel(self) -> DataFrame:
        return panels.school_panel(self.teachers)


def staff_active(spark, sf):
    """Consistent teacher records with tenure, age, race and contract type."""
    active = StaffTables(spark, sf).active
    return active.withColumns({c: F.col(c).cast("string") for c in ("DATA_NASCIMENTO", "DATA_INICIO_EXERCICIO_E")})


def staff_active_conflicts(spark, sf):
    """Teacher records per year whose teacher changes race, sex or birth date."""
    records = StaffTables(spark, sf).active_records
    return attribute_conflict_profile(records, "ID_INTERNO", staff.LASTING_TRAITS, by="YEAR")


def staff_education(spark, sf):
    """Teacher-month education with credentials and the highest level."""
    return StaffTables(spark, sf).education


def staff_education_repeats(spark, sf):
    """Repeated teacher-month-school keys of the education records, per year."""
    records = StaffTables(spark, sf).education_records
    return key_multiplicity_profile(records, staff.TEACHER_MONTH_SCHOOL, by="YEAR")


def staff_absence_repeats(spark, sf):
    """Repeated teacher-month-school keys of the absence records, per year."""
    records = StaffTables(spark, sf).absence_records
    return key_multiplicity_profile(records, staff.TEACHER_MONTH_SCHOOL, by="YEAR")


def staff_absences(spark, sf):
    """Absence days of teacher-month-school keys that occur once."""
    return StaffTables(spark, sf).absences


def staff_record_coverage(spark, sf):
    """Teacher records with education, absences and both, per year."""
    t = StaffTables(spark, sf)
    return panels.record_coverage(t.active, t.education, t.absences)


def staff_school_coverage(spark, sf):
    """Linked records whose school is in the dropout, census and index tables, per year."""
    t = StaffTables(spark, sf)
    return panels.school_coverage(t.linked, t.dropout, t.census, t.index)


def staff_teacher_panel(spark, sf):
    """Unbalanced teacher-by-month panel."""
    panel = StaffTables(spark, sf).teachers
    dates = {c: F.col(c).cast("string") for c in ("DATA_NASCIMENTO", "DATA_INICIO_EXERCICIO_E")}
    return panel.withColumns({**dates, **rounded("ABS_RATE", "drop_mean")})


def staff_school_panel(spark, sf):
    """Unbalanced school-by-year panel with its 22 metrics."""
    panel = StaffTables(spark, sf).school_panel
    return panel.withColumns(rounded(*[c for c, kind in panel.dtypes if kind == "double"]))


def staff_teacher_table(spark, sf):
    """Teachers by contract type."""
    return reported(panels.teacher_table(reused(StaffTables(spark, sf).teachers)))


def staff_school_table(spark, sf):
    """Schools by location."""
    return reported(panels.school_table(reused(StaffTables(spark, sf).school_panel)))


STAFF_QUERIES = {
    "staff_active": staff_active,
    "staff_active_conflicts": staff_active_conflicts,
    "staff_absences": staff_absences,
    "staff_absence_repeats": staff_absence_repeats,
    "staff_education": staff_education,
    "staff_education_repeats": staff_education_repeats,
    "staff_record_coverage": staff_record_coverage,
    "staff_school_coverage": staff_school_coverage,
    "staff_teacher_panel": staff_teacher_panel,
    "staff_school_panel": staff_school_panel,
    "staff_teacher_table": staff_teacher_table,
    "staff_school_table": staff_school_table,
}
