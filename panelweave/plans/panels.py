"""Teacher-by-month and school-by-year panels and their two descriptive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.missing import flag, is_in, not_in
from panelweave.functions.periods import days_in_month, period_start
from panelweave.operators import cells
from panelweave.operators.balance import balance_panel
from panelweave.operators.columns import zero_fill
from panelweave.operators.link import Dim, Fact, Link, add_rate, join_dims, join_facts, link_coverage
from panelweave.operators.report import (
    Variable,
    composition_table,
    distinct_entity_row,
    group_difference_table,
    stack_report,
)
from panelweave.plans import fixed_values as fv
from panelweave.plans.staff import school_code

TEACHER_MONTH_UNIT = ["ID_INTERNO", "YEAR", "DATE", "UAC"]
SCHOOL_YEAR = ["CIE_ESCOLA", "YEAR"]


def record_coverage(active: DataFrame, education: DataFrame, absences: DataFrame) -> DataFrame:
    """Per year, how many teacher records have education, absence, or both."""
    keys = tuple(TEACHER_MONTH_UNIT)
    links = [
        Link("education", education, keys, "FORMACAO_1"),
        Link("absence", absences, keys, "TOTAL_DIAS_MES"),
    ]
    return link_coverage(active, links, by="YEAR", both="both")


def link_records(
    active: DataFrame, education: DataFrame, absences: DataFrame, salts: Column | None = None
) -> DataFrame:
    """Teacher records with education, and absences where known, under normalised school codes."""
    # Both tables have one row for each teacher, month and school.
    facts = [Fact(education, "inner", few=True), Fact(absences, "left", drop=("CIE_ESCOLA",), few=True)]
    linked = join_facts(active, facts, TEACHER_MONTH_UNIT, salts).drop("CATEG_E", "UAC")
    return linked.withColumn("CIE_ESCOLA", school_code("CIE_ESCOLA"))


def school_coverage(linked: DataFrame, dropout: DataFrame, census: DataFrame, index: DataFrame) -> DataFrame:
    """Per year, how many linked records find their school in each school table."""
    links = [
        Link("dropout", dropout, tuple(SCHOOL_YEAR), "CO_MUNICIPIO"),
        Link("censo", census, tuple(SCHOOL_YEAR), "QT_MAT_FUND_MED"),
        Link("inse", index, ("CIE_ESCOLA",), "INSE_VALOR_ABSOLUTO_2019"),
    ]
    return link_coverage(linked, links, by="YEAR")


def teacher_panel(
    linked: DataFrame, dropout: DataFrame, census: DataFrame, index: DataFrame, salts: Column | None = None
) -> DataFrame:
    """Unbalanced teacher-by-month panel with school data and the absence rate."""
    dims = [Dim(dropout, tuple(SCHOOL_YEAR)), Dim(census, tuple(SCHOOL_YEAR)), Dim(index, ("CIE_ESCOLA",))]
    panel = zero_fill(join_dims(linked, dims, salts), fv.ZERO_FILLED)
    panel = panel.withColumn("TOTAL_DIAS_MES", days_in_month(period_start("DATE")))
    return add_rate(panel, "ABS_RATE", "TOT_DIAS_AUSENCIAS", "TOTAL_DIAS_MES")


def balanced_teachers(panel: DataFrame) -> DataFrame:
    """Teachers present in every month of the panel."""
    return balance_panel(panel, "ID_INTERNO", "DATE")


def school_panel(panel: DataFrame, count_na: bool = False) -> DataFrame:
    """Unbalanced school-by-year panel."""
    contract, education = F.col("CATEG_corr"), F.col("NIVEL_FORMACAO")
    # The names are those that readers of the panel expect.
    metrics = [
        cells.entities("n_prof", count_na=count_na),
        cells.total("dias_aus_totais", "TOT_DIAS_AUSENCIAS"),
        cells.derived("dias_aus_medio_ano", F.col("dias_aus_totais") / fv.DAYS_PER_YEAR),
        cells.derived("dias_aus_por_prof", F.try_divide("dias_aus_totais", "n_prof")),
        cells.share("prop_prof_10dias", F.col("TOT_DIAS_AUSENCIAS") >= fv.LONG_ABSENCE_DAYS),
        cells.mean("abs_rate_medio", "ABS_RATE"),
        cells.entities("n_temp", contract == fv.TEMPORARY, count_na),
        cells.entities("n_efet", contract == fv.PERMANENT, count_na),
        cells.share("prop_temp", contract == fv.TEMPORARY),
        cells.share("prop_efetivo", contract == fv.PERMANENT),
        cells.mean("idade_media", "IDADE"),
        cells.mean("exp_media", "ANOS_ATIVIDADE"),
        cells.share("perc_prof_fem", F.col("SEXO") == "F"),
        cells.share("perc_prof_pretos", F.col("ID_COR") == "P"),
        cells.share("perc_prof_ens_sup", education == fv.DEGREE),
        cells.share("perc_prof_mes", education == fv.MASTERS),
        cells.share("perc_prof_dou", education == fv.DOCTORATE),
        cells.mean("drop_mean", "drop_mean"),
        cells.mean("qt_mat", "QT_MAT_FUND_MED"),
        cells.mean("qt_mat_preta", "QT_MAT_BAS_PRETA"),
        cells.derived("per_alu_pretos", F.try_divide("qt_mat_preta", "qt_mat")),
        cells.mean("inse", "INSE_VALOR_ABSOLUTO_2019"),
    ]
    return cells.panel_cells(panel, ["YEAR", "CIE_ESCOLA", "CO_MUNICIPIO", "NO_CATEGORIA"], "ID_INTERNO", metrics)


def balanced_schools(schools: DataFrame) -> DataFrame:
    """Schools present in every year."""
    return balance_panel(schools, "CIE_ESCOLA", "YEAR", length=fv.SCHOOL_PANEL_YEARS)


def teacher_table(panel: DataFrame, count_na: bool = False) -> DataFrame:
    """Teachers by contract type: characteristics, absence motives, number of teachers."""
    chosen = panel.where(not_in("CATEG_corr", [fv.NOT_INFORMED, fv.STABLE]))
    levels = {"civil_servant": fv.PERMANENT, "contract": fv.TEMPORARY}
    higher = [fv.SPECIALISATION, fv.MASTERS, fv.DOCTORATE]
    variables = [
        Variable("IDADE", fv.AGE, fv.GENERAL),
        Variable("ANOS_ATIVIDADE", fv.EXPERIENCE, fv.GENERAL),
        Variable(flag(F.col("SEXO") == "F"), fv.WOMEN, fv.GENERAL),
        Variable(flag(is_in("NIVEL_FORMACAO", [fv.DEGREE])), fv.BA_DEGREE, fv.TRAINING),
        Variable(flag(is_in("NIVEL_FORMACAO", higher)), fv.MA_DEGREE, fv.TRAINING),
        Variable("ABS_RATE", fv.ABSENCE_RATE, fv.ABSENCES),
    ]
    motives = [Variable(column, label, fv.ABSENCES) for column, label in fv.MOTIVES.items()]
    return stack_report(
        group_difference_table(chosen, "CATEG_corr", levels, variables, minuend="civil_servant"),
        composition_table(chosen, "CATEG_corr", levels, motives, where=F.col("TOT_DIAS_AUSENCIAS") > 0),
        distinct_entity_row(chosen, "ID_INTERNO", "CATEG_corr", levels, fv.TEACHERS_COUNTED, fv.ABSENCES, count_na),
    )


def school_table(schools: DataFrame, count_na: bool = False) -> DataFrame:
    """Schools by location: teachers, absences, school characteristics, number of schools."""
    levels = {"urban": fv.URBAN, "rural": fv.RURAL}
    variables = [
        Variable("n_prof", fv.STAFF_SIZE, fv.TEACHER_TRAITS),
        Variable("idade_media", fv.AGE, fv.TEACHER_TRAITS),
        Variable("exp_media", fv.EXPERIENCE, fv.TEACHER_TRAITS),
        Variable("prop_temp", fv.CONTRACT_SHARE, fv.TEACHER_TRAITS),
        Variable("abs_rate_medio", fv.ABSENCE_RATE, fv.ABSENCES),
        Variable("prop_prof_10dias", fv.LONG_ABSENCE_SHARE, fv.ABSENCES),
        Variable("qt_mat", fv.PUPILS, fv.SCHOOL_TRAITS),
        Variable("aluno_prof", fv.PUPILS_PER_TEACHER, fv.SCHOOL_TRAITS),
        Variable("drop_mean", fv.DROPOUT_RATE, fv.SCHOOL_TRAITS),
        Variable("inse", fv.SOCIAL_INDEX, fv.SCHOOL_TRAITS),
    ]
    return stack_report(
        group_difference_table(
            add_rate(schools, "aluno_prof", "qt_mat", "n_prof"), "NO_CATEGORIA", levels, variables, minuend="rural"
        ),
        distinct_entity_row(schools, "CIE_ESCOLA", "NO_CATEGORIA", levels, fv.SCHOOLS_COUNTED, fv.SCHOOL_TRAITS, count_na),
    )
