"""Clean the raw teacher and school tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.codes import keep_last, replace_prefix
from panelweave.functions.missing import number_to_text, row_mean, row_sum
from panelweave.functions.periods import leading_date
from panelweave.operators.columns import add_years_since, earliest_dates, ordinal_from_labels, recode
from panelweave.operators.joins import keyed_join
from panelweave.operators.quality import consistent_entities, keep_singleton_keys
from panelweave.plans import fixed_values as fv

LASTING_TRAITS = ["ID_COR", "SEXO", "DATA_NASCIMENTO"]
FIRST_DAY = "DATA_INICIO_EXERCICIO_E"
TEACHER_MONTH_SCHOOL = ["YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA"]


def active_rows(raw: DataFrame) -> DataFrame:
    """Teachers' rows with dates parsed and race recoded; no rows move."""
    rows = raw.where(F.col("QUADRO_E") == fv.TEACHER_STAFF).drop("QUADRO_E")
    rows = rows.withColumns({c: leading_date(c) for c in ("DATA_NASCIMENTO", FIRST_DAY)})
    return recode(rows, "ID_COR", fv.RACE_RULES)


def active_records(rows: DataFrame) -> DataFrame:
    """Distinct teacher records. The start date is left out: it becomes one value per teacher."""
    return rows.drop(FIRST_DAY).distinct()


def clean_active(records: DataFrame, rows: DataFrame, salts: Column | None = None) -> DataFrame:
    """Teachers whose traits agree, with first day, tenure, age and contract type.

    The first day and the check of traits both come to one row per teacher, so they are
    joined to each other first and the records are shuffled once for both.
    """
    first = earliest_dates(rows, "ID_INTERNO", FIRST_DAY)
    agreeing = consistent_entities(records, "ID_INTERNO", LASTING_TRAITS)
    people = keyed_join(first, agreeing, ["ID_INTERNO"], "left_semi", salts=False)
    kept = keyed_join(records, people, ["ID_INTERNO"], "inner", salts)
    kept = add_years_since(kept, "YEAR", {"ANOS_ATIVIDADE": FIRST_DAY, "IDADE": "DATA_NASCIMENTO"})
    return recode(kept, "CATEG_E", fv.CONTRACT_RULES, otherwise=None, name="CATEG_corr")


def absence_records(raw: DataFrame) -> DataFrame:
    """Absence days of teachers on duty at a school."""
    on_duty = raw.where(F.col("QUADRO_EXERC").isin(fv.TEACHER_STAFF_ON_DUTY) & (F.col("CIE_ESCOLA") != 0))
    return on_duty.drop("QUADRO_EXERC").distinct()


def clean_absences(records: DataFrame) -> DataFrame:
    """Keep teacher-month-school keys that occur once."""
    return keep_singleton_keys(records, TEACHER_MONTH_SCHOOL).withColumnRenamed("UA_EXERC", "UAC")


def education_records(raw: DataFrame) -> DataFrame:
    """Credentials split into columns, with the highest level of education."""
    teachers = raw.where((F.col("QUADRO_E") == fv.TEACHER_STAFF) & (F.col("CIE_ESCOLA") != 0)).drop("QUADRO_E")
    known = teachers.withColumn("FORMACAO", F.nullif("FORMACAO", F.lit(fv.NO_EDUCATION)))
    return ordinal_from_labels(
        known,
        "FORMACAO",
        sep=r"\+",
        n=fv.CREDENTIALS_KEPT,
        dictionary=fv.CREDENTIAL_LEVEL,
        levels=fv.EDUCATION_LEVELS,
        rank="NIVEL_FORMACAO_RANK",
        label="NIVEL_FORMACAO",
    ).distinct()


def clean_education(records: DataFrame) -> DataFrame:
    """Keep keys that occur once, then those with any credential, in this order."""
    single = keep_singleton_keys(records, TEACHER_MONTH_SCHOOL)
    return single.where(F.col("FORMACAO_1").isNotNull()).withColumnRenamed("UA_EXERC", "UAC")


def clean_dropout(raw: DataFrame) -> DataFrame:
    """Dropout rates of the state's public schools, with the mean of both stages."""
    public = raw.where((F.col("SG_UF") == fv.STATE_ABBREVIATION) & (F.col("NO_DEPENDENCIA") != fv.PRIVATE))
    return public.select(
        F.col("NU_ANO_CENSO").alias("YEAR"),
        "CO_MUNICIPIO",
        number_to_text("CO_ENTIDADE").alias("CIE_ESCOLA"),
        "NO_CATEGORIA",
        "NO_DEPENDENCIA",
        "3_CAT_FUN",
        "3_CAT_MED",
        row_mean("3_CAT_FUN", "3_CAT_MED").alias("drop_mean"),
    )


def clean_census(raw: DataFrame) -> DataFrame:
    """Enrolment of state-run schools with primary or secondary pupils."""
    state = raw.where((F.col("CO_UF") == fv.STATE_CODE) & (F.col("TP_DEPENDENCIA") == fv.STATE_RUN))
    return state.select(
        F.col("NU_ANO_CENSO").alias("YEAR"),
        number_to_text("CO_ENTIDADE").alias("CIE_ESCOLA"),
        "QT_MAT_FUND",
        "QT_MAT_MED",
        "QT_MAT_BAS_PRETA",
        row_sum("QT_MAT_FUND", "QT_MAT_MED").cast("bigint").alias("QT_MAT_FUND_MED"),
    ).where("QT_MAT_FUND_MED > 0")


def clean_index(raw: DataFrame) -> DataFrame:
    """Socioeconomic index of state-run schools."""
    state = raw.where((F.col("CO_UF") == fv.STATE_CODE) & (F.col("TP_DEPENDENCIA") == fv.STATE_RUN))
    return state.select(
        number_to_text("CO_ESCOLA").alias("CIE_ESCOLA"),
        F.col("INSE_VALOR_ABSOLUTO").alias("INSE_VALOR_ABSOLUTO_2019"),
    )


def school_code(code: Column | str) -> Column:
    """School code as the school tables write it."""
    return replace_prefix(keep_last(number_to_text(code), fv.SCHOOL_CODE_WIDTH), fv.SCHOOL_CODE_PREFIX)
