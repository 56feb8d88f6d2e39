"""The whole job: raw files to panels, quality reports and descriptive tables.

Each stage is written once and read back, so no stage is computed twice and a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.operators.balance import balance_check, retention
from panelweave.operators.quality import attribute_conflict_profile, key_multiplicity_profile
from panelweave.plans import fixed_values as fv
from panelweave.plans import panels, schemas, staff
from panelweave.sources import load_panel, read_period_files, remove_folder, save_report, stage_folder, staged


def run(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    encoding: str = "UTF-8",
    multi_line: bool = False,
    count_na: bool = False,
) -> dict[str, DataFrame]:
    """Read ``raw_dir``, write every panel and report under ``out_dir``, and return them by name.

    ``multi_line`` reads quoted line breaks; ``count_na`` counts missing teachers and contracts
    as one more value in distinct counts.
    """
    stages = stage_folder(spark)

    def read(folder, schema, recursive=False, skip=0, stamp=True):
        path = f"{raw_dir}/{folder}"
        return read_period_files(
            spark, path, schema, recursive=recursive, skip=skip, encoding=encoding, stamp=stamp, multi_line=multi_line
        )

    def stage(df, name):
        return staged(df, f"{stages}/{name}")

    results: dict[str, DataFrame] = {}

    def panel(df, name):
        results[name] = staged(df, f"{out_dir}/{name}", by="YEAR")
        return results[name]

    def report(df, name):
        save_report(df, f"{out_dir}/reports/{name}")
        results[name] = load_panel(spark, f"{out_dir}/reports/{name}", df.schema)

    rows = stage(staff.active_rows(read(fv.ACTIVE_DIR, schemas.ACTIVE)), "active_rows")
    records = stage(staff.active_records(rows), "active_records")
    report(attribute_conflict_profile(records, "ID_INTERNO", staff.LASTING_TRAITS, by="YEAR"), "active_conflicts")
    active = stage(staff.clean_active(records, rows), "active")

    records = stage(staff.absence_records(read(fv.ABSENCE_DIR, schemas.ABSENCES, recursive=True)), "absence_records")
    report(key_multiplicity_profile(records, staff.TEACHER_MONTH_SCHOOL, by="YEAR"), "absence_repeats")
    absences = stage(staff.clean_absences(records), "absences")

    records = stage(staff.education_records(read(fv.EDUCATION_DIR, schemas.EDUCATION, recursive=True)), "education_records")
    report(key_multiplicity_profile(records, staff.TEACHER_MONTH_SCHOOL, by="YEAR"), "education_repeats")
    education = stage(staff.clean_education(records), "education")

    dropout = stage(
        staff.clean_dropout(
            read(fv.DROPOUT_DIR, schemas.DROPOUT, recursive=True, skip=fv.DROPOUT_PREAMBLE, stamp=False)
        ),
        "dropout",
    )
    census = stage(staff.clean_census(read(fv.CENSUS_DIR, schemas.CENSUS, stamp=False)), "census")
    index = stage(staff.clean_index(read(fv.INDEX_DIR, schemas.INDEX, stamp=False)), "index")

    report(panels.record_coverage(active, education, absences), "record_coverage")
    linked = stage(panels.link_records(active, education, absences), "linked")
    report(panels.school_coverage(linked, dropout, census, index), "school_coverage")

    teachers = panel(panels.teacher_panel(linked, dropout, census, index), "teacher_level_unb")
    balanced = panel(panels.balanced_teachers(teachers), "teacher_level_bal")
    report(balance_check(balanced, "ID_INTERNO", "YEAR", "n_teachers"), "teacher_balance")
    report(retention(balanced, teachers), "teacher_retention")

    schools = panel(panels.school_panel(teachers, count_na), "school_level_unb")
    balanced = panel(panels.balanced_schools(schools), "school_level_bal")
    report(balance_check(balanced, "CIE_ESCOLA", "YEAR", "n"), "school_balance")

    report(panels.teacher_table(teachers, count_na), "teacher_table")
    report(panels.school_table(schools, count_na), "school_table")
    remove_folder(spark, stages)
    return results
