import datetime as dt

from pyspark.sql import functions as F

from panelweave.operators import (
    across,
    drop_suffix,
    first_activity,
    ordinal_from_labels,
    recode,
    split_labels,
    upper_case_names,
    zero_fill,
)
from panelweave.plans import fixed_values as fv


def test_first_activity_replaces_the_date_for_every_row(spark, collect):
    d = dt.date
    rows = [
        ("a", 2021, d(2015, 12, 31), d(1980, 1, 1)),
        ("a", 2022, d(2010, 6, 1), d(1980, 1, 1)),
        ("b", 2021, None, None),
        (None, 2021, d(2020, 1, 1), d(1990, 1, 1)),
        (None, 2022, d(2019, 1, 1), d(1990, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "id string, year int, start date, born date")
    out = first_activity(df, "id", "start", "year", born="born")
    assert out.columns == ["id", "year", "start", "born", "tenure", "age"]
    assert collect(out, "id", "year", "start", "tenure", "age") == [
        ("a", 2021, d(2010, 6, 1), 11, 41),
        ("a", 2022, d(2010, 6, 1), 12, 42),
        ("b", 2021, None, None, None),
        (None, 2021, d(2019, 1, 1), 2, 31),
        (None, 2022, d(2019, 1, 1), 3, 32),
    ]


def education(spark, labels):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, FORMACAO string")
    out = ordinal_from_labels(
        df, "FORMACAO", r"\+", 5, fv.CREDENTIAL_LEVEL, fv.EDUCATION_LEVELS, rank="rank", label="level"
    )
    return out, {r["i"]: r for r in out.collect()}


def test_labels_map_to_the_highest_level(spark):
    out, got = education(
        spark,
        [
            None,
            "ENSINO MÉDIO",
            " LICENCIATURA-PLENA + MESTRADO ",
            "A+B+C+D+ESPECIALIZAÇÃO",
            "A+B+C+D+E+DOUTORADO",
            "CURSO LIVRE",
            "",
            "DOUTORADO+\t",
        ],
    )
    assert out.columns == ["i", *[f"FORMACAO_{n}" for n in range(1, 6)], "rank", "level"]
    assert [(got[i]["rank"], got[i]["level"]) for i in range(8)] == [
        (None, None),
        (1, "sem ensino superior"),
        (4, "mestrado"),
        (3, "especialização"),
        (None, None),
        (None, None),
        (None, None),
        (5, "doutorado"),
    ]
    assert got[2]["FORMACAO_1"] == "LICENCIATURA-PLENA" and got[2]["FORMACAO_3"] is None
    assert got[4]["FORMACAO_5"] == "E"
    assert got[6]["FORMACAO_1"] == "" and got[0]["FORMACAO_1"] is None
    assert got[7]["FORMACAO_2"] == ""


def test_split_can_keep_its_source(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    assert split_labels(df, "t", " ", 2, keep=True).columns == ["t", "t_1", "t_2"]


def test_contract_and_race_rules(spark):
    df = spark.createDataFrame([(c,) for c in ["A", "P", "F", "N", "O", "D", "C", "X", None]], "c string")
    got = {r["c"]: r["t"] for r in recode(df, "c", fv.CONTRACT_RULES, otherwise=None, name="t").collect()}
    assert got == {
        "A": "Efetivo",
        "P": "Estável",
        "F": "Estável",
        "N": "Estável",
        "O": "Temporário",
        "D": "NI",
        "C": "NI",
        "X": None,
        None: None,
    }


def test_names_patterns_and_suffixes(spark):
    df = spark.createDataFrame([(1, None, None, 5)], "tt_a int, TOT_B int, other int, TOTAL_DIAS_MES int")
    filled = zero_fill(df, "^(TT|TOT)").first()
    assert tuple(filled) == (1, 0, None, 5)
    assert upper_case_names(df).columns == ["TT_A", "TOT_B", "OTHER", "TOTAL_DIAS_MES"]
    doubled = across(df, "^tt_", lambda c: c * 2, "{col}_cat")
    assert doubled.first()["tt_a_cat"] == 2
    assert drop_suffix(doubled, "_cat").columns == df.columns
    assert doubled.where(F.col("tt_a_cat") == 2).count() == 1
