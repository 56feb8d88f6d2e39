"""The whole job over a small generated school system, against separate pandas arithmetic."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from panelweave.plans import school_staff

MONTHS = ["0221", "0321", "0222", "0322", "0223", "0224"]
MOTIVES = ["FALTA_MEDICA", "FALTA_JUST", "FALTA_INJUST", "LIC_PREMIO", "LIC_GESTANTE", "LIC_ACID_TRAB", "LIC_INTER_PARTIC"]
LABELS = ["S/INFO", "ENSINO MÉDIO", "LICENCIATURA-PLENA+MESTRADO", " BACHARELADO/TECNÓLOGO ", "A+B+C+D+E+DOUTORADO", "DOUTORADO+X", "OUTRO"]
LEVEL = {
    "ENSINO MÉDIO": "sem ensino superior",
    "LICENCIATURA-PLENA+MESTRADO": "mestrado",
    " BACHARELADO/TECNÓLOGO ": "com ensino superior",
    "DOUTORADO+X": "doutorado",
}
CONTRACT = {"A": "Efetivo", "P": "Estável", "F": "Estável", "N": "Estável", "O": "Temporário", "D": "NI", "C": "NI"}
PREAMBLE = "Ministry\n\nRates\n,,,\n5\n6\n7\n8\n"


def school(code):
    return "35" + f"{code:08d}"[-8:][2:]


def make_raw(root, seed=3):
    """Raw files, and the same rows as pandas tables."""
    pick = random.Random(seed)
    schools = [101, 102, 35000103, 104, 105, 106]
    people = []
    for i in range(60):
        people.append(
            {
                "ID_INTERNO": f"t{i}",
                "SEXO": pick.choice("FM") if i % 11 else None,
                "ID_COR": pick.choice(["", "D", "N", "P", "B"]),
                "born": f"{pick.randint(1, 28)}/{pick.randint(1, 12)}/{pick.randint(1955, 1995)}",
                "start": pick.randint(2000, 2019),
                "CATEG_E": pick.choice(["A", "O", "O", "A", "P", "D", "Z"]),
                "school": pick.choice(schools),
                "always": i < 25,
            }
        )
    active, absences, education = [], [], []
    for mmyy in MONTHS:
        for p in people:
            if not p["always"] and pick.random() < 0.3:
                continue
            units = [p["school"]] if pick.random() < 0.9 else [p["school"], 102 if p["school"] != 102 else 104]
            for code in units:
                unit = f"u{code}"
                for start in {p["start"], pick.randint(2005, 2020)}:
                    active.append(
                        {
                            "DATE": mmyy,
                            "QUADRO_E": "QM" if pick.random() < 0.95 else "QSE",
                            "ID_INTERNO": p["ID_INTERNO"],
                            "UAC": unit,
                            "CATEG_E": p["CATEG_E"],
                            "SEXO": "M" if p["ID_INTERNO"] == "t3" and mmyy == "0322" else p["SEXO"],
                            "ID_COR": p["ID_COR"],
                            "DATA_NASCIMENTO": p["born"] + " 00:00",
                            "DATA_INICIO_EXERCICIO_E": pick.choice([f"01/02/{start}", f"1/2/{start} 00:00:00", "sem data"]),
                        }
                    )
                if pick.random() < 0.9:
                    for _ in range(2 if pick.random() < 0.1 else 1):
                        education.append(
                            {
                                "DATE": mmyy,
                                "QUADRO_E": "QM",
                                "ID_INTERNO": p["ID_INTERNO"],
                                "CIE_ESCOLA": code if pick.random() < 0.97 else 0,
                                "UA_EXERC": unit,
                                "FORMACAO": pick.choice(LABELS),
                            }
                        )
                if pick.random() < 0.6:
                    for _ in range(2 if pick.random() < 0.1 else 1):
                        days = [pick.choice([0, 0, 1, 5, 12]) for _ in MOTIVES]
                        absences.append(
                            {
                                "DATE": mmyy,
                                "QUADRO_EXERC": pick.choice(["QM-DOCENTE", "QM-SUPORTE", "QM-DOCENTE", "QAE"]),
                                "ID_INTERNO": p["ID_INTERNO"],
                                "UA_EXERC": unit,
                                "CIE_ESCOLA": code,
                                **{f"TT_DIAS_{m}": d for m, d in zip(MOTIVES, days)},
                                "TOT_DIAS_AUSENCIAS": sum(days),
                                "TOTAL_DIAS_MES": 30,
                            }
                        )
    dropout, census = [], []
    for year in (2021, 2022, 2023, 2024):
        for n, code in enumerate(schools):
            dropout.append(
                {
                    "NU_ANO_CENSO": year,
                    "SG_UF": "SP",
                    "CO_MUNICIPIO": 500 + n,
                    "CO_ENTIDADE": int(school(code)),
                    "NO_CATEGORIA": "Rural" if n % 2 else "Urbana",
                    "NO_DEPENDENCIA": "Privada" if code == 106 else "Estadual",
                    "3_CAT_FUN": "--" if n in (0, 1) else round(1 + n / 7 + year % 10, 3),
                    "3_CAT_MED": "--" if n == 0 else round(2 + n / 3, 3),
                }
            )
            if code == 104 and year == 2024:
                continue
            census.append(
                {
                    "NU_ANO_CENSO": year,
                    "CO_UF": 35,
                    "CO_ENTIDADE": int(school(code)),
                    "TP_DEPENDENCIA": 2,
                    "QT_MAT_FUND": None if code == 105 else 100 + 10 * n + year % 10,
                    "QT_MAT_MED": None if n in (1, 4) else 50 + n,
                    "QT_MAT_BAS_PRETA": 30 + n,
                }
            )
    index = [{"CO_UF": 35, "TP_DEPENDENCIA": 2, "CO_ESCOLA": int(school(c)), "INSE_VALOR_ABSOLUTO": 4.5 + n / 9} for n, c in enumerate(schools)]
    index.append({"CO_UF": 33, "TP_DEPENDENCIA": 2, "CO_ESCOLA": 33000001, "INSE_VALOR_ABSOLUTO": 9.9})
    raw = {k: pd.DataFrame(v) for k, v in dict(active=active, absences=absences, education=education, dropout=dropout, census=census, index=index).items()}

    def write(folder, name, df, sep=",", before="", after=""):
        path = root / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(before + df.to_csv(index=False, sep=sep, na_rep="NA") + after, encoding="utf-8")

    for k, mmyy in enumerate(MONTHS):
        part = {n: raw[n][raw[n].DATE == mmyy].drop(columns="DATE") for n in ("active", "absences", "education")}
        turned = part["active"][part["active"].columns[::-1]] if k % 2 else part["active"].rename(columns=str.lower)
        write("active-civil-servants", f"ativos_{mmyy}.csv", turned, sep=";" if k % 2 else ",")
        write(f"absences/20{mmyy[2:]}", f"aus_{mmyy}.csv", part["absences"])
        write(f"teacher-education/20{mmyy[2:]}", f"form_{mmyy}.csv", part["education"])
    for year, part in raw["dropout"].groupby("NU_ANO_CENSO"):
        write("dropout", f"tx_{year}.csv", part, before=PREAMBLE, after="Source: ministry\n")
    for year, part in raw["census"].groupby("NU_ANO_CENSO"):
        write("censo", f"censo_{year}.csv", part.astype("Int64"))
    write("inse", "inse.csv", raw["index"])
    return raw


def expected_panel(raw):
    stamped = lambda df: df.assign(YEAR=2000 + df.DATE.str[2:].astype(int))
    a = stamped(raw["active"])
    a = a[a.QUADRO_E == "QM"].drop(columns="QUADRO_E")
    dates = lambda s: pd.to_datetime(s.str.extract(r"^(\d{1,2}/\d{1,2}/\d{4})")[0], format="%d/%m/%Y")
    a["start"] = dates(a.DATA_INICIO_EXERCICIO_E)
    a["born"] = dates(a.DATA_NASCIMENTO)
    a["start"] = a.groupby("ID_INTERNO").start.transform("min")
    a["ANOS_ATIVIDADE"] = a.YEAR - a.start.dt.year
    a["IDADE"] = a.YEAR - a.born.dt.year
    a["ID_COR"] = a.ID_COR.replace({"": "S/INFO", "D": "S/INFO", "N": "P"})
    a = a.drop(columns=["DATA_INICIO_EXERCICIO_E", "DATA_NASCIMENTO"]).drop_duplicates()
    spread = a.groupby("ID_INTERNO")[["ID_COR", "SEXO", "born"]].transform("nunique")
    a = a[(spread == 1).all(axis=1)]
    a["CATEG_corr"] = a.CATEG_E.map(CONTRACT)
    key = ["YEAR", "DATE", "ID_INTERNO", "CIE_ESCOLA"]
    e = stamped(raw["education"])
    e = e[e.CIE_ESCOLA != 0].drop(columns="QUADRO_E")
    e["FORMACAO"] = e.FORMACAO.where(e.FORMACAO != "S/INFO")
    # Labels past the fifth are dropped before duplicates are.
    e["FORMACAO"] = e.FORMACAO.replace({"A+B+C+D+E+DOUTORADO": "A+B+C+D+E"})
    e = e.drop_duplicates()
    e = e[~e.duplicated(key, keep=False) & e.FORMACAO.notna()]
    e["NIVEL_FORMACAO"] = e.FORMACAO.map(LEVEL)
    b = stamped(raw["absences"])
    b = b[b.QUADRO_EXERC.isin(["QM-DOCENTE", "QM-SUPORTE"])].drop(columns="QUADRO_EXERC").drop_duplicates()
    b = b[~b.duplicated(key, keep=False)]
    on = ["ID_INTERNO", "YEAR", "DATE", "UAC"]
    p = a.merge(e.rename(columns={"UA_EXERC": "UAC"}), on=on)
    p = p.merge(b.rename(columns={"UA_EXERC": "UAC"}).drop(columns="CIE_ESCOLA"), on=on, how="left")
    p["CIE_ESCOLA"] = p.CIE_ESCOLA.map(school)
    d = raw["dropout"].query("NO_DEPENDENCIA != 'Privada'").rename(columns={"NU_ANO_CENSO": "YEAR", "CO_ENTIDADE": "CIE_ESCOLA"})
    d = d.assign(CIE_ESCOLA=d.CIE_ESCOLA.astype(str), drop_mean=d[["3_CAT_FUN", "3_CAT_MED"]].apply(pd.to_numeric, errors="coerce").mean(axis=1))
    c = raw["census"].rename(columns={"NU_ANO_CENSO": "YEAR", "CO_ENTIDADE": "CIE_ESCOLA"})
    c = c.assign(CIE_ESCOLA=c.CIE_ESCOLA.astype(str), pupils=c.QT_MAT_FUND.fillna(0) + c.QT_MAT_MED.fillna(0)).query("pupils > 0")
    i = raw["index"].query("CO_UF == 35").assign(CIE_ESCOLA=lambda x: x.CO_ESCOLA.astype(str))
    p = p.merge(d, on=["CIE_ESCOLA", "YEAR"]).merge(c, on=["CIE_ESCOLA", "YEAR"]).merge(i[["CIE_ESCOLA", "INSE_VALOR_ABSOLUTO"]], on="CIE_ESCOLA")
    days = [f"TT_DIAS_{m}" for m in MOTIVES] + ["TOT_DIAS_AUSENCIAS"]
    p[days] = p[days].fillna(0)
    month = pd.to_datetime("01" + p.DATE, format="%d%m%y")
    p["TOTAL_DIAS_MES"] = month.dt.days_in_month
    p["ABS_RATE"] = p.TOT_DIAS_AUSENCIAS / p.TOTAL_DIAS_MES
    return p


def expected_schools(p):
    keys = ["YEAR", "CIE_ESCOLA", "CO_MUNICIPIO", "NO_CATEGORIA"]
    share = lambda g, c, v: (g[c][g[c].notna()] == v).mean()
    rows = []
    for key, g in p.groupby(keys):
        rows.append(
            dict(zip(keys, key))
            | {
                "n_prof": g.ID_INTERNO.nunique(),
                "dias_aus_totais": g.TOT_DIAS_AUSENCIAS.sum(),
                "dias_aus_medio_ano": g.TOT_DIAS_AUSENCIAS.sum() / 365,
                "dias_aus_por_prof": g.TOT_DIAS_AUSENCIAS.sum() / g.ID_INTERNO.nunique(),
                "prop_prof_10dias": (g.TOT_DIAS_AUSENCIAS >= 10).mean(),
                "abs_rate_medio": g.ABS_RATE.mean(),
                "n_temp": g[g.CATEG_corr == "Temporário"].ID_INTERNO.nunique(),
                "n_efet": g[g.CATEG_corr == "Efetivo"].ID_INTERNO.nunique(),
                "prop_temp": share(g, "CATEG_corr", "Temporário"),
                "prop_efetivo": share(g, "CATEG_corr", "Efetivo"),
                "idade_media": g.IDADE.mean(),
                "exp_media": g.ANOS_ATIVIDADE.mean(),
                "perc_prof_fem": share(g, "SEXO", "F"),
                "perc_prof_pretos": share(g, "ID_COR", "P"),
                "perc_prof_ens_sup": share(g, "NIVEL_FORMACAO", "com ensino superior"),
                "perc_prof_mes": share(g, "NIVEL_FORMACAO", "mestrado"),
                "perc_prof_dou": share(g, "NIVEL_FORMACAO", "doutorado"),
                "drop_mean": g.drop_mean.mean(),
                "qt_mat": g.pupils.mean(),
                "qt_mat_preta": g.QT_MAT_BAS_PRETA.mean(),
                "per_alu_pretos": g.QT_MAT_BAS_PRETA.mean() / g.pupils.mean(),
                "inse": g.INSE_VALOR_ABSOLUTO.mean(),
            }
        )
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("staff")
    raw = make_raw(root / "raw")
    results = school_staff.run(spark, str(root / "raw"), str(root / "out"))
    return raw, results, root


def test_teacher_panel(job):
    raw, results, _ = job
    want = expected_panel(raw)
    got = results["teacher_level_unb"].toPandas()
    assert len(got) == len(want) > 100
    columns = ["ID_INTERNO", "DATE", "YEAR", "CIE_ESCOLA", "CATEG_corr", "NIVEL_FORMACAO", "SEXO", "ID_COR", "ANOS_ATIVIDADE", "IDADE", "TOT_DIAS_AUSENCIAS", "TOTAL_DIAS_MES", "ABS_RATE", "drop_mean"]

    def tuples(df):
        clean = df[columns].astype(object).where(df[columns].notna(), None)
        return sorted((tuple(round(float(v), 9) if isinstance(v, (int, float, np.number)) else v for v in r) for r in clean.itertuples(index=False)), key=str)

    assert tuples(got) == tuples(want)
    assert "t3" not in set(got.ID_INTERNO) and "t0" not in set(got.ID_INTERNO)
    assert not {"UAC", "CATEG_E"} & set(got.columns)
    assert set(got.TOTAL_DIAS_MES[got.DATE == "0224"]) == {29}


def test_balanced_panels_and_checks(job):
    raw, results, _ = job
    panel = expected_panel(raw)
    seen = panel.groupby("ID_INTERNO").DATE.nunique()
    full = set(seen[seen == panel.DATE.nunique()].index)
    got = results["teacher_level_bal"].toPandas()
    assert set(got.ID_INTERNO) == full and full
    checks = {r["YEAR"]: r["n_teachers"] for r in results["teacher_balance"].collect()}
    assert checks == got.groupby("YEAR").ID_INTERNO.nunique().to_dict()
    kept = results["teacher_retention"].first()
    assert kept["retained"] == pytest.approx(len(got) / len(panel))
    schools = expected_schools(panel)
    years = schools.groupby("CIE_ESCOLA").YEAR.nunique()
    assert {r["CIE_ESCOLA"] for r in results["school_level_bal"].collect()} == set(years[years == 3].index) == {"35000104"}


def test_school_panel(job):
    raw, results, _ = job
    want = expected_schools(expected_panel(raw)).sort_values(["YEAR", "CIE_ESCOLA"]).reset_index(drop=True)
    got = results["school_level_unb"].toPandas().sort_values(["YEAR", "CIE_ESCOLA"]).reset_index(drop=True)
    assert len(got) == len(want) > 10
    for c in want.columns:
        if want[c].dtype == object or str(want[c].dtype) == "str":
            assert list(got[c]) == list(want[c])
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, equal_nan=True, err_msg=c)


def spread(df, column, group, a, b):
    """Means of a and b and the standard error with all rows as n."""
    va, vb = df[df[group] == a][column].astype(float), df[df[group] == b][column].astype(float)
    return va.mean(), vb.mean(), math.sqrt(va.var() / len(va) + vb.var() / len(vb))


def test_teacher_table(job):
    raw, results, _ = job
    p = expected_panel(raw)
    p["Women"] = (p.SEXO == "F") * 1.0
    p["BA"] = (p.NIVEL_FORMACAO == "com ensino superior") * 1.0
    p["MA"] = p.NIVEL_FORMACAO.isin(["especialização", "mestrado", "doutorado"]) * 1.0
    got = {r["variable"]: r for r in results["teacher_table"].collect()}
    for label, column in {"Age": "IDADE", "Experience": "ANOS_ATIVIDADE", "Women": "Women", "BA degree": "BA", "MA (or other) degree": "MA", "Absence rate": "ABS_RATE"}.items():
        a, b, error = spread(p, column, "CATEG_corr", "Efetivo", "Temporário")
        r = got[label]
        assert (r["civil_servant"], r["contract"], r["diff"], r["se_diff"]) == pytest.approx((a, b, a - b, error)), label
    ill = p[p.TOT_DIAS_AUSENCIAS > 0]
    sums = ill.groupby("CATEG_corr")[[f"TT_DIAS_{m}" for m in MOTIVES]].sum()
    shares = sums.div(sums.sum(axis=1), axis=0)
    assert got["Sick leave"]["civil_servant"] == pytest.approx(shares.loc["Efetivo", "TT_DIAS_FALTA_MEDICA"])
    assert got["Personal leave"]["contract"] == pytest.approx(shares.loc["Temporário", "TT_DIAS_LIC_INTER_PARTIC"])
    assert got["N (teachers)"]["civil_servant"] == p[p.CATEG_corr == "Efetivo"].ID_INTERNO.nunique()
    assert len(got) == 14


def test_school_table(job):
    raw, results, _ = job
    s = expected_schools(expected_panel(raw))
    s["ratio"] = s.qt_mat / s.n_prof
    got = {r["variable"]: r for r in results["school_table"].collect()}
    for label, column in {"Number of teachers": "n_prof", "Pupil-teacher ratio": "ratio", "Dropout rate": "drop_mean", "INSE": "inse"}.items():
        urban, rural, error = spread(s, column, "NO_CATEGORIA", "Urbana", "Rural")
        r = got[label]
        assert (r["urban"], r["rural"], r["diff"], r["se_diff"]) == pytest.approx((urban, rural, rural - urban, error)), label
    assert got["N (schools)"]["urban"] == s[s.NO_CATEGORIA == "Urbana"].CIE_ESCOLA.nunique()
    assert len(got) == 11


def test_quality_reports(job):
    raw, results, _ = job
    for name, table in {"education_repeats": "education", "absence_repeats": "absences"}.items():
        assert results[name].count() == 4, table
    conflicts = results["active_conflicts"].toPandas()
    assert conflicts.SEXO_conflict.sum() > 0 and (conflicts.DATA_NASCIMENTO_conflict == 0).all()
    coverage = results["record_coverage"].toPandas()
    assert (coverage.both <= coverage[["education", "absence"]].min(axis=1)).all()
    schools = results["school_coverage"].toPandas()
    assert (schools.inse == schools.total_rows).all() and (schools.dropout < schools.total_rows).any()


def test_outputs_are_partitioned_by_year(job):
    _, _, root = job
    assert {p.name for p in (root / "out" / "teacher_level_unb").iterdir() if p.is_dir()} == {f"YEAR=20{y}" for y in (21, 22, 23, 24)}


def test_distinct_counts_with_missing_contracts_in_both_modes(spark, job):
    """A contract type outside the table is missing; ``count_na`` counts it as one more value, as ``unique`` does."""
    from panelweave.plans import panels

    _, results, _ = job
    teachers = results["teacher_level_unb"]
    assert teachers.where("CATEG_corr IS NULL").count() > 0
    keys = ["YEAR", "CIE_ESCOLA", "CO_MUNICIPIO", "NO_CATEGORIA"]
    missing = {tuple(r) for r in teachers.where("CATEG_corr IS NULL").select(*keys).distinct().collect()}
    plain, with_na = (
        {tuple(r[k] for k in keys): (r["n_temp"], r["n_efet"]) for r in panels.school_panel(teachers, mode).collect()}
        for mode in (False, True)
    )
    for cell, (temporary, permanent) in plain.items():
        more = int(cell in missing)
        assert with_na[cell] == (temporary + more, permanent + more)
