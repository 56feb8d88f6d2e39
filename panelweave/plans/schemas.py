"""Declared columns of the raw files; files may hold more."""

from pyspark.sql import types as T

from panelweave.plans.fixed_values import MOTIVES


def _columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


TEXT, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

ACTIVE = _columns(
    QUADRO_E=TEXT,
    ID_INTERNO=TEXT,
    UAC=TEXT,
    CATEG_E=TEXT,
    SEXO=TEXT,
    ID_COR=TEXT,
    DATA_NASCIMENTO=TEXT,
    DATA_INICIO_EXERCICIO_E=TEXT,
)

ABSENCES = _columns(
    QUADRO_EXERC=TEXT,
    ID_INTERNO=TEXT,
    UA_EXERC=TEXT,
    CIE_ESCOLA=LONG,
    **{motive: INT for motive in MOTIVES},
    TOT_DIAS_AUSENCIAS=INT,
    TOTAL_DIAS_MES=INT,
)

EDUCATION = _columns(QUADRO_E=TEXT, ID_INTERNO=TEXT, CIE_ESCOLA=LONG, UA_EXERC=TEXT, FORMACAO=TEXT)

# The rates arrive as text because unknown ones are written as dashes.
DROPOUT = _columns(
    **{
        "NU_ANO_CENSO": INT,
        "SG_UF": TEXT,
        "CO_MUNICIPIO": INT,
        "CO_ENTIDADE": LONG,
        "NO_CATEGORIA": TEXT,
        "NO_DEPENDENCIA": TEXT,
        "3_CAT_FUN": DOUBLE,
        "3_CAT_MED": DOUBLE,
    }
)

CENSUS = _columns(
    NU_ANO_CENSO=INT,
    CO_UF=INT,
    CO_ENTIDADE=LONG,
    TP_DEPENDENCIA=INT,
    QT_MAT_FUND=INT,
    QT_MAT_MED=INT,
    QT_MAT_BAS_PRETA=INT,
)

INDEX = _columns(CO_UF=INT, TP_DEPENDENCIA=INT, CO_ESCOLA=LONG, INSE_VALOR_ABSOLUTO=DOUBLE)
