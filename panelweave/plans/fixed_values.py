"""Fixed values of the school-staff panel: names and codes the data and results must carry."""

# Folders of the raw data.
ACTIVE_DIR = "active-civil-servants"
ABSENCE_DIR = "absences"
EDUCATION_DIR = "teacher-education"
DROPOUT_DIR = "dropout"
CENSUS_DIR = "censo"
INDEX_DIR = "inse"

# Row filters.
TEACHER_STAFF = "QM"
TEACHER_STAFF_ON_DUTY = ["QM-DOCENTE", "QM-SUPORTE"]
STATE_ABBREVIATION = "SP"
STATE_CODE = 35
STATE_RUN = 2
PRIVATE = "Privada"

# Lines above the header of the dropout files.
DROPOUT_PREAMBLE = 8

# School codes: total width, and the state prefix that overwrites the first two digits.
SCHOOL_CODE_WIDTH = 8
SCHOOL_CODE_PREFIX = "35"

# Race codes: blank and D carry no information, N counts as P.
RACE_RULES = [(["", "D"], "S/INFO"), (["N"], "P")]

# Contract codes.
PERMANENT = "Efetivo"
STABLE = "Estável"
TEMPORARY = "Temporário"
NOT_INFORMED = "NI"
CONTRACT_RULES = [
    (["A"], PERMANENT),
    (["P", "F", "N"], STABLE),
    (["O"], TEMPORARY),
    (["D", "C"], NOT_INFORMED),
]

# Education levels, lowest first, and the level of each credential.
NO_EDUCATION = "S/INFO"
NO_DEGREE = "sem ensino superior"
DEGREE = "com ensino superior"
SPECIALISATION = "especialização"
MASTERS = "mestrado"
DOCTORATE = "doutorado"
EDUCATION_LEVELS = [NO_DEGREE, DEGREE, SPECIALISATION, MASTERS, DOCTORATE]
CREDENTIAL_LEVEL = {
    "ENSINO MÉDIO": NO_DEGREE,
    "ENSINO MÉDIO-TÉCNICO": NO_DEGREE,
    "APERF/EXTENSÃO CULTURAL": NO_DEGREE,
    "LICENCIATURA-CURTA": DEGREE,
    "LICENCIATURA-PLENA": DEGREE,
    "BACHARELADO/TECNÓLOGO": DEGREE,
    "ESPECIALIZAÇÃO": SPECIALISATION,
    "MESTRADO": MASTERS,
    "DOUTORADO": DOCTORATE,
}
CREDENTIALS_KEPT = 5

# Absence motives: column and report label.
MOTIVES = {
    "TT_DIAS_FALTA_MEDICA": "Sick leave",
    "TT_DIAS_FALTA_JUST": "Justified absences",
    "TT_DIAS_FALTA_INJUST": "Unjustified absences",
    "TT_DIAS_LIC_PREMIO": "Seniority leave",
    "TT_DIAS_LIC_GESTANTE": "Maternity leave",
    "TT_DIAS_LIC_ACID_TRAB": "Accident leave",
    "TT_DIAS_LIC_INTER_PARTIC": "Personal leave",
}

# Absence columns zero-filled for teachers without an absence record (matched without case).
ZERO_FILLED = "^(TT|TOT)"

# A month counts as long absence from this many days on; the yearly mean divides by a year's days.
LONG_ABSENCE_DAYS = 10
DAYS_PER_YEAR = 365

# Years a school must be present in to stay in the balanced panel.
SCHOOL_PANEL_YEARS = 3

# School locations.
URBAN = "Urbana"
RURAL = "Rural"

# Report sections and row labels.
GENERAL = "General Characteristics"
TRAINING = "Education and Training"
ABSENCES = "Absences"
TEACHER_TRAITS = "Teacher Characteristics"
SCHOOL_TRAITS = "School Characteristics"
AGE = "Age"
EXPERIENCE = "Experience"
WOMEN = "Women"
BA_DEGREE = "BA degree"
MA_DEGREE = "MA (or other) degree"
ABSENCE_RATE = "Absence rate"
TEACHERS_COUNTED = "N (teachers)"
STAFF_SIZE = "Number of teachers"
CONTRACT_SHARE = "Contract teachers"
LONG_ABSENCE_SHARE = "Proportion of teachers with more than 10 days of absence in a month"
PUPILS = "Number of students"
PUPILS_PER_TEACHER = "Pupil-teacher ratio"
DROPOUT_RATE = "Dropout rate"
SOCIAL_INDEX = "INSE"
SCHOOLS_COUNTED = "N (schools)"

# Education labels and contract codes, as the raw files write them, that stand in for order priorities
# (by their first digit) where a query derives staff tables from orders.
STAND_IN_LABELS = {
    "1": "LICENCIATURA-PLENA + MESTRADO",
    "2": "ENSINO MÉDIO",
    "3": "BACHARELADO/TECNÓLOGO+ESPECIALIZAÇÃO",
    "4": "S/INFO",
    "5": "CURSO LIVRE+DOUTORADO",
}
STAND_IN_CONTRACTS = {"1": "A", "2": "O", "3": "O", "4": "P"}
