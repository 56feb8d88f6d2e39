"""Secret scans: known patterns, and strings that pass a battery of randomness tests.

``base_spans`` finds assignments, access keys and hex strings by pattern. ``random_spans`` takes
every run of 20 or more characters of base64, of base64url and of letters and digits alone, infers its
encoding, and tests it against uniform random symbols of that alphabet: a chi-squared test of the
symbol counts, a runs test about the middle of the alphabet, and the serial correlation of
neighbours. The three p-values combine by Bonferroni's rule into one. Of runs that overlap and are
taken, the one of the most evidence stays, so that a key behind a path or a prefix is found as such.

Any run of few symbols can look random, so a span counts only where the error is under control.
The tests reject what is regular (p under ``REGULAR``); for the rest, the probability of the run under
uniform symbols, divided by that under a fixed model of word-like text (words, names, slugs,
paths, dates and counters), is its evidence. The mean of that ratio over word-like text is one, so
its inverse is a p-value, and Benjamini and Hochberg's rule over all candidates holds the false
discoveries at ``error`` however the runs depend on each other. The model does not come from
the rows, so one key in a small text can be found. Counts cover all rows; they are held by tenth
of the evidence's decimal logarithm.

Spans count code points, the end left out. NULL and empty texts have no spans; repeated rows
each get the spans of their text.
"""

from __future__ import annotations

from functools import cache
from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import let, matches

#: Fixed patterns of the three base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_SECRET = 6

RUN = r"[A-Za-z0-9+/_-]{20,}"
#: What is tested of a run: its longest parts in one alphabet, and those between any marks.
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
#: Alphabets from narrow to wide; the first that holds every symbol is the encoding.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
ERROR = 0.05
#: A run that the battery finds less probable than this among uniform symbols is regular.
REGULAR = 0.001
#: Tenths of the evidence's decimal logarithm that are told apart.
LEVELS = 600

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Word-like text: letters in a thousand (European languages together), and what kind of symbol follows which.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (75, 16, 30, 42, 120, 16, 20, 35, 73, 8, 18, 43, 27, 72, 60, 22, 5, 64, 62, 62, 46, 14, 18, 4, 18, 18)))
FOLLOWS = {
    "vowel": {"vowel": 0.16, "consonant": 0.72, "digit": 0.04, "mark": 0.08},
    "consonant": {"vowel": 0.52, "consonant": 0.36, "digit": 0.04, "mark": 0.08},
    "digit": {"vowel": 0.05, "consonant": 0.10, "digit": 0.70, "mark": 0.15},
    "mark": {"vowel": 0.25, "consonant": 0.50, "digit": 0.15, "mark": 0.10},
}
MARKS = {"+": 0.05, "/": 0.25, "-": 0.35, "_": 0.35}
#: Share of uniform symbols in word-like text.
STRAY = 0.05


def _kind(symbol: str) -> str:
    if symbol in MARKS:
        return "mark"
    return "digit" if symbol.isdigit() else "vowel" if symbol.lower() in "aeiouy" else "consonant"


def _word_like(before: str, symbol: str) -> float:
    """Probability of a symbol after another in word-like text."""
    kind = _kind(symbol)
    share = FOLLOWS[_kind(before)][kind]
    if kind == "mark":
        return share * (0.7 * (symbol == before) + 0.3 / len(MARKS) if before in MARKS else MARKS[symbol])
    if kind == "digit":
        # Zeros and repeated or counted digits within numbers, years and small numbers at their start.
        usual = 0.3 * (symbol == before) + 0.2 * (int(symbol) == (int(before) + 1) % 10) if before.isdigit() else 0.25 * (symbol in "12")
        return share * (0.035 + 0.15 * (symbol == "0") + usual)
    upper = 0.05 if before.islower() else 0.75 if before.isupper() else 0.35
    return share * LETTERS[symbol.lower()] / sum(w for c, w in LETTERS.items() if _kind(c) == kind) * (upper if symbol.isupper() else 1 - upper)


@cache
def _word_table() -> str:
    """Decimal logarithms of the probabilities of all pairs of symbols, row by row of the first."""
    return " ".join(f"{log10((1 - STRAY) * _word_like(x, y) + STRAY / len(SYMBOLS)):.4f}" for x in SYMBOLS for y in SYMBOLS)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            (m["start"] + F.char_length(m["match"])).alias("end"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Sorted array of (start, rank of the kind, end) of the three base kinds."""
    long_enough = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 1)) >= MIN_SECRET)
    return F.sort_array(
        F.concat(_spans(long_enough, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex"))
    )


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _upper_tail(z: Column) -> Column:
    """Normal upper tail for any z, by the logistic form of Bowling and others; within 0.0002."""
    return 1 / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))


def p_value(symbols: Column, size: Column) -> Column:
    """Least of the three tests' p-values times three, for an array of places in an alphabet of ``size`` symbols."""

    def battery(x: Column, n: Column) -> Column:
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(x, lambda y: y == s)), F.lit(2.0)))
        chi = size * squares / n - n
        uniform = _upper_tail((chi - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n))

        high = F.transform(x, lambda y: (2 * y >= size).cast("int"))
        ups = F.aggregate(high, F.lit(0), lambda a, y: a + y).cast("double")
        turns = F.aggregate(F.transform(high, lambda y, i: F.coalesce((y != F.get(high, i - 1)).cast("int"), F.lit(1))), F.lit(0), lambda a, y: a + y)
        product = 2 * ups * (n - ups)
        spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = 2 * _upper_tail(F.abs(turns - (product / n + 1)) / spread)

        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
        power = F.aggregate(x, F.lit(0.0), lambda a, y: a + F.pow(y - mean, F.lit(2.0)))
        lag = F.aggregate(F.transform(x, lambda y, i: F.coalesce((y - mean) * (F.get(x, i - 1) - mean), F.lit(0.0))), F.lit(0.0), lambda a, y: a + y)
        serial = 2 * _upper_tail(F.abs(lag / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    return let(symbols, lambda x: let(F.size(x).cast("double"), lambda n: battery(x, n)))


def evidence(run: Column, size: Column) -> Column:
    """Decimal logarithm of how much more probable a run is under ``size`` uniform symbols than in word-like text; the choice of alphabet is allowed for."""
    table = F.split(F.lit(_word_table()), " ").cast("array<double>")

    def word_like(x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(x, i - 1), F.lit(SYMBOLS.index("-")))
        each = F.transform(x, lambda y, i: F.get(table, before(i) * len(SYMBOLS) + y))
        return F.aggregate(each, F.lit(0.0), lambda a, y: a + y)

    places = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(SYMBOLS)) - 1)
    return -F.char_length(run) * F.log10(size) - let(places, word_like) - log10(len(ALPHABETS))


def candidates(docs: DataFrame) -> DataFrame:
    """Every long part of a run of ``docs`` (doc_id, text_hash): the run's place, start, end, encoding, p, and evidence, 0 where the part is regular."""
    runs = docs.select("doc_id", "text_hash", F.explode(matches(F.col("text"), RUN)).alias("whole"))
    parts = F.array_distinct(F.concat(*[matches(F.col("whole.match"), part) for part in PARTS]))
    found = runs.select("doc_id", "text_hash", F.col("whole.start").alias("run"), F.explode(parts).alias("m"))
    run = F.col("m.match")
    encoding, alphabet = F.lit(ALPHABETS[-1][0]), F.lit(ALPHABETS[-1][1])
    for name, symbols in reversed(ALPHABETS[:-1]):
        only = run.rlike(f"^[{symbols}]+$")
        encoding, alphabet = F.when(only, F.lit(name)).otherwise(encoding), F.when(only, F.lit(symbols)).otherwise(alphabet)
    start = F.col("run") + F.col("m.start")
    found = found.select(
        "doc_id", "text_hash", "run", start.alias("start"), (start + F.char_length(run)).alias("end"), run.alias("match"), encoding.alias("encoding"), alphabet.alias("alphabet")
    )
    places = F.transform(F.split("match", ""), lambda c: F.position(c, F.col("alphabet")) - 1)
    size = F.char_length("alphabet").cast("double")
    known = found.withColumn("p", p_value(places, size))
    likely = F.when(F.col("p") >= REGULAR, F.greatest(evidence(F.col("match"), size), F.lit(0.0))).otherwise(F.lit(0.0))
    return known.withColumn("evidence", likely).drop("match", "alphabet")


def _level() -> Column:
    return F.least(F.lit(LEVELS), F.floor(F.col("evidence") * 10)).cast("int")


def threshold(found: DataFrame, error: float = ERROR) -> DataFrame:
    """The least level of evidence from which on runs are taken as random, in one row; none without such a level."""
    counts = found.groupBy(_level().alias("level")).agg(F.count("*").alias("n"))
    # At most LEVELS rows, whatever the input.
    bins = counts.agg(F.collect_list(F.struct("level", "n")).alias("bins"))

    def total(bins: Column) -> Column:
        return F.aggregate(bins, F.lit(0).cast("long"), lambda a, b: a + b["n"])

    def holds(t: Column) -> Column:
        passing = total(F.filter("bins", lambda b: b["level"] >= t))
        return (passing > 0) & (passing * F.pow(F.lit(10.0), t / 10) * error >= total(F.col("bins")))

    cut = F.get(F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), holds), F.lit(0))
    return bins.select(cut.alias("cut")).where(F.col("cut").isNotNull())


def random_spans(docs: DataFrame, error: float = ERROR) -> DataFrame:
    """Documents (doc_id, text_hash) with ``found``, the (start, rank, end) of runs taken as random."""
    found = candidates(docs)
    taken = found.crossJoin(threshold(found, error)).where(_level() >= F.col("cut"))
    parts = F.sort_array(F.collect_set(F.struct("evidence", "start", "end")), asc=False)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def step(a: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), s["end"].alias("end"))
        return F.when(F.exists(a, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), a).otherwise(F.concat(a, F.array(span)))

    apart = taken.groupBy("doc_id", "text_hash", "run").agg(F.aggregate(parts, none, step).alias("spans"))
    return apart.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("found"))


def scan(docs: DataFrame, error: float = ERROR) -> DataFrame:
    """Every row of ``docs`` with ``base``, its base spans, and ``spans``, those and the random ones that overlap none of them.

    Columns of these names give way.
    """
    docs = docs.drop("base", "spans")
    keyed = docs.withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    more = random_spans(keyed.select("doc_id", F.col("__hash").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text")), error)
    more = more.withColumnsRenamed({"doc_id": "__id", "text_hash": "__found_hash", "found": "__found"})
    same = keyed["doc_id"].eqNullSafe(more["__id"]) & (keyed["__hash"] == more["__found_hash"])
    found = keyed.join(more, same, "left").withColumn("base", base_spans(F.coalesce("text", F.lit(""))))
    fresh = F.filter(
        F.coalesce("__found", F.array().cast("array<struct<start:int,rank:int,end:int>>")),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    spans = F.sort_array(F.concat("base", fresh))
    return found.withColumn("spans", spans).drop("__hash", "__id", "__found_hash", "__found")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by ``mask``; spans must be sorted."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    end = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def mask_secrets(docs: DataFrame, mask: str = "[secret]", error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` with every span of their text masked; texts without any stay as they are."""
    found = scan(docs, error)
    clean = found.withColumn("text", masked(F.col("text"), F.col("spans"), mask)).drop("base", "spans")
    return clean.select(*[c for c in docs.columns if c in clean.columns])
