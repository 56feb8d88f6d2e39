"""Quality rules as a short-circuit cascade, cheapest rejections first.

``measures`` computes the counts every document reports. ``estimate`` times each rule and counts
what it rejects on a bounded sample; ``cascade`` then nests the rules so that a document
rejected by one is never shown to the next. The order is a matter of cost only: a document is
kept when no rule rejects it, whichever comes first.

NULL and empty texts have no words and fail; a repeated row is judged like any other. Columns
named m, base_failed, rejected_by and kept give way to those made here.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import SPACE, Stages, let, split_words, whole_number

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rows the cost and selectivity of the rules are estimated on; the verdicts do not depend on it.
SAMPLE_ROWS = 2000
#: How often each rule is evaluated on the sample in one job, and in how many jobs.
REPEATS, RUNS = 20, 3
#: Seconds over the sample below which costs cannot be told apart.
TICK = 1e-4


@dataclass(frozen=True)
class Rule:
    """A named condition under which a document is rejected, over its text and its measures."""

    name: str
    rejects: Column


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Each window becomes one number, its hash times the word count plus its place, so that
    sorting numbers brings equal windows together; neighbours are then compared word by word.
    """

    def count(w: Column, n: Column, hashes: Column) -> Column:
        spread = F.floor(F.lit(float(1 << 62)) / n).cast("long")
        keyed = F.transform(
            F.slice(hashes, 1, F.greatest(n - 2, F.lit(0)).cast("int")),
            lambda x, i: F.pmod(F.xxhash64(F.slice(hashes, i + 1, 3)), spread) * n + i,
        )

        def same(a: Column, b: Column) -> Column:
            def window(x: Column) -> Column:
                return F.slice(hashes, (x % n + 1).cast("int"), 3)

            return F.coalesce((a - a % n == b - b % n) & (window(a) == window(b)), F.lit(False))

        def found(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(twice, lambda x: x % n))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(whole_number(3), F.coalesce(F.get(at, i + 1) - p, whole_number(3))))
            return F.aggregate(steps, whole_number(0), lambda a, x: a + x)

        return let(F.sort_array(keyed), lambda s: let(found(s), covered))

    many = let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda hashes: let(F.size(words).cast("long"), lambda n: count(words, n, hashes)),
    )
    return F.when(F.size(words) < 4, whole_number(0)).otherwise(many)


def _dup_lines(text: Column) -> Column:
    def repeated(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, repeated)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the column ``m``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = let(
        split_words(body, SPACE),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _dup_lines(body).alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        ),
    )
    return docs.withColumn("m", found)


def base_failed() -> Column:
    m = F.col("m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the measures and, for the dearer ones, over the text itself."""
    m, body = F.col("m"), F.coalesce(F.col(text), F.lit(""))
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(body, r"[^\p{Lu}]+", ""))
    marks = F.length(F.regexp_replace(body, r"[^!?]+", ""))
    return [
        Rule("short words", m["word_chars"] < 2 * m["n_words"]),
        Rule("long words", m["word_chars"] > 14 * m["n_words"]),
        Rule("symbols", 10 * m["n_symbols"] > m["n_words"]),
        Rule("repeated lines", m["n_dup_lines"] >= F.greatest(F.lit(3), F.expr("0.3 * (m.n_words / 20)"))),
        Rule("few letters", 2 * letters < m["word_chars"]),
        Rule("shouting", 2 * capitals > letters),
        Rule("exclamations", 4 * marks > m["n_words"]),
    ]


def _seconds(sample: DataFrame, rejects: Column, repeats: int) -> float:
    """Wall time of one job that evaluates a condition ``repeats`` times on every row."""
    again = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    began = time.perf_counter()
    again.agg(F.count_if(rejects & (F.col("__again") > 0))).first()
    return time.perf_counter() - began


def estimate(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS, repeats: int = REPEATS, runs: int = RUNS) -> list[tuple[Rule, float, float]]:
    """Each rule with its share of rejections and its seconds on about ``rows`` sampled documents.

    A rule is evaluated ``repeats`` times on every row of the sample within one job, so that starting the job counts
    for little; a rule that looks at nothing is timed beside it and taken off. Of several
    such runs, one of each rule after the other, the least counts.
    """
    stages = Stages(docs.sparkSession, "rule-sample")
    share = min(1.0, rows / max(docs.count(), 1))
    # Rows of all parts of the table; about as many as wanted.
    sample = stages.write(measures(docs.sample(fraction=share, seed=11)), "sample")
    hits = sample.agg(F.count("*").alias("n"), *[F.count_if(r.rejects).alias(f"hits{i}") for i, r in enumerate(rules)]).first()
    nothing = F.col("m").isNull()
    timed = [[_seconds(sample, c, repeats) for c in (nothing, *[r.rejects for r in rules])] for _ in range(runs)]
    least = [min(run[k] for run in timed) for k in range(len(rules) + 1)]
    stages.drop(sample)
    return [(r, hits[f"hits{i}"] / max(hits["n"], 1), max(least[i + 1] - least[0], 0.0) / repeats) for i, r in enumerate(rules)]


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejections per second, the best first; ties keep the order given."""
    return [rule for rule, _, _ in sorted(estimates, key=lambda e: -e[1] / max(e[2], TICK))]


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed``, ``rejected_by`` (NULL where kept) and ``kept``; a later rule runs only where none before rejected."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measure, order and cascade: the rows of ``docs`` with ``m``, ``base_failed``, ``rejected_by``, ``kept``."""
    rules = default_rules() if rules is None else rules
    return cascade(measures(docs), ordered(estimate(docs, rules, sample_rows)))
