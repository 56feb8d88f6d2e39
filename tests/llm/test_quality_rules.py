import random

import brute
from pyspark.sql import functions as F

from panelweave.llm import quality_rules as qr

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def texts():
    random.seed(5)
    vocabulary = "a b c dd é ## the".split()
    out = [" ".join(random.choices(vocabulary, k=random.randint(0, 120))) for _ in range(60)]
    out += [None, "", " \t\n", "one", "a b c", "a b c a b c", "a a a", "a a a a", "l1\nl1\n \nl2\nl1", "x\x0by\x1cz w v", "\n".join(["same line here"] * 40)]
    return out


def test_measures_equal_brute_force(spark, docs_table):
    rows = list(enumerate(texts()))
    got = qr.measures(docs_table(rows).drop("m")).select("doc_id", *[F.col("m")[n] for n in NAMES], qr.base_failed()).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.quality(rows))


def test_verdict_does_not_depend_on_the_order(spark, docs_table):
    docs = qr.measures(docs_table(list(enumerate(texts()))))
    rules = qr.default_rules()
    verdicts = [{r["doc_id"]: r["kept"] for r in qr.cascade(docs, order).collect()} for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]


def test_cheap_rejections_come_first():
    slow, fast, idle = (qr.Rule(n, None) for n in ("slow", "fast", "idle"))
    assert qr.ordered([(slow, 0.5, 1.0), (idle, 0.0, 0.1), (fast, 0.3, 0.1)]) == [fast, slow, idle]


def test_later_rules_do_not_see_rejected_documents(spark, docs_table):
    docs = qr.measures(docs_table([(1, "word"), (2, " ".join(f"w{i}" for i in range(60)))]))
    failing = F.raise_error(F.lit("was shown")).cast("boolean")
    rules = [qr.Rule("all", F.lit(True)), qr.Rule("never reached", failing)]
    assert {r["doc_id"]: r["rejected_by"] for r in qr.cascade(docs, rules).collect()} == {1: "base", 2: "all"}


def test_estimate_orders_by_measured_rejections(spark, docs_table):
    prose = " ".join(f"word{i}" for i in range(60))
    docs = docs_table([(i, prose if i % 2 else prose + " ###" * 20) for i in range(40)]).select("doc_id", "text")
    found = {rule.name: share for rule, share, _ in qr.estimate(docs, qr.default_rules())}
    assert found["symbols"] > 0.2 and found["short words"] == 0
    kept = {r["doc_id"]: r["kept"] for r in qr.apply_rules(docs).collect()}
    assert all(kept[i] == bool(i % 2) for i in kept)


def test_empty_table_and_repeated_rows(spark, docs_table):
    docs = docs_table([(1, None), (1, None)]).select("doc_id", "text")
    assert qr.apply_rules(docs.limit(0)).collect() == []
    assert [r["kept"] for r in qr.apply_rules(docs).collect()] == [False, False]


def test_a_dear_rule_is_measured_as_dearer_and_goes_last(spark, docs_table):
    prose = " ".join(f"word{i}" for i in range(300))
    docs = docs_table([(i, prose + (" ###" if i % 2 else "")) for i in range(60)]).select("doc_id", "text")
    body = F.col("text")
    dear = F.length(F.regexp_replace(F.repeat(body, F.lit(10)), r"[^\\p{L}]+", "")) < 100_000
    rules = [qr.Rule("dear", dear), qr.Rule("cheap", F.col("m")["n_symbols"] > 0), qr.Rule("middling", F.length(F.regexp_replace(body, "[^#]+", "")) > 0)]
    for _ in range(3):
        found = {rule.name: (share, cost) for rule, share, cost in qr.estimate(docs, rules)}
        assert found["dear"][0] == 1.0 and found["cheap"][0] == 0.5
        assert found["dear"][1] > 2 * found["middling"][1] and found["dear"][1] > 2 * found["cheap"][1]
        assert [r.name for r in qr.ordered([(r, *found[r.name]) for r in rules])][0] == "cheap"


def test_a_very_long_text(spark, docs_table):
    rows = [(1, "same words again " * 100_000), (2, " ".join(f"w{i}" for i in range(200_000))), (3, "x" * 3_000_000)]
    got = qr.measures(docs_table(rows).drop("m")).select("doc_id", *[F.col("m")[n] for n in NAMES], qr.base_failed()).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.quality(rows))
