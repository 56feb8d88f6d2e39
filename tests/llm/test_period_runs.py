import random

import brute
import numpy as np
import pytest

from panelweave.llm import period_runs as pr


def words_of(text):
    return np.array([ord(c) for c in text], np.int64)


def shown(runs, least=pr.LEAST):
    return pr.runs_of([words_of(t) for t in runs], least)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_of_few_kinds_equal_brute_force(letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choices("abcde"[:letters], k=rng.randrange(90))) for _ in range(400)]
    for least in (2, 5, 12):
        assert shown(texts, least) == [brute.runs(t, least) for t in texts]


def test_periodic_stretches_equal_brute_force():
    rng = random.Random(3)
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            period = "".join(rng.choices("abcdefgh", k=rng.randrange(1, 15)))
            parts.append((period * 12)[: rng.randrange(1, 70)])
        texts.append("".join(parts))
    # Fibonacci and Thue-Morse words hold very many runs, and none.
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    texts += [b, "".join("ab"[bin(i).count("1") % 2] for i in range(200)), "a" * 300, "ab" * 150, "", "a"]
    assert shown(texts) == [brute.runs(t) for t in texts]


def test_same_passage_often_but_far_apart_is_no_run():
    rng = random.Random(5)
    text = "".join("".join(chr(200 + rng.randrange(5000)) for _ in range(12)) + "abcdefgh" for _ in range(500))
    assert shown([text]) == [[]]


def test_one_very_long_text():
    n = 200_000
    words = np.arange(1, n + 1)
    words[1000:150_000] = np.resize(words[1000:1007], 149_000)
    words[160_000:] = np.resize(words[160_000:170_000], 40_000)
    assert pr.runs_of([words]) == [[(1000, 149_000, 7), (160_000, 40_000, 10_000)]]
    assert pr.runs_of([np.ones(n, np.int64), words[:10]]) == [[(0, n, 1)], []]


def test_rows_of_all_kinds(spark, docs_table):
    phrase = "buy now and save big "
    rows = [(1, phrase * 5 + "end"), (1, phrase * 5 + "end"), (2, None), (3, ""), (None, "x " * 12), (4, " \t\n"), (5, "A a " * 5), (6, "é ü " * 12)]
    rows.append((7, "w" * 2_000_000 + " " + "long text " * 300_000))
    got = pr.periodic_runs(docs_table(rows), words_together=40).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by_id[1]["runs"] == [(0, 25, 5)] and by_id[1]["collapsed"] == "buy now and save big end" and by_id[1]["n_words"] == 26
    assert [(by_id[i]["n_words"], by_id[i]["runs"], by_id[i]["collapsed"]) for i in (2, 3, 4)] == [(0, [], "")] * 3
    assert by_id[None]["runs"] == [(0, 12, 1)] and by_id[None]["collapsed"] == "x"
    assert by_id[5]["runs"] == [] and by_id[5]["collapsed"] == "A a A a A a A a A a"
    assert by_id[6]["collapsed"] == "é ü"
    assert by_id[7]["runs"] == [(1, 600_000, 2)] and by_id[7]["collapsed"] == "w" * 2_000_000 + " long text"


def test_empty_table(spark, docs_table):
    assert pr.periodic_runs(docs_table([(1, "a")]).limit(0)).collect() == []
