import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import vector_codes as vc


def table(spark, rows, kind="double"):
    made = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    # Names that the operator uses itself.
    for name in ("vector", "whole", "code", "error", "part", "entry"):
        made = made.withColumn(name, F.lit("own"))
    return made


def coded(spark, rows, kind="double", **settings):
    found = vc.vector_codes(table(spark, rows, kind), **settings)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(300, 8, 1)
    random.Random(2).shuffle(rows)
    assert coded(spark, rows) == sorted(brute.vector_codes(rows), key=str)


def test_few_entries_and_many_ties(spark):
    rng = random.Random(4)
    rows = [(1000 - i, [rng.randrange(3) / 1024 for _ in range(8)], i % 3) for i in range(120)]
    got = coded(spark, rows, entries=7, rounds=2)
    assert got == sorted(brute.vector_codes(rows, entries=7, rounds=2), key=str)
    assert got == sorted((tuple(r) for r in vc.vector_codes(table(spark, rows).repartition(9), entries=7, rounds=2).collect()), key=str)


def test_numbers_of_several_limbs(spark):
    rows = vectors(40, 8, 6, spread=2.0**17)  # 2 ** 27 and more times another: beyond 2 ** 53
    assert coded(spark, rows, entries=10) == sorted(brute.vector_codes(rows, entries=10), key=str)


def test_rows_without_a_whole_vector_are_dropped(spark):
    good = [(1, [-0.5, 0.25, 1.0, 2.0], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (1, [-0.5, 0.25, 1.0, 2.0], None), (-3, [1e-9, -1e-9, 0.0, -0.0], 1)]
    bad = [(5, None, 1), (6, [1.0, None, 0.0, 0.0], 1), (7, [math.nan, 0.0, 0.0, 0.0], 1), (8, [math.inf, 0.0, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0, -math.inf], 2)]
    assert coded(spark, good + bad) == sorted(brute.vector_codes(good), key=str)
    assert coded(spark, bad) == []
    assert coded(spark, []) == []


def test_unfit_vectors_are_refused(spark):
    for rows in ([(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e12] * 4, 1), (2, [-1e12] * 4, 1)]):
        with pytest.raises(Exception, match="equal parts|different lengths|too large"):
            coded(spark, rows)


def test_limbs_give_exact_dots():
    rng = np.random.default_rng(8)
    for top in (1 << 10, 1 << 27, 1 << 29):
        x, c = rng.integers(-top, top, (50, 16)), rng.integers(-top, top, (20, 16))
        x[0], c[0] = top, -top
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c] for r in x]
        assert vc.exact_dots(x, c).tolist() == want
    assert vc.limb_bits(16) == 24 and len(vc.limbs(np.array([-1, 0, (1 << 50) + 5]), 24)) == 3
    # The first of equal distances wins.
    at, far = vc.nearest(np.zeros((3, 2), np.int64), np.array([[1, 0], [0, 1], [0, -1]]))
    assert at.tolist() == [0, 0, 0] and far.tolist() == [1, 1, 1]
