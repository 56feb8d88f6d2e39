import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import packing
from panelweave.llm.common import Stages
from panelweave.llm.tokenizer import byte_bpe, vocabulary_path

pytest.importorskip("public_tokenizers")


def optimum(lengths, capacity):
    """Fewest bins, by trying all ways to add each length to an open bin or a new one."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, free in enumerate(bins):
            if free >= lengths[i] and free not in bins[:k]:
                place(i + 1, [*bins[:k], free - lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_packing_enclose_the_optimum(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths), 20)
    assert packing.lower_bound(np.array(lengths), 20) <= optimum(lengths, 20) <= bins.max() + 1
    used = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths):
        used[b].append((o, n))
    for placed in used.values():
        ends = list(itertools.accumulate(n for _, n in sorted(placed)))
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 20


def check(rows, capacity):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in used.values():
        ends = list(itertools.accumulate(n for _, n in sorted(placed)))
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(used)


def test_partitions_with_a_gap_exchange_pieces(spark):
    rng = np.random.default_rng(1)
    lengths = [int(n) for n in rng.integers(1, 101, 3000)]
    stages = Stages(spark, "test")
    cut = stages.write(spark.createDataFrame(list(enumerate(lengths)), "row long, length long"), "cut")
    alone = check(packing.pack_pieces(cut, stages, 100, per_partition=100, rounds=1).collect(), 100)
    rows = packing.pack_pieces(cut, stages, 100, per_partition=100).collect()
    assert sorted(r["row"] for r in rows) == list(range(3000))
    assert check(rows, 100) < alone
    assert check(rows, 100) <= 1.05 * packing.lower_bound(np.array(lengths), 100)


def test_pieces_and_sequences(spark, docs_table):
    rows = [(1, "word " * 50), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "ö <|endoftext|> é"), (5, "a b " * 9)]
    got = packing.pack(docs_table(rows), capacity=16, per_partition=4).collect()
    check(got, 16)
    slow = byte_bpe(vocabulary_path()).slow
    want = []
    for doc, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 16 or 16
        starts = [0, *range(first, len(ids), 16)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)


def test_empty_table(spark, docs_table):
    assert packing.pack(docs_table([(1, "a")]).limit(0)).collect() == []
