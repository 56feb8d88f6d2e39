from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelweave.llm import token_counts as tc
from panelweave.llm.tokenizer import ByteBpe, vocabulary_path

pytest.importorskip("public_tokenizers")


@lru_cache
def bpe():
    return ByteBpe(vocabulary_path())


def whole(text):
    return len(bpe().slow.encode(text, add_special_tokens=False).ids)


PIECES = st.sampled_from(["the ", "cat", " ", "\n", "  ", "it's ", "l'été ", "42", "ß", "!!", " a b", "\t", "日本", "x\ny", "<|endoftext|>", "’s "])
TEXTS = st.lists(PIECES, max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 20))
def test_leaves_have_the_tokens_of_the_text(text, size):
    leaves = tc.cut(text, size)
    assert "".join(leaves) == text
    assert sum(map(bpe().count, leaves)) == whole(text)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(-2, 300), st.integers(-2, 300), TEXTS), max_size=5), st.integers(1, 12))
def test_edits_give_the_counts_of_the_edited_text(text, edits, size):
    before = tc.cut.__defaults__
    tc.cut.__defaults__ = (size,)
    try:
        leaves = tc.cut(text)
        held = tc.EditedText(text, [len(x) for x in leaves], [bpe().count(x) for x in leaves], bpe().count)
        for start, end, new in edits:
            held.edit(start, end, new)
            a = min(max(start, 0), len(text))
            b = min(max(end, a), len(text))
            text = text[:a] + new + text[b:]
            assert held.text == text
            assert (held.tree.chars[1], held.tree.tokens[1]) == (len(text), whole(text))
    finally:
        tc.cut.__defaults__ = before


def test_only_the_touched_region_is_encoded_again():
    text = "the quick brown fox jumps over a lazy dog " * 2000
    leaves = tc.cut(text)
    held = tc.EditedText(text, [len(x) for x in leaves], [bpe().count(x) for x in leaves], bpe().count)
    held.edit(40_000, 40_005, "slow")
    assert held.encoded_chars < 4 * tc.LEAF_CHARS
    assert held.tree.tokens[1] == whole(held.text)


def test_rows_with_edits_from_a_table(spark, docs_table):
    docs = docs_table([(1, "mail ann@example.org or call +49 30 1234567 now"), (2, None), (3, ""), (4, "plain"), (4, "plain")])
    trees = tc.build_trees(docs.select("doc_id", "text", "part"))
    edits = spark.createDataFrame([(1, 2, 0, 4, "write"), (1, 1, 5, 20, None), (2, 1, 0, 9, "new")], 'doc_id long, seq int, start int, `end` int, text string')
    got = {(r["doc_id"], r["n_edits"]): r for r in tc.apply_edits(tc.attach_edits(trees, edits)).collect()}
    assert got[1, 2]["n_tokens_edited"] == whole("write  or call +49 30 1234567 now")
    assert got[2, 1]["n_tokens_edited"] == whole("new")
    assert got[3, 0]["n_tokens"] == 0
    assert tc.apply_edits(tc.attach_edits(trees, edits)).count() == 5


def test_redactions(spark, docs_table):
    docs = docs_table([(1, "mail ann@example.org or call +49 30 1234567 now"), (2, None)])
    edited = tc.apply_edits(tc.build_trees(docs).withColumn("edits", tc.redactions(F.coalesce("text", F.lit("")))))
    got = {r["doc_id"]: r for r in edited.collect()}
    assert got[1]["n_edits"] == 2
    assert got[1]["n_tokens_edited"] == whole("mail [email] or call [number] now")
    assert got[2]["n_edits"] == 0
    assert tc.apply_edits(tc.build_trees(docs.limit(0)).withColumn("edits", tc.redactions(F.col("text")))).count() == 0
