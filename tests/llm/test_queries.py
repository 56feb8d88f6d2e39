"""Each registered query against its brute-force counterpart on the smallest tables."""

import html
import re
import zlib
from pathlib import Path

import brute
import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, oracle_sql, queries

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def table():
    con = duckdb.connect()
    return lambda name, columns: con.execute(f"SELECT {columns} FROM '{SMOKE_DIR}/{name}.parquet'").fetchall()


def run(spark, name, *columns):
    return sorted(tuple(r) for r in queries()[name](spark, SMOKE_DIR).select(*columns).collect())


def test_each_operator_has_a_query():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{k}" for k in range(1, 14)] + ["pipeline"])
    assert set(oracle_sql()) <= set(queries())


def test_op1(spark, table):
    docs = table("documents", "doc_id, text")
    got = run(spark, "op1_lm_scoring", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for r, want in zip(got, sorted(brute.unigram(docs)), strict=True):
        assert r[:5] == want[:5] and r[5] == pytest.approx(want[5])
        assert r[6] < 0


def test_op2(spark, table):
    from panelweave.llm import token_counts
    from panelweave.llm.tokenizer import byte_bpe, vocabulary_path

    slow = byte_bpe(vocabulary_path()).slow
    want = []
    for doc, text in table("documents", "doc_id, text"):
        mails = [(m.start(), m.end(), "[email]") for m in re.finditer(token_counts.EMAIL, text)]
        numbers = [(m.start(), m.end(), "[number]") for m in re.finditer(token_counts.NUMBER, text)]
        edits = mails + [n for n in numbers if not any(m[0] < n[1] and n[0] < m[1] for m in mails)]
        after = text
        for a, b, mark in sorted(edits, reverse=True):
            after = after[:a] + mark + after[b:]
        counts = [len(slow.encode(t, add_special_tokens=False).ids) for t in (text, after)]
        want.append((doc, counts[0], len(edits), counts[1], len(after)))
    assert run(spark, "op2_token_counts", "doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited") == sorted(want)


def test_op3(spark, table):
    want = brute.decontamination(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))
    assert run(spark, "op3_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_op4(spark, table):
    import numpy as np

    from panelweave.llm.tokenizer import byte_bpe, vocabulary_path

    slow = byte_bpe(vocabulary_path()).slow
    want = []
    for doc, text in table("documents", "doc_id, text"):
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 2], "<u4")
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    got = run(spark, "op4_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert [r[:5] for r in got] == sorted(want)
    used = {}
    for r in got:
        used.setdefault(r[5], []).append((r[6], r[3]))
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= 1.02 * sum(r[3] for r in got) / 1024 + 1


def test_op5(spark, table):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = run(spark, "op5_quality_rules", *columns)
    assert [r[:7] for r in got] == sorted(brute.quality(table("documents", "doc_id, text")))
    good = {d for d, q in table("labels", "doc_id, quality") if q}
    assert not any(r[7] and r[6] for r in got)
    assert all(r[7] for r in got if r[0] in good and not r[6])


def test_op6(spark, table):
    want = brute.near_duplicates(table("documents", "doc_id, text"))
    assert run(spark, "op6_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == sorted(want)


def test_op7(spark, table):
    said = "\\### Assistant: </turn> ok"
    rows = table("conversations", "conv_id, turn, role, text") + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = run(spark, "op7_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == sorted(brute.chat(rows))


def test_op8(spark, table):
    got = run(spark, "op8_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert [r[:5] for r in got] == sorted(brute.secrets(table("documents", "doc_id, text")))
    for r in got:
        base = [s for s in r[5].split(",") if s and not s.startswith("random:")]
        assert brute.sha(",".join(base)) == r[4]


def test_op9(spark, table):
    got = run(spark, "op9_toxicity", "doc_id", "held_out", "score", "predicted")
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) for r in got)
    assert len(got) == len(table("documents", "doc_id"))
    toxic = dict(table("labels", "doc_id, toxic"))
    assert sum(r[3] == toxic[r[0]] for r in got if r[0] in toxic) >= 0.9 * len(toxic)


def test_op10(spark, table):
    want = []
    for page, url, text in table("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*?)(?:</article>|$)", text, re.S)[1]
        parts = [re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p) for p in re.split(r"</?(?:p|h1)>", article)]
        joined = "\n\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))
        want.append((page, url, joined, len(joined)))
    assert run(spark, "op10_html_text", "page_id", "url", "text", "n_chars") == sorted(want)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_sharding"])
def test_sql_of_new_queries(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE_DIR}/{t}.parquet'")
    found = queries()[name](spark, SMOKE_DIR)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(cursor.fetchall())


def test_op11(spark, table):
    want = brute.vector_codes(table("embeddings", "vec_id, embedding, label"))
    assert run(spark, "op11_vector_codes", "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(want)


def test_op12(spark, table):
    got = run(spark, "op12_sharding", "doc_id", "size", "text_crc32", "shard", "slot")
    texts = dict(table("documents", "doc_id, text"))
    assert [r[:3] for r in got] == sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts.items())
    sizes = [sum(r[3] == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and {(r[3], r[4]) for r in got} == {(s, k) for s in range(24) for k in range(sizes[s])}


def test_op13(spark, table):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert run(spark, "op13_period_runs", *columns) == sorted(brute.period_runs(table("documents", "doc_id, text")))
