import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.sources import read_period_files
from panelweave.sources.quoted_lines import quoted_records

SCHEMA = T.StructType([T.StructField("ID", T.StringType()), T.StructField("NOTE", T.StringType()), T.StructField("N", T.IntegerType())])


@pytest.fixture
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(n, seed, alphabet):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 3, 20, 20, 200]) if i != n // 2 else 20_000  # one record goes over several blocks
        rows.append([f"id{i}", "".join(rng.choices(alphabet, k=size)).strip(), str(i)])
    return rows


def told(rows, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([["id", "note", "n"], *rows])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_read_by_many_tasks_are_those_written(spark, small_blocks, tmp_path, end):
    want = []
    for k in range(3):
        rows = rows_of(300, k, 'ab é,"\n')
        (tmp_path / f"f_0{k + 1}21.csv").write_text(told([[i, n.replace("\n", end), v] for i, n, v in rows], end), encoding="utf-8", newline="")
        want += [(f"0{k + 1}21", i, n, int(v)) for i, n, v in rows]
    table = read_period_files(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert table.rdd.getNumPartitions() > 10
    assert sorted(tuple(r) for r in table.select("DATE", "ID", "NOTE", "N").collect()) == sorted(want)


def test_rows_equal_those_of_a_read_by_one_task(spark, small_blocks, tmp_path):
    rows = rows_of(400, 9, 'ab ,"\n')
    (tmp_path / "f_0121.csv").write_text(told(rows, "\n"), encoding="utf-8")
    whole = spark.read.csv(str(tmp_path), header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    one = sorted((r["id"], r["note"] or "") for r in whole.collect())
    assert sorted((r["ID"], r["NOTE"]) for r in read_period_files(spark, str(tmp_path), SCHEMA, multi_line=True).collect()) == one


def test_preamble_blank_lines_encodings_and_compressed_files(spark, small_blocks, tmp_path):
    text = 'Title\n\n"a, b"\nid,note,n\n\nx,"é\n\n\nü",1\n\ny,"",2\n' + "".join(f'z{i},"q\n""{i}""",{i}\n' for i in range(500))
    want = [("x", "é\n\n\nü", 1), ("y", "", 2), *[(f"z{i}", f'q\n"{i}"', i) for i in range(500)]]
    for name, encoding in (("utf", "UTF-8"), ("latin", "ISO-8859-1"), ("wide", "UTF-16")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_bytes(text.encode(encoding))
        if name == "wide":
            continue  # its line feeds are two bytes
        got = read_period_files(spark, str(tmp_path / name), SCHEMA, skip=3, stamp=False, multi_line=True, encoding=encoding)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "f.csv.gz").write_bytes(gzip.compress(text.encode()))
    got = read_period_files(spark, str(tmp_path / "gz"), SCHEMA, pattern="*.gz", skip=3, stamp=False, multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_an_open_quote_is_refused_with_its_file(spark, small_blocks, tmp_path):
    body = "".join(f'a{i},"b\nc",{i}\n' for i in range(600))
    (tmp_path / "good.csv").write_text("id,note,n\n" + body)
    (tmp_path / "open_quote.csv").write_text("id,note,n\n" + body + 'x,"never closed,1\n' + body)
    with pytest.raises(ValueError, match="open quote in .*open_quote"):
        read_period_files(spark, str(tmp_path), SCHEMA, multi_line=True)


def test_no_pieces_where_no_record_crosses_a_block(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,note,n\n" + "".join(f'a{i},"b\nc",{i}\n' for i in range(50)))
    paths = [r["path"] for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    named = {r["p"]: 1 for r in spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("p")).distinct().collect()}
    found = quoted_records(spark, paths, named, "UTF-8")
    assert "Window" not in found._jdf.queryExecution().toString()
    assert found.count() == 50
