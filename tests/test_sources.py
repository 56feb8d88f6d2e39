import gzip
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.sources import (
    list_files,
    load_panel,
    read_period_files,
    reused,
    save_panel,
    save_report,
    stage_folder,
    staged,
)

SCHEMA = T.StructType(
    [
        T.StructField("ID", T.StringType()),
        T.StructField("KIND", T.StringType()),
        T.StructField("N", T.IntegerType()),
        T.StructField("CODE", T.LongType()),
        T.StructField("RATE", T.DoubleType()),
    ]
)


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def test_columns_bind_by_name_not_position(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", "id,kind,n,code,rate\na,x,1,10,0.5\n")
    write(tmp_path / "f_0221.csv", "rate,code,extra,kind,ID,N\n0.25,20,zzz,y,b,2\n")
    write(tmp_path / "f_0321.csv", "ID,KIND\nc,z\n")
    write(tmp_path / "skipped.txt", "ID,KIND\nd,z\n")
    write(tmp_path / "deep" / "f_0421.csv", "ID,KIND\ne,z\n")
    out = read_period_files(spark, str(tmp_path), SCHEMA)
    assert out.columns == ["DATE", "YEAR", "ID", "KIND", "N", "CODE", "RATE"]
    assert collect(out) == [
        ("0121", 2021, "a", "x", 1, 10, 0.5),
        ("0221", 2021, "b", "y", 2, 20, 0.25),
        ("0321", 2021, "c", "z", None, None, None),
    ]
    deep = read_period_files(spark, str(tmp_path), SCHEMA, recursive=True)
    assert {r["ID"] for r in deep.collect()} == {"a", "b", "c", "e"}
    assert list_files(spark, str(tmp_path), "*.csv", recursive=True).count() == 4


def test_blank_is_text_and_na_is_missing(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", 'ID,KIND,N\na,,\nb,"",--\nc,NA,NA\nd, pad ,3.0\n')
    out = read_period_files(spark, str(tmp_path), SCHEMA)
    assert collect(out, "ID", "KIND", "N") == [("a", "", None), ("b", "", None), ("c", None, None), ("d", "pad", 3)]


def test_file_without_period_and_code_written_as_double(spark, collect, tmp_path):
    write(tmp_path / "names.csv", "ID;CODE;RATE\na;3.5000012E7;--\nb;12345;NaN\n")
    out = read_period_files(spark, str(tmp_path), SCHEMA)
    assert collect(out, "DATE", "YEAR", "ID", "CODE", "RATE") == [(None, None, "a", 35000012, None), (None, None, "b", 12345, None)]


def test_encoding_quotes_byte_order_mark_and_compression(spark, collect, tmp_path):
    write(tmp_path / "a" / "f_0121.csv", 'ID,KIND\na,"MÉDIO, x"\n', "latin-1")
    out = read_period_files(spark, str(tmp_path / "a"), SCHEMA, encoding="ISO-8859-1", stamp=False)
    assert out.columns == ["ID", "KIND", "N", "CODE", "RATE"]
    assert collect(out, "ID", "KIND") == [("a", "MÉDIO, x")]
    write(tmp_path / "b" / "f_0121.csv", "﻿ID,KIND\na,ç\n")
    assert collect(read_period_files(spark, str(tmp_path / "b"), SCHEMA), "ID", "KIND") == [("a", "ç")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f_0121.csv.gz").write_bytes(gzip.compress(b"ID,KIND\nz,k\n"))
    assert collect(read_period_files(spark, str(tmp_path / "c"), SCHEMA, pattern="*.csv.gz"), "ID", "KIND") == [("z", "k")]


PREAMBLE = "Title\n\nnote,with,commas\n,,\n5\n6\n7\n8\n"


def test_preamble_lines_are_skipped_by_position(spark, collect, tmp_path):
    # A data row equal to a preamble line must stay; the footer has no code and stays for a later filter.
    write(tmp_path / "x_2021.csv", PREAMBLE + "ID,KIND,N\na,x,1\n5\n,,\nb,NA,\nSource: ministry\n")
    write(tmp_path / "y_2022.csv", PREAMBLE + "N,ID\n7,c\n")
    out = read_period_files(spark, str(tmp_path), SCHEMA, skip=8, stamp=False)
    assert collect(out, "ID", "KIND", "N") == [
        ("", "", None),
        ("5", "", None),
        ("Source: ministry", "", None),
        ("a", "x", 1),
        ("b", None, None),
        ("c", None, 7),
    ]


def test_preamble_of_a_file_read_in_many_splits(spark, tmp_path):
    body = "".join(f"id{i},k,{i}\n" for i in range(20000))
    write(tmp_path / "big_2021.csv", PREAMBLE + "ID,KIND,N\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = read_period_files(spark, str(tmp_path), SCHEMA, skip=8, stamp=False)
        assert out.rdd.getNumPartitions() > 3
        got = out.agg(F.count("*"), F.count_distinct("ID"), F.sum("N"), F.min("N")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(got) == (20000, 20000, sum(range(20000)), 0)


def test_no_files_and_empty_files_give_an_empty_table(spark, tmp_path):
    write(tmp_path / "empty_0121.csv", "")
    out = read_period_files(spark, str(tmp_path), SCHEMA)
    assert out.columns[:3] == ["DATE", "YEAR", "ID"] and out.count() == 0


def test_repeated_header_names_are_refused(spark, tmp_path):
    write(tmp_path / "f_0121.csv", "ID,id\na,b\n")
    with pytest.raises(ValueError, match="repeated"):
        read_period_files(spark, str(tmp_path), SCHEMA)


def test_saved_panel_reads_only_the_years_asked_for(spark, collect, tmp_path):
    df = spark.createDataFrame([("a", 2021), ("b", 2022)], "id string, YEAR int")
    save_panel(df, str(tmp_path / "p"))
    one = load_panel(spark, str(tmp_path / "p")).where("YEAR = 2022")
    assert collect(one, "id", "YEAR") == [("b", 2022)]
    assert one.rdd.getNumPartitions() == 1
    save_report(df, str(tmp_path / "r"))
    assert load_panel(spark, str(tmp_path / "r")).count() == 2
    empty = staged(df.where("false"), str(tmp_path / "e"), by="YEAR")
    assert empty.columns == ["id", "YEAR"] and empty.count() == 0
    assert collect(staged(df, str(tmp_path / "s")), "id", "YEAR") == [("a", 2021), ("b", 2022)]


def test_stages_go_to_the_folder_the_session_names():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/x/", "spark.sql.warehouse.dir": "/wh"})
    first, second = stage_folder(named), stage_folder(named)
    assert first.startswith("/shared/x/panelweave-") and first != second
    unnamed = SimpleNamespace(conf={"spark.sql.warehouse.dir": "/wh/"})
    assert stage_folder(unnamed).startswith("/wh/_stages/panelweave-")


def test_table_with_several_readers_is_the_same_table(spark, collect):
    df = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    again = reused(df)
    assert again.schema == df.schema and collect(again) == collect(df)


def read(spark, folder, **settings):
    return read_period_files(spark, str(folder), SCHEMA, **settings)


def test_names_with_spaces_accents_and_glob_characters(spark, collect, tmp_path):
    for i, name in enumerate(["abs 0121.csv", "ação_0221.csv", "a[1]{2}*_0321.csv", "a%20b_0421.csv", "a+b_0521.csv"]):
        write(tmp_path / name, f"ID,N\nr{i},{i}\n")
    assert collect(read(spark, tmp_path), "DATE", "ID", "N") == [("0121", "r0", 0), ("0221", "r1", 1), ("0321", "r2", 2), ("0421", "r3", 3), ("0521", "r4", 4)]
    assert len({r["DATE"] for r in read(spark, tmp_path).select("DATE").collect()}) == 5


def test_doubled_quotes_and_separators_in_quotes(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", 'ID,"KIND",N\na,"SAO ""X"", Y",5\n"b;1","",6\n')
    assert collect(read(spark, tmp_path), "ID", "KIND", "N") == [("a", 'SAO "X", Y', 5), ("b;1", "", 6)]


def test_header_with_a_quoted_separator(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", 'ID,"OTHER, MORE",N\na,x,7\n')
    assert collect(read(spark, tmp_path), "ID", "N") == [("a", 7)]


def test_quoted_line_breaks(spark, collect, tmp_path):
    write(tmp_path / "a" / "f_0121.csv", 'ID,KIND,N\na,"two\nlines",1\nb,x,2\n')
    with pytest.raises(Exception, match="multi_line"):
        read(spark, tmp_path / "a").collect()
    assert collect(read(spark, tmp_path / "a", multi_line=True), "ID", "KIND", "N") == [("a", "two\nlines", 1), ("b", "x", 2)]
    write(tmp_path / "b" / "f_0121.csv", PREAMBLE + 'ID,KIND,N\na,"two\n\nlines",1\nb,x,2\n')
    assert collect(read(spark, tmp_path / "b", multi_line=True, skip=8), "ID", "KIND", "N") == [("a", "two\n\nlines", 1), ("b", "x", 2)]


def test_blank_first_lines_are_passed_over(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", "\n  \nID,N\na,1\n")
    assert collect(read(spark, tmp_path), "ID", "N") == [("a", 1)]


def test_fractions_of_whole_numbers_are_refused(spark, collect, tmp_path):
    write(tmp_path / "a" / "f_0121.csv", "ID,N,CODE\na,3.0,9007199254740993\n")
    assert collect(read(spark, tmp_path / "a"), "N", "CODE") == [(3, 9007199254740993)]
    write(tmp_path / "b" / "f_0121.csv", "ID,N\na,3.7\n")
    with pytest.raises(Exception, match="column N holds whole numbers, but also 3.7"):
        read(spark, tmp_path / "b").collect()


def test_over_long_preamble_is_refused(spark, tmp_path):
    write(tmp_path / "a" / "x_2021.csv", PREAMBLE + "\nID,KIND\na,b\n")
    with pytest.raises(ValueError, match="no header after 8 lines in .*x_2021"):
        read(spark, tmp_path / "a", skip=8)
    write(tmp_path / "b" / "x_2021.csv", "Title\n")
    with pytest.raises(ValueError, match="no header"):
        read(spark, tmp_path / "b", skip=8)


def test_header_over_one_mebibyte(spark, collect, tmp_path):
    write(tmp_path / "f_0121.csv", f"ID,{'X' * (1 << 20)},KIND,N\na,b,c,4\n")
    assert collect(read(spark, tmp_path), "ID", "KIND", "N") == [("a", "c", 4)]


def test_files_without_known_or_required_columns_are_refused(spark, tmp_path):
    write(tmp_path / "f_0121.csv", "AA,BB\n1,2\n")
    with pytest.raises(ValueError, match="declared in .*f_0121"):
        read(spark, tmp_path)
    write(tmp_path / "g" / "f_0121.csv", "ID\n1\n")
    with pytest.raises(ValueError, match="no column N in .*f_0121"):
        read(spark, tmp_path / "g", required=("ID", "N"))


def test_preamble_files_in_another_encoding(spark, collect, tmp_path):
    write(tmp_path / "x_2021.csv", PREAMBLE + "ID,KIND,N\nção,é,1\n", "latin-1")
    assert collect(read(spark, tmp_path, skip=8, encoding="ISO-8859-1"), "ID", "KIND", "N") == [("ção", "é", 1)]
