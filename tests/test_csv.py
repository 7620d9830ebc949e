"""CSV files split among many tasks, against Spark's own reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from bookpulse.sources import csv_records, tables


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(r):
    text = "".join(r.choice(["a", "é", "\n", '"', ",", " ", "word ", "\n\n", '""']) for _ in range(r.randrange(8)))
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '\n",') or r.random() < 0.2 else text


def write(path, rows, end="\n"):
    path.write_bytes((end.join(["id,name,other", *rows]) + end).encode())


def test_many_splits_read_as_whole_files(spark, tmp_path, small_splits):
    r = random.Random(4)
    folder = tmp_path / "csv"
    folder.mkdir()
    for k in range(2):
        write(folder / f"{k}.csv", [f"{k}-{i},{field(r)},{field(r)}x" for i in range(3000)])
    # One record over many splits, and one that ends at the end of the file.
    long = "line\n" * 6000
    write(folder / "long.csv", ["1,a,b", f'2,"{long}",y', "3,c,d", '4,"' + "x\n" * 3000 + '",z', '5,"last\n","end\n"'])
    want = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(folder))
    got = csv_records.read_csv(spark, str(folder))
    assert got.columns == want.columns
    assert got.select("id").distinct().count() == got.count() == want.count()
    a, b = ({row.id: tuple(row) for row in df.collect()} for df in (got, want))
    assert [i for i in a if a[i] != b[i]] == []
    assert a["2"][1] == long and a["5"] == ("5", "last\n", "end\n")
    tasks = csv_records._lines(spark, str(folder)).rdd.getNumPartitions()
    assert tasks > 10
    inside = csv_records._open_splits(csv_records._lines(spark, str(folder)))
    assert sum(inside.values()) > 8 and not all(inside.values())


def test_line_ends_blank_lines_and_marks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name,other\r\n1,\"a\r\nb\",c\r\n\r\n2,,\"\"\r\n3,x".encode())
    rows = csv_records.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "a\nb", "c"), ("2", None, None), ("3", "x", None)]


def test_headers_and_unclosed_quotes(spark, tmp_path, small_splits):
    write(tmp_path / "open.csv", ["1,a,b", '2,"never closed,c', *[f"{i},x,y" for i in range(3, 3000)]])
    with pytest.raises(ValueError, match="never closed"):
        csv_records.read_csv(spark, str(tmp_path / "open.csv"))
    two = tmp_path / "two"
    two.mkdir()
    write(two / "a.csv", ["1,a,b"])
    (two / "b.csv").write_text("id,name\n1,a\n")
    with pytest.raises(ValueError, match="different headers"):
        csv_records.read_csv(spark, str(two))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        csv_records.read_csv(spark, str(tmp_path / "empty.csv"))
    write(tmp_path / "head.csv", [])
    assert csv_records.read_csv(spark, str(tmp_path / "head.csv")).count() == 0
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('"the id","na\nme"\n1,2\n')
    assert csv_records.read_csv(spark, str(quoted)).columns == ["the id", "na\nme"]


def test_files_split_anew_are_refused(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [f'{i},"a\nb",c' for i in range(2000)])
    df = csv_records.read_csv(spark, str(tmp_path / "a.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    with pytest.raises(Exception, match="split anew"):
        df.agg(F.count("id")).collect()


def test_transactions_with_breaks_in_names(raw, spark, tmp_path, small_splits):
    rows = [{"balance_owner_uuid": f"client-{i:04d}", "balance_owner_name": f'Ana "{i}"\nMaria, {i}'} for i in range(400)]
    df = raw(*rows)
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    got = tables.read_transactions(spark, str(tmp_path / "csv"), "csv")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert csv_records._lines(spark, str(tmp_path / "csv")).rdd.getNumPartitions() > 4
