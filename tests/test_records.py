from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from footfall.sources import readers, writers
from footfall.sources.records import csv_records, file_lines

SCHEMA = "id string, text string"


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def one_task(spark, path, encoding="UTF-8"):
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, schema=SCHEMA)


def by_id(rows, df):
    return rows(df, "id", "text")


@pytest.mark.parametrize("encoding", ["UTF-8", "GB18030"])
def test_one_file_in_many_tasks(spark, rows, tmp_path, small_chunks, encoding):
    rng = random.Random(2)
    bits = ["招聘", '"', "\n", ",", "word ", '""', "\r\n", " ", "\n\n", "é", "", "x" * 300]
    texts = [(str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [("400", None), ("401", "")]
    df = spark.createDataFrame(texts, SCHEMA)
    readers.allow_encoding(spark, encoding)
    path = str(tmp_path / "ads")
    writers.write_csv(df.coalesce(1), path, encoding=encoding)
    got = readers.read_ad_texts(spark, path, encoding=encoding, multi_line=True)
    want = by_id(rows, one_task(spark, path, encoding))
    assert by_id(rows, got) == want and len(want) == len(texts)
    assert {r.id for r in got.where("text is null").collect()} >= {"400"}
    chunks = file_lines(spark, path).select("file", "start").distinct()
    assert chunks.select("file").distinct().count() == 1 and chunks.count() > 20
    assert got.select(F.spark_partition_id()).distinct().count() > 5


def test_a_record_longer_than_many_chunks(spark, rows, tmp_path, small_chunks):
    texts = [("1", "short"), ("2", "line, of a long text\n" * 400), ("3", '"\n"'), ("4", "end")]
    path = str(tmp_path / "ads")
    writers.write_csv(spark.createDataFrame(texts, SCHEMA).coalesce(1), path)
    assert by_id(rows, readers.read_ad_texts(spark, path, multi_line=True)) == by_id(rows, one_task(spark, path))


def test_line_ends_blank_lines_headers_and_empty_files(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,text\r\n1,plain\r\n\r\n2,"two\r\nlines"\r\n \n3,"a ""b"""')
    (tmp_path / "b.csv").write_bytes(b'"id","text"\n4,"x,y"\n')
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"id,text\n")
    got = by_id(rows, readers.read_ad_texts(spark, str(tmp_path), multi_line=True))
    assert got == [("1", "plain"), ("2", "two\r\nlines"), ("3", 'a "b"'), ("4", "x,y")]
    assert csv_records(spark, str(tmp_path / "b.csv"), header=False).count() == 2


def test_an_open_quote_takes_the_rest_of_its_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,text\n1,ok\n2,"never closed\n3,x\n')
    records = [bytes(r.record) for r in csv_records(spark, str(tmp_path / "a.csv")).collect()]
    assert sorted(records) == [b"1,ok", b'2,"never closed\n3,x']
