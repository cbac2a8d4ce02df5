from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from footfall.sources import readers, staging, writers


def test_table_by_path_and_name(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 20240101), (2, 20240102), (3, 20240103)], "v int, dayno int")
    path = str(tmp_path / "t")
    writers.write_table(df, path, partition_by=["dayno"])
    writers.append_table(df.where("v = 2"), path, partition_by=["dayno"])
    got = readers.read_days(spark, path, 20240102, 20240103, columns=["v"], closed=False)
    assert rows(got) == [(2,), (2,)]
    assert rows(readers.read_days(spark, path, 20240102, 20240103), "v") == [(2,), (2,), (3,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dayno" in plan
    df.createOrReplaceTempView("days_view")
    assert readers.read_table(spark, "days_view").count() == 3


def test_day_predicates_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.range(10).select("id", (F.col("id") + 20240101).alias("dayno"), F.lit("x").alias("wide")).write.parquet(path)
    plan = readers.read_days(spark, path, 20240103, 20240105, columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dayno,20240103)" in plan and "wide" not in plan


@pytest.mark.parametrize("encoding", ["GBK", "GB18030", "UTF-8"])
def test_lookup_csv_renames_by_position(spark, rows, tmp_path, encoding):
    (tmp_path / "l.csv").write_bytes("应用,分类,重度\n王者,游戏,是\n新闻,资讯,否\n".encode(encoding))
    got = readers.read_lookup_csv(spark, str(tmp_path / "l.csv"), ["x", "y", "z"], encoding=encoding)
    assert rows(got) == [("新闻", "资讯", "否"), ("王者", "游戏", "是")]


def test_ad_texts_keep_line_breaks_and_quotes(spark, rows, tmp_path):
    df = spark.createDataFrame([("1", '急招 "保安"\n包吃, 包住'), ("2", "x")], "id string, text string")
    writers.write_csv(df, str(tmp_path / "ads"))
    assert rows(readers.read_ad_texts(spark, str(tmp_path / "ads"), multi_line=True)) == rows(df)


@pytest.mark.parametrize("encoding", ["GB18030", "UTF-8"])
def test_stop_word_lines(spark, rows, tmp_path, encoding):
    (tmp_path / "s.txt").write_bytes('的\n 了 \n\n"\n,a\n'.encode(encoding))
    got = readers.read_lines(spark, str(tmp_path / "s.txt"), encoding=encoding)
    assert sorted(r[0] for r in rows(got)) == sorted(["的", "了", '"', ",a"])


def test_text_lines(spark, rows, tmp_path):
    df = spark.createDataFrame([(["a", "b"],), (["c"],)], "words array<string>")
    writers.write_lines(df, F.concat_ws(" ", "words"), str(tmp_path / "out"))
    assert rows(readers.read_lines(spark, str(tmp_path / "out"))) == [("a b",), ("c",)]


def test_staged_tables_go_to_the_shared_folder(spark, rows):
    shared = staging.shared_folder(spark)
    assert shared == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = spark.createDataFrame([(1, "a")], "v int, s string")
    staged = staging.stage(df, "t")
    assert rows(staged) == [(1, "a")] and staged.schema == df.schema
    assert all(f.startswith(f"file://{shared}/footfall/") for f in staged.inputFiles())


class _Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, conf):
        self.sparkContext, self.conf, self.values = self, self, conf
        self.master, self.applicationId = master, "app"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def getCheckpointDir(self):
        return None


def test_a_cluster_must_name_its_folder():
    assert staging.shared_folder(_Session("yarn", {"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    with pytest.raises(ValueError):
        staging.shared_folder(_Session("yarn", {}))
    local = _Session("local[2]", {})
    assert staging.shared_folder(local) == staging.shared_folder(local)


def test_lookup_in_code(spark, rows):
    assert rows(readers.lookup(spark, [("a", 1)], ["k", "v"])) == [("a", 1)]
