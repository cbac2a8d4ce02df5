"""Scans of tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.sources.records import read_records

# Encodings Spark reads without further settings.
PLAIN_ENCODINGS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Let the session read and write an encoding that Spark supports only with a setting, which stays on."""
    if encoding.upper() not in PLAIN_ENCODINGS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or Parquet files by path."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def read_days(
    spark: SparkSession, name_or_path: str, lo: int, hi: int, *, columns: list[str] | None = None, closed: bool = True
) -> DataFrame:
    """A table restricted to a day range, with only the wanted columns in the scan."""
    day = F.col("dayno")
    rows = read_table(spark, name_or_path).where((day >= lo) & ((day <= hi) if closed else (day < hi)))
    return rows.select(*columns) if columns else rows


def read_lookup_csv(spark: SparkSession, path: str, columns: list[str], *, encoding: str = "GBK") -> DataFrame:
    """A headed CSV lookup whose columns are renamed by position; all values are text."""
    allow_encoding(spark, encoding)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, encoding=encoding, schema=schema, enforceSchema=True)


def read_ad_texts(spark: SparkSession, path: str, *, encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Ads as (id, text), a line each. With ``multi_line`` quoted texts may span lines; large files are read by many tasks too."""
    allow_encoding(spark, encoding)
    schema = "id string, text string"
    if multi_line:
        return read_records(spark, path, schema, encoding=encoding)
    return spark.read.csv(path, header=True, escape='"', encoding=encoding, schema=schema)


def read_lines(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """Trimmed lines of a text file; blank lines are left out."""
    if encoding.upper() == "UTF-8":
        lines = spark.read.text(path).withColumnRenamed("value", "line")
    else:
        allow_encoding(spark, encoding)
        lines = spark.read.csv(path, sep="\x01", quote="", encoding=encoding, schema="line string")
    return lines.select(F.trim("line").alias("line")).where(F.col("line") != "")


def lookup(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """A small lookup given in code."""
    return spark.createDataFrame(rows, columns)
