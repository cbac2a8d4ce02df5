"""Sinks for tables, CSV results and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def write_table(df: DataFrame, name_or_path: str, *, partition_by: list[str] | None = None) -> None:
    """Create or replace a table; partition facts by day so that day ranges prune files."""
    _save(df, name_or_path, "overwrite", partition_by)


def append_table(df: DataFrame, name_or_path: str, *, partition_by: list[str] | None = None) -> None:
    _save(df, name_or_path, "append", partition_by)


def _save(df: DataFrame, name_or_path: str, mode: str, partition_by: list[str] | None) -> None:
    """Rebalancing before a partitioned write keeps files few, and still splits a day too large for one task."""
    writer = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name_or_path:
        writer.parquet(name_or_path)
    else:
        writer.saveAsTable(name_or_path)


def write_csv(df: DataFrame, path: str, *, header: bool = True, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").csv(path, header=header, encoding=encoding, escape='"')


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    """One text line per row."""
    df.select(line.alias("value")).write.mode("overwrite").text(path)
