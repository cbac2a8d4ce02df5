"""Small numeric expressions shared by the panels and the feature tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def flag(value: Column) -> Column:
    """1 where a value is present, else 0."""
    return value.isNotNull().cast("int")


def log10_plus1(value: Column) -> Column:
    return F.log10(value + 1)


def log_ratio(value: Column, mean: Column) -> Column:
    """Value against its mean on the log scale; 0 where the mean is 0."""
    return F.coalesce(log10_plus1(value) / F.nullif(log10_plus1(mean), F.lit(0.0)), F.lit(0.0))


def interaction(a: Column, b: Column) -> Column:
    """Product of two terms; a missing one drops out, and two missing ones give 0."""
    return F.coalesce(a * b, a, b, F.lit(0.0))


def first_argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def half_entropy_cell(cell: Column, row: Column, col: Column, total: Column) -> Column:
    """One cell's part of the mutual information of a 2x2 table; an empty cell adds 0."""
    cell, row, col, total = (x.cast("double") for x in (cell, row, col, total))
    safe = F.when(cell > 0, (total / row) * (cell / col))
    return F.coalesce(cell / total * F.log2(safe), F.lit(0.0))
