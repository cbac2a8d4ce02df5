"""Ordinary least squares for every group of a table in one job.

Rows are never multiplied with each other: tasks turn the rows of a group into the triangle R of their QR factorisation, and
triangles are merged by factorising them again, one below the other. That keeps the digits that sums of products lose.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import salted_join
from footfall.sources.staging import stage

TOLERANCE = 1e-8  # part of a column's spread around its mean that the columns before it must leave unexplained
ROUNDING = 1e-13  # part of a column's length that is noise of the arithmetic
FLUSH_GROUPS = 1024  # triangles a task holds before it hands them on
BLOCK_ROWS = 128  # rows of a group that are factorised together
MERGE_TASKS = 64  # tasks that merge the triangles of one group before the last one does

# The states of a group's fit.
FITTED, EXACT, EMPTY = "fitted", "no degrees of freedom", "no complete rows"


def result_columns(n_responses: int) -> list[str]:
    """Coefficient and standard error of every response, then the R2 of every response."""
    numbers = range(1, n_responses + 1)
    return [c for i in numbers for c in (f"c{i}", f"se{i}")] + [f"r2_{i}" for i in numbers]


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle R of the rows' QR factorisation, with zeros below where rows are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


class Held:
    """Triangle and number of rows of one group, and rows that wait to be factorised."""

    def __init__(self, width: int) -> None:
        self.r, self.n, self.waiting, self.blocks = np.zeros((width, width)), 0, 0, []

    def add(self, rows: np.ndarray, n: int) -> None:
        self.n += n
        self.waiting += len(rows)
        self.blocks.append(rows)
        if self.waiting >= BLOCK_ROWS:
            self.square()

    def square(self) -> np.ndarray:
        if self.waiting:
            self.r, self.waiting, self.blocks = triangle(np.vstack([self.r, *self.blocks])), 0, []
        return self.r


def _pack(group: str, held: dict[str, Held], part: int) -> pd.DataFrame:
    upper = [h.square()[np.triu_indices(len(h.r))] for h in held.values()]
    return pd.DataFrame({group: list(held), "part": part, "n": [h.n for h in held.values()], "r": upper})


def _unpack(upper: np.ndarray, width: int) -> np.ndarray:
    square = np.zeros((width, width))
    square[np.triu_indices(width)] = upper
    return square


def _triangles(group: str, columns: list[str]):
    """Per task and group: the triangle of (1, columns). A group whose rows are all incomplete is handed on with no rows."""
    width = len(columns) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Held] = {}
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for pdf in batches:
            for name, rows in pdf.groupby(group, sort=False):
                z = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(dtype=float)])
                z = z[np.isfinite(z).all(axis=1)]
                held.setdefault(name, Held(width)).add(z, len(z))
            if len(held) >= FLUSH_GROUPS:
                yield _pack(group, held, part)
                held.clear()
        if held:
            yield _pack(group, held, part)

    return run


def _merged(group: str, width: int):
    """One triangle per group from rows that are sorted by group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, part = None, Held(width), 0
        for pdf in batches:
            for one, upper, n, part in zip(pdf[group], pdf["r"], pdf["n"], pdf["part"], strict=True):
                if one != name and name is not None:
                    yield _pack(group, {name: held}, part)
                    held = Held(width)
                name = one
                held.add(_unpack(upper, width), n)
        if name is not None:
            yield _pack(group, {name: held}, part)

    return run


def solve(r: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors, R2 and the aliased terms, from the triangle of (1, predictors, responses).

    Terms enter in order; one that the earlier terms explain (or a constant) is aliased.
    """
    basis, kept = np.zeros((len(r), 0)), []
    spread = np.linalg.norm(r[1:], axis=0)  # the first column is the intercept, and R turns it into the first row
    for j in range(n_terms):
        rest = r[:, j].copy()
        for _ in range(2):  # once more against rounding
            rest -= basis @ (basis.T @ rest)
        length = np.linalg.norm(rest)
        if length > max(ROUNDING * np.linalg.norm(r[:, j]), TOLERANCE * spread[j]):
            basis, kept = np.column_stack([basis, rest / length]), [*kept, j]
    aliased = np.ones(n_terms, dtype=bool)
    aliased[kept] = False
    responses = r[:, n_terms:]
    inverse = np.linalg.inv(np.triu(basis.T @ r[:, kept])) if kept else np.zeros((0, 0))
    coef = np.full((responses.shape[1], n_terms), np.nan)
    coef[:, kept] = (inverse @ (basis.T @ responses)).T
    sse = ((responses - basis @ (basis.T @ responses)) ** 2).sum(axis=0)
    sst = (responses[1:] ** 2).sum(axis=0)
    free = n - len(kept)
    se = np.full_like(coef, np.nan)
    if free > 0:
        se[:, kept] = np.sqrt(np.outer(sse / free, (inverse**2).sum(axis=1)))
    constant = sst <= ROUNDING**2 * (responses**2).sum(axis=0)
    r2 = np.where(constant, np.nan, 1.0 - sse / np.where(constant, 1.0, sst))
    return coef, se, r2, aliased


def _solve_group(group: str, predictors: list[str], n_columns: int):
    terms = ["intercept", *predictors]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = Held(n_columns + 1)
        for upper, n in zip(pdf["r"], pdf["n"], strict=True):
            held.add(_unpack(upper, n_columns + 1), n)
        coef, se, r2, aliased = solve(held.square(), held.n, len(terms))
        status = EMPTY if not held.n else FITTED if held.n > (~aliased).sum() else EXACT
        fits = [x for c, s in zip(coef, se, strict=True) for x in (c, s)] + list(r2)
        named = dict(zip(result_columns(len(coef)), fits, strict=True))
        return pd.DataFrame({group: pdf[group].iloc[0], "term": terms, **named, "n": held.n, "aliased": aliased, "status": status})

    return run


def ols_by_group(data: DataFrame, group: str, predictors: list[str], responses: list[str]) -> DataFrame:
    """Coefficients and standard errors of one or more responses on the same predictors, for every group of the data.

    Only triangles are shuffled, twice: those of a group meet in up to ``MERGE_TASKS`` tasks, which merge them one after the
    other, and their results in one. Rows with a NULL or a value that is not finite are left out, and rows without a group. A
    group is there whatever its rows are; ``status`` says whether it could be fitted, had as few rows as terms (coefficients
    without standard errors), or no complete row (nulls).
    """
    columns = [*predictors, *responses]
    width = len(columns) + 1
    rows = data.select(F.col(group).cast("string").alias(group), *(F.col(c).cast("double").alias(c) for c in columns))
    shape = f"{group} string, part long, n long, r array<double>"
    parts = rows.where(F.col(group).isNotNull()).mapInPandas(_triangles(group, columns), shape)
    dealt = parts.withColumn("part", F.col("part") % MERGE_TASKS).repartition(group, "part").sortWithinPartitions(group)
    solver = _solve_group(group, predictors, len(columns))
    doubles = result_columns(len(responses))
    fitted = [f"{group} string, term string", *(f"{c} double" for c in doubles), "n long, aliased boolean, status string"]
    fits = dealt.mapInPandas(_merged(group, width), shape).groupBy(group).applyInPandas(solver, ", ".join(fitted))
    return fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def simple_ols_by_group(data: DataFrame, group: str, predictor: str, responses: list[str]) -> DataFrame:
    """Slope, intercept and R2 on one predictor, from built-in aggregates alone."""
    x = F.col(predictor)
    fits = [
        fn(F.col(y), x).alias(f"{name}_{y}")
        for y in responses
        for name, fn in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))
    ]
    return data.groupBy(group).agg(F.count("*").alias("n"), *fits)


def normal_equations(
    data: DataFrame, fits: DataFrame, group: str, predictors: list[str], responses: list[str]
) -> DataFrame:
    """Largest product of a predictor with the residuals, per group and response: 0 for a least squares fit.

    Coefficients are written, so that Spark knows how short they are and lets them, not the rows, come to the join. All products
    of a row are added up where the row is, and tasks return one row per group.
    """
    terms = ["intercept", *predictors]
    pos = F.array_position(F.array(*map(F.lit, terms)), F.col("term"))
    by_term = F.sort_array(F.collect_list(F.struct(pos.alias("pos"), *(f"c{i + 1}" for i in range(len(responses))))))
    coefficients = stage(fits.groupBy(group).agg(by_term.alias("b")), "coefficients")
    x = [F.lit(1.0), *(F.col(p).cast("double") for p in predictors)]
    names = [f"r{i + 1}" for i in range(len(responses))]

    def residual(y: str, c: str) -> Column:
        products = (value * F.coalesce(F.col("b")[j][c], F.lit(0.0)) for j, value in enumerate(x))
        return F.col(y) - reduce(add, products, F.lit(0.0))

    def gap(r: str) -> Column:
        sums = [F.abs(F.sum(value * F.col(r))) for value in x]
        return (F.greatest(*sums) if len(sums) > 1 else sums[0]).alias(f"gap_{r}")

    residuals = [residual(y, f"c{i + 1}").alias(r) for i, (r, y) in enumerate(zip(names, responses, strict=True))]
    rows = salted_join(data, coefficients, [group], spread_by=["imei"])
    return rows.select(group, *predictors, *residuals).groupBy(group).agg(F.count("*").alias("n"), *map(gap, names))
