"""Every registered query against its SQL, and the entry points of the driver."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as driver
from footfall.catalogue import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SLOW = {"lda_sweep"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", [n for n in driver.queries() if n not in SLOW])
def test_query(spark, con, name, monkeypatch):
    # The smallest tables hold a tenth of the exposures the threshold is meant for.
    monkeypatch.setattr(views, "MIN_EXPOSURE", 1000)
    df = driver.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return
    result = con.execute(sql.replace("expose_cnt >= 10000", "expose_cnt >= 1000"))
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    expected = ordered(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())
    assert got == expected


def test_every_oracle_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
