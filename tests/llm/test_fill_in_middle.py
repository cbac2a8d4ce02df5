from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from helpers import DATA, documents, odd_rows

from footfall.llm.fill_in_middle import ORACLE_SQL, digest, fill_in_middle, transform, units
from footfall.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    """The contract, word for word."""
    text, n = text or "", len(text or "")
    key = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text))


def check(spark, rows):
    got = [tuple(r) for r in digest(fill_in_middle(documents(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted((plainly(*r) for r in rows), key=str)
    return got


def test_against_the_contract(spark):
    rng = random.Random(5)
    bits = ["a", "é", "漢", "\U0001f600", "é", "\n", "\r\n", "\0", "<", ">", "P", "S", "M", "<P", "S>", "<<M", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    got = check(spark, rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_markers_odd_rows_and_empty_table(spark):
    rows = [*odd_rows(), (7, "a<P>b"), (8, "<M>"), (9, "<S> tail"), (-3, "negative"), (2**60, "large id")]
    check(spark, rows)
    empty = digest(fill_in_middle(documents(spark, []).limit(0)))
    assert empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert empty.count() == 0


def test_other_units_are_never_cut_apart(spark):
    text = "é" * 50 + "\r\n" * 50
    rows = fill_in_middle(documents(spark, [(i, text) for i in range(60)]), unit=r"\X").collect()
    assert {r.n for r in rows} == {100}
    for r in rows:
        for part in r.output.replace("<P>", "|").replace("<S>", "|").replace("<M>", "|").split("|"):
            assert not part.startswith("́") and not part.startswith("\n")
    with pytest.raises(ValueError):
        transform("ab", units("a"), [0, 0, 0, 0], 90, 20)


def test_string_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", "some text", "h", 1)], "doc_id string, text string, h string, n int")
    row = digest(fill_in_middle(df)).first()
    assert (row.doc_id, row.n) == ("x", 9)


def test_query_against_sql_and_python(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = QUERIES["op11_fill_in_middle"](spark, DATA)
    result = con.execute(ORACLE_SQL)
    assert [d[0] for d in result.description] == got.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(result.fetchall())
    assert rows == sorted(plainly(*r) for r in con.execute("select doc_id, text from documents").fetchall())
