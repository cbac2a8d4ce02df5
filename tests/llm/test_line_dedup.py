from __future__ import annotations

import random
from collections import defaultdict

from helpers import documents, odd_rows
from pyspark.sql import functions as F

from footfall.llm import line_dedup

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or drop.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["Shared line number %d that is long enough to count as a key" % i for i in range(12)]
    pool += ["Grüße ÀÉ %d und noch ein langer Satz, der oft genug vorkommt" % i for i in range(4)] + ["short", "", "x" * 39, "x" * 40]

    def line():
        x = rng.choice(pool)
        return rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r", x + " own %d" % rng.randint(0, 3)])

    rows = [(rng.randint(0, 40), "\n".join(line() for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values()) + odd_rows()[:5]
    rows = [(i, t) for n, (i, t) in enumerate(rows) if i is None or i not in [j for j, _ in rows[:n]]]
    docs = documents(spark, rows)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        assert told(line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)) == brute(rows)


def test_case_of_other_letters_counts(spark):
    a, b = "ÀÉÎÕÜ und noch viele Buchstaben bis vierzig", "àéîõü und noch viele Buchstaben bis vierzig"
    rows = [(i, a if i < 4 else b) for i in range(8)]
    assert all(r[2] == 0 for r in told(line_dedup.dedup_lines(documents(spark, rows))))


def test_repeated_rows_nulls_and_columns(spark):
    line = "the very same line in all of these documents here"
    rows = [(i, line) for i in range(5)] + [(4, line), (None, line), (9, None)]
    docs = documents(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    assert told(got) == sorted([(i, 1, 1, "") for i in range(4)] + [(4, 1, 0, line)] * 2 + [(None, 1, 0, line), (9, 1, 0, "")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_merge_and_know_their_holders(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for batch in ([(1, 1, 2, 90), (2, 2, 1, 91)], [(1, 1, 3, 50), (3, 3, 1, 51)], [(3, 3, 4, 20)], [(1, 1, 1, 10)]):
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long, n long, holder long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(map(tuple, runs.total().collect())) == [(1, 1, 6, 90), (2, 2, 1, 91), (3, 3, 5, 51)]


def test_no_run_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, "a line that several documents hold, and that is long\nown") for i in range(9)], "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(docs).collect()) == 8
    assert {t.name for t in spark.catalog.listTables()} == before
