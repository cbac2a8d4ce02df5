from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest
from helpers import DATA, documents, odd_rows
from pyspark.sql import functions as F

from footfall.llm import mixing
from footfall.llm.queries import QUERIES


def test_shares_by_code_point_with_caps():
    sizes = {"b": 100, "B": 100, "é": 100, None: 100, "z": 1}
    got = mixing.shares(sizes)  # order B b z é null, weights 1 2 3 1 2
    assert got["z"] == 3 and sum(got.values()) == pytest.approx(401)
    assert [got[s] for s in ("B", "b", "é", None)] == pytest.approx([398 / 6, 398 / 3, 398 / 6, 398 / 3])
    assert mixing.shares({}) == {} and mixing.shares({"a": 0}) == {"a": 0.0}


def test_flow_costs_least():
    """Small cases against all ways to send whole words."""
    rng = random.Random(4)
    for _ in range(25):
        groups = [(("a",), rng.randint(1, 3)), (("b",), rng.randint(1, 3)), (("a", "b"), rng.randint(1, 3))]
        quota = {"a": float(rng.randint(0, 8)), "b": float(rng.randint(0, 8))}
        best = None
        for own_a, own_b, both_a, both_b in itertools.product(range(10), repeat=4):
            used = (own_a, own_b, both_a + both_b)
            if any(u > 3 * n for u, (_, n) in zip(used, groups, strict=True)) or own_a + both_a > quota["a"] or own_b + both_b > quota["b"]:
                continue
            cost = sum(2 * (i // n) + 1 for u, (_, n) in zip(used, groups, strict=True) for i in range(u))
            key = (-sum(used), cost)
            best = key if best is None or key < best else best
        got = mixing.least_cost_flow(groups, quota)
        cost = sum(2 * (i // n) + 1 for u, (_, n) in zip(got, groups, strict=True) for i in range(round(u)))
        assert (-sum(got), cost) == pytest.approx(best)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query_against_its_contract(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = QUERIES["op1_mixing"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op1_mixing"](spark, folder).collect()))
    assert len(got) == len(docs)
    size, source = {d.doc_id: words(d.text) for d in docs}, {d.doc_id: d.source for d in docs}
    totals, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        totals[d.source] += size[d.doc_id]
    target = mixing.shares(dict(totals))
    for r in got:
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], totals[source[r.doc_id]], pytest.approx(target[source[r.doc_id]]))
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[source[r.doc_id]] += r.taken
    for s, t in target.items():
        assert taken[s] == pytest.approx(t, rel=0.01, abs=20)


def test_selection_in_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST", 4)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("size"), F.array(F.when(F.col("id") % 3 > 0, "big").otherwise("other")).alias("sources"))
    got = mixing.mix(docs, "sources", "size").groupBy("target").agg(F.sum("taken").alias("taken"), F.max("times").alias("most")).collect()
    assert len(got) == 2
    for r in got:
        assert r.taken == pytest.approx(r.target, abs=30) and r.most <= 3


def test_documents_of_several_sources(spark):
    rows = [(i, 10, ["a"]) for i in range(30)] + [(100 + i, 10, ["b", "a", "b"]) for i in range(30)] + [(200, 5, []), (201, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>").withColumn("target", F.lit("clash"))
    got = mixing.mix(docs, "sources", "size").collect()
    assert sum(r.taken for r in got) == pytest.approx(600, abs=20)
    assert {r.times for r in got if r.doc_id >= 200} == {0} and {r.target for r in got if r.doc_id >= 200} == {None}
    assert sum(r.taken for r in got if r.doc_id >= 100) >= 300  # b's share can come from these only


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, [(*r, None if r[0] == 3 else "s") for r in odd_rows()])
    docs = docs.withColumn("sources", F.array("source")).withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mix(docs, "sources", "size")
    assert got.count() == 8 and len({tuple(r) for r in got.where("doc_id = 5").select("taken", "times").collect()}) == 1
    assert got.where("doc_id in (1, 2, 3)").agg(F.sum("taken")).first()[0] == 0
    assert mixing.mix(docs.limit(0), "sources", "size").count() == 0


def test_nearest_subset_against_all():
    rng = random.Random(1)
    for _ in range(200):
        sizes, need = [rng.randint(0, 30) for _ in range(rng.randint(0, 8))], rng.uniform(-5, 120)
        goal = round(min(max(need, 0), sum(sizes)))
        best = min(abs(goal - sum(c)) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r))
        got = mixing.nearest_subset(sizes, need)
        assert abs(goal - sum(s for s, t in zip(sizes, got, strict=True) if t)) == best
    assert mixing.nearest_subset([10**9, 2 * 10**9, 5], 10**9) == [True, False, False]
