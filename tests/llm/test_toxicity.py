from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import WORDS, documents, odd_rows
from pyspark.sql import functions as F

from footfall.llm import toxicity
from footfall.llm.queries import CATEGORIES


def corpus(spark, n=400):
    """Insults make a text rude, threats only count in rude texts, and slurs of a language begin alike."""
    rng, rows, marks = random.Random(8), [], []
    for i in range(n):
        rude, threat, slur = rng.random() < 0.3, rng.random() < 0.3, rng.random() < 0.15
        text = [rng.choice(WORDS) for _ in range(rng.randint(10, 60))]
        text += ["moron"] * rude + ["hurt"] * threat + ["zorgf" + rng.choice("abcdefgh") * rng.randint(1, 9)] * slur
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, int(rude), int(rude and threat), int(slur)))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, rude int, threat int, slur int"), marks


def test_chain_on_held_out_rows(spark):
    docs, labels, marks = corpus(spark)
    categories = ["rude", "threat", "slur"]
    chain = toxicity.fit(docs, labels.where("doc_id < 300"), categories)
    assert [len(e) for e in chain.earlier] == [0, 1, 2]
    assert chain.earlier[1][0] > 0.2  # a threat leans on rudeness
    got = {r.doc_id: r for r in toxicity.classify(docs, chain, ["doc_id"]).collect()}
    for c, name in enumerate(categories, 1):
        right = [(got[m[0]][f"p_{name}"] >= 0.5) == bool(m[c]) for m in marks[300:]]
        assert np.mean(right) >= 0.95, name


def test_scores_are_those_of_the_weights(spark):
    docs, labels, _ = corpus(spark, 120)
    chain = toxicity.fit(docs, labels, ["rude", "threat"])
    features = toxicity.Features({f: i for i, f in enumerate(chain.vocabulary)})
    for r in toxicity.classify(docs, chain, ["doc_id", "text", "extra"]).limit(20).collect():
        own, p = sorted(features(r.text)), []
        for c in range(2):
            score = chain.intercepts[c] + chain.weights[c][own].sum() + float(np.dot(chain.earlier[c], p))
            p.append(1 / (1 + np.exp(-score)))
        assert [r.p_rude, r.p_threat] == pytest.approx(p) and r.extra == "x"


def test_toxic_documents_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0
    chain = toxicity.fit(docs, labels.where(~held), CATEGORIES)
    scored = toxicity.classify(docs.join(labels.where(held).select("doc_id"), "doc_id"), chain, ["doc_id"]).join(labels, "doc_id")
    flagged = F.col("p_toxic") >= 0.5
    hits, found, toxic = scored.agg(F.count_if(flagged & (F.col("toxic") == 1)), F.count_if(flagged), F.count_if(F.col("toxic") == 1)).first()
    # Measured: 0.80 and 0.96. Some labelled texts hold no mark at all, and a rare language has few rows to learn from.
    assert hits / toxic >= 0.75 and hits / found >= 0.93, (hits, found, toxic)


def test_bound_of_the_sample_and_labels(spark):
    docs, labels, _ = corpus(spark, 100)
    odd = labels.unionByName(spark.createDataFrame([(5, None, 1, 1), (None, 1, 1, 1), (7, 1, 1, 1)], labels.schema))
    rows = toxicity.training_rows(docs, odd, ["rude", "threat", "slur"], "doc_id", "text", 40)
    assert rows.count() == 40 and rows.where("rude is null").count() == 0


def test_constant_labels_odd_rows_and_empty_tables(spark):
    docs = documents(spark, odd_rows()).withColumn("p_rude", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, rude int, threat int")
    alike = spark.createDataFrame([(i, 1, 0) for i in range(7)], none.schema)
    for labels, want in ((none, [0, 0]), (alike, [1, 0])):
        chain = toxicity.fit(docs, labels, ["rude", "threat"])
        got = toxicity.classify(docs, chain, docs.columns)
        assert got.count() == 8 and set(got.columns) == {*docs.columns, "p_threat"}
        assert [[round(r.p_rude), round(r.p_threat)] for r in got.collect()] == [want] * 8
    assert toxicity.classify(docs.limit(0), chain, ["doc_id"]).count() == 0
    assert not toxicity.fit(docs.limit(0), alike, ["rude", "threat"]).vocabulary
