from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, odd_rows, prose
from pyspark.sql import functions as F

from footfall.llm import near_dedup
from footfall.llm.arrow import BYTES, slices
from footfall.llm.graph import components
from footfall.llm.near_dedup import (
    Bags,
    Shingler,
    bucket_links,
    close_members,
    flat_bags,
    mixed,
    near_duplicates,
    overlap,
    signature,
    signatures,
)


def bag(counts):
    """One bag of the given counts."""
    keys = mixed(np.arange(len(counts), dtype=np.uint64))
    order, counts = np.argsort(keys), np.array(counts)
    order = order[counts[order] > 0]
    return Bags(np.zeros(len(order), np.int64), keys[order], counts[order], 1)


def test_signatures_estimate_weighted_jaccard():
    rng, size = np.random.default_rng(1), 4000
    for low, high in ((0, 2), (0, 4), (1, 20)):
        x = rng.integers(low, high, 60)
        y = np.where(rng.random(60) < 0.3, rng.integers(low, high, 60), x)
        common, union = overlap(bag(x)[0], bag(y)[0])
        same = (signature(bag(x), size) == signature(bag(y), size)).mean()
        assert same == pytest.approx(common / union, abs=4 * np.sqrt(0.25 / size))


def test_components_of_signatures_are_exponential():
    times = signature(bag([3, 1, 5, 7]), 20_000)[0] * 16
    assert times.mean() == pytest.approx(1, abs=0.03) and np.median(times) == pytest.approx(np.log(2), abs=0.03)


def test_short_texts_repeated_shingles_and_batches():
    bag_of, batch = Shingler(), ["word", "Two words", "", "a b c d e", "x " * 500, "  ", "a b c d e f"]
    bags = bag_of(batch)
    found = signature(bags, 120)
    assert np.isfinite(found).all(axis=1).tolist() == [bool(t.strip()) for t in batch]
    for i, text in enumerate(batch):  # a text's bag and signature do not depend on its batch
        alone = bag_of([text])
        assert all((x == y).all() for x, y in zip(bags[i], alone[0], strict=True)) and (signature(alone, 120)[0] == found[i]).all()
    assert [len(bags[i][0]) for i in range(len(batch))] == [1, 1, 0, 1, 1, 0, 2] and bags[4][1].tolist() == [496]
    assert overlap(bag_of(["One two, THREE"])[0], bag_of(["one two three"])[0]) == (1, 1)
    assert bag_of([]).n == 0 and signature(bag_of([]), 8).shape == (0, 8)


def brute(rows, similarity=0.8):
    bag_of = Shingler()
    bags = [(i, bag_of([t or ""])[0]) for i, t in rows]
    parent = {i: i for i, _ in bags if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if None not in (i, j) and len(a[0]) and len(b[0]):
                common, union = overlap(a, b)
                if common >= similarity * union:
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return sorted(((i, i if i is None else root(i)) for i, _ in bags), key=str)


def told(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def changed(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed%d" % rng.randint(0, 10**6)
    return " ".join(words)


def test_against_brute_force(spark):
    rows, shared = [], prose(999, 60)
    for g in range(12):
        text = prose(g, 300)
        rows += [(100 * g + c, changed(text, c % 8, 50 * g + c)) for c in range(8)]  # chains of near copies
        rows += [(100 * g + 20, text), (100 * g + 21, text.upper()), (100 * g + 22, text + " .")]
        rows += [(100 * g + 30 + k, shared + " " + prose(7000 + 10 * g + k, 25)) for k in range(6)]  # a common passage
    random.Random(1).shuffle(rows)
    rows += [(None if i is None else 5000 + i, t) for i, t in odd_rows() if i != 5]
    assert told(near_duplicates(documents(spark, rows))) == brute(rows)


def test_a_class_is_found_over_a_bucket_with_many_hubs(spark):
    """Documents that share a passage meet in buckets; more of them than hubs are not alike."""
    shared = prose(1, 200)
    rows = [(i, shared + " " + prose(100 + i, 120)) for i in range(40)]
    rows += [(1000 + i, t + " end") for i, t in rows[20:]]
    assert told(near_duplicates(documents(spark, rows), bands=60, rows=2)) == brute(rows)


def test_a_large_group_of_alike_but_not_similar_texts(spark):
    """Signatures of the group are alike, its texts are not: tasks return trees of what is linked, however they are cut."""
    shared = prose(3, 200)
    rows = [(i, shared + " " + prose(500 + i, 36)) for i in range(120)]
    rows += [(1000 + i, t + " more words") for i, t in rows[::3]]  # near copies of some
    rows += [(2000, "x " * 5000), (2001, "x " * 4500), (2002, "x " * 3000)]  # one shingle, by its number
    docs = documents(spark, rows)
    expected = brute(rows)
    assert len({c for _, c in expected}) == 120 + 2
    assert told(near_duplicates(docs)) == expected
    sketch = signatures(docs, "doc_id", "text")
    profiles = sketch.select("doc", "mini", "bands", "weight")
    members = sketch.select(F.col("doc").alias("rep"), F.col("doc").alias("component"), "weight", F.explode("bands").alias("key"))
    bags = flat_bags(docs.selectExpr("doc_id AS doc", "text"), 5)
    for chunk, load in ((2048, 1 << 20), (25, 1 << 20), (2048, 4000)):
        close = close_members(members, profiles, 0.8, chunk, load)
        got = bucket_links(close, bags, 0.8).collect()
        assert len(got) <= close.count()
        parts = {r.id: r.component for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
        assert sorted((i, parts.get(i, i)) for i, _ in rows) == sorted(expected)
        if chunk == 2048 and load > 4000:  # the first bucket of each pair alone has it, so no link is there twice
            assert len(got) == len(rows) - len({c for _, c in expected})


def test_kept_rows_repeats_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    got = near_duplicates(docs).collect()
    assert len(got) == 8 and all(r.kept for r in got)
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in loops}
    assert max(Counter(got.values()).values()) >= 71
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("step", ["signatures", "flat_bags"])
def test_a_task_needs_little_memory_for_a_large_batch(spark, monkeypatch, step):
    """Workers of all stages stay alive beside the JVM, and memory that was once taken stays with them."""
    rng = random.Random(3)
    words = [f"w{i:04d}" for i in range(5000)]
    batch = pa.table({"doc": list(range(1500)), "text": [" ".join(rng.choices(words, k=600)) for _ in range(1500)]}).to_batches()[0]
    held = {}

    def keep(df, make, schema, size=BYTES):
        held.update(work=make(), size=size)

    monkeypatch.setattr(near_dedup, "map_slices", keep)
    docs = spark.createDataFrame([(1, "a")], "doc int, text string")
    signatures(docs, "doc", "text") if step == "signatures" else flat_bags(docs, 5)
    tracemalloc.start()
    made = 0
    for piece in slices(batch, size=held["size"]):
        made += held["work"](piece).num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 1500 and peak < 100 << 20
