"""The pipeline on a whole table, every stage against a plain version of itself on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from helpers import DATA, documents, odd_rows
from test_line_dedup import brute as brute_lines
from test_mixing import words
from test_near_dedup import brute as brute_classes
from tokenizers import Tokenizer

from footfall.llm import arrow, mixing
from footfall.llm.queries import BYTE_BPE, toxic_chain
from footfall.llm.toxicity import Features
from footfall.sources.staging import stage


def test_every_stage_and_the_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps, given = [docs], docs
    for name, function in corpus_pipeline.STAGES:
        given = stage(function(spark, given, DATA), name)
        steps.append(given)
    start, clean, lines, near, mixed, encoded = ([tuple(r) for r in df.collect()] for df in steps)
    assert all(df.columns == corpus_pipeline.COLUMNS for df in steps[:-1])

    chain = toxic_chain(docs, DATA)
    features = Features({f: i for i, f in enumerate(chain.vocabulary)})

    def toxic(text):
        own, p = sorted(features(text or "")), []
        for c, weights in enumerate(chain.weights):
            score = chain.intercepts[c] + weights[own].sum() + sum(a * b for a, b in zip(chain.earlier[c], p, strict=True))
            p.append(score if c == 1 else 1 / (1 + 2.718281828459045 ** -score))
        return p[-1] >= 0

    assert sorted(clean) == sorted(r for r in start if not toxic(r[1])) and len(clean) < len(start)

    kept = {r[0]: r[3] for r in brute_lines([(r[0], r[1]) for r in clean])}
    assert {r[0]: (r[1], *r[2:]) for r in lines} == {r[0]: (kept[r[0]], r[2], r[3], len(kept[r[0]])) for r in clean}

    classes = dict(brute_classes([(r[0], r[1]) for r in lines]))
    assert sorted(near) == sorted(r for r in lines if classes[r[0]] == r[0]) and len(near) < len(lines)

    sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r[0] for r in mixed)
    for r in near:
        sizes[r[3]] += words(r[1])
    for r in mixed:
        taken[r[3]] += words(r[1])
    assert set(mixed) <= set(near) and max(times.values()) <= 3
    for source, target in mixing.shares(dict(sizes)).items():
        assert taken[source] == pytest.approx(target, rel=0.05, abs=60)

    library, want = Tokenizer.from_file(BYTE_BPE), []
    for r in mixed:
        ids = library.encode(r[1], add_special_tokens=False).ids
        digests = (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want.append((r[0], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    assert sorted(encoded) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(want)


def test_odd_rows_and_empty_table(spark):
    given = documents(spark, odd_rows())
    for name, function in corpus_pipeline.STAGES:
        given = stage(function(spark, given, DATA), name)
    found = Counter(r.doc_id for r in given.collect())
    assert found[4] >= 1 and found[1] == found[2] == 1 and found[5] in (2, 4, 6)  # both rows of an id are taken alike
    given = documents(spark, []).limit(0)
    for name, function in corpus_pipeline.STAGES:
        given = stage(function(spark, given, DATA), name)
    assert given.count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    docs = documents(spark, [(i, "x" * 20_000) for i in range(400)]).coalesce(1)

    def size(batches):
        yield pa.RecordBatch.from_pydict({"size": [max(b.nbytes for b in batches)]})

    corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert max(r.size for r in docs.mapInArrow(size, "size long").collect()) < 2 << 20


def test_a_task_gives_back_its_memory(spark, tmp_path, monkeypatch):
    mark = str(tmp_path / "given")
    monkeypatch.setattr(arrow, "give_back", lambda: open(mark, "w").close())
    docs = documents(spark, [(1, "a"), (2, "b")]).coalesce(1)
    found = arrow.map_slices(docs.select("doc_id"), lambda: lambda batch: batch, "doc_id long").collect()
    assert sorted(r.doc_id for r in found) == [1, 2] and (tmp_path / "given").exists()
