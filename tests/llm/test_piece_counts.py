from __future__ import annotations

import random

import pytest
import sentencepiece
from helpers import DATA, documents, odd_rows

from footfall.llm.piece_counts import BLANK, Counter, Pieces, token_counts
from footfall.llm.queries import PIECE_BPE, QUERIES


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PIECE_BPE)


@pytest.mark.parametrize("chunk", [3, 17, 16_384])
def test_counts_are_the_librarys(library, pieces, chunk):
    rng = random.Random(chunk)
    vocabulary = [p.replace(BLANK, " ") for p in pieces.score]
    texts = ["", " ", "   a", "a" * 999, " " * 99, "▁a", "x " * 300, "<s></s><unk>", "é\x00z\U0010ffff", "no_blank_at_all" * 40]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    texts += ["".join(rng.choice("  aeinrst\n▁éλ中") for _ in range(rng.randint(1, 50))) for _ in range(400)]
    assert Counter(pieces, chunk)(texts) == [len(ids) for ids in library.encode(texts, num_threads=1)]


def test_merges_are_the_librarys(library, pieces):
    for word in ("▁internationalization", "▁▁▁▁▁", "▁▁a▁"):
        assert pieces.merge(BLANK + word[1:]) == library.encode(word[1:].replace(BLANK, " "), out_type=str)


def test_reset_of_the_states_changes_nothing(library, pieces):
    counter, texts = Counter(pieces, 50), ["the quick brown fox " * 20, "jumps over"]
    want = [len(ids) for ids in library.encode(texts, num_threads=1)]
    assert counter(texts) == want
    counter.counts.clear()
    counter.transducer.reset()
    assert counter(texts) == want


def test_query_over_a_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op7_token_counts"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], num_threads=1))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_odd_rows_and_empty_table(spark, library):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, PIECE_BPE).collect())
    assert got == sorted((i or 0, len(library.encode(t or "", num_threads=1))) for i, t in rows)
    assert token_counts(docs.limit(0), PIECE_BPE).count() == 0
