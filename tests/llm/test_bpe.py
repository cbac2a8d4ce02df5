from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import pytest
import regex
from helpers import DATA, documents, odd_rows
from tokenizers import Tokenizer

from footfall.llm import bpe
from footfall.llm.queries import BYTE_BPE, QUERIES

ODD = [
    "", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "I'LL you'll 's", "  a   b\n\n c \t", "a" * 3000, "=-" * 700,
    "՘x \U00031350 9՘", "\x1c\x85\xa0 z", "é ñ ß 漢字 ١٢٣ ² Ⅷ", "\U0010ffff\x00",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lexicon_numbers_words_and_shares_endings(tmp_path):
    words = sorted({b"walking", b"talking", b"walk", b"talk", b"sing", b"\xff\x00a", b"singing"})
    blob = bpe.compile_lexicon(words, lambda ws: [np.arange(len(w), dtype=np.int32) for w in ws])
    (tmp_path / "lexicon").write_bytes(blob)
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.numbers(words).tolist() == list(range(len(words)))
    assert lexicon.numbers([b"wal", b"walkin", b"walkings", b"", b"x" * 99]).tolist() == [-1] * 5
    assert [len(w) for w in words] == np.diff(lexicon.starts).tolist()
    assert len(lexicon.final) < sum(map(len, words)) - 10  # "alking" and "alk" are there once


def test_empty_lexicon(tmp_path):
    (tmp_path / "none").write_bytes(bpe.compile_lexicon([], lambda ws: []))
    assert bpe.Lexicon(str(tmp_path / "none")).numbers([b"a"]).tolist() == [-1]


def test_merges_side_by_side_are_those_of_the_heap():
    merger, rng = bpe.Merger(BYTE_BPE), random.Random(5)
    words = [bytes(rng.choice(b"abcdefinorst e0") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert [ids.tolist() for ids in merger.many(words)] == [merger(w) for w in words]


def test_round_trip_is_the_librarys(spark, library):
    rng = random.Random(1)
    letters = [chr(rng.randrange(32, 0x2FFF)) for _ in range(300)] + list("  eeeaaatttnnn'\n")
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = documents(spark, list(enumerate(texts)))
    name = bpe.build_lexicon(docs, BYTE_BPE, words=200)
    for lexicon in (name, None):
        got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, BYTE_BPE, lexicon), BYTE_BPE).collect()}
        for i, text in enumerate(texts):
            ids = library.encode(text, add_special_tokens=False).ids
            assert got[i].ids == ids, repr(text)
            assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_query_over_a_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op4_bpe_round_trip"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    name = bpe.build_lexicon(docs, BYTE_BPE)
    got = bpe.digest(bpe.decode(bpe.encode(docs, BYTE_BPE, name), BYTE_BPE)).collect()
    assert len(got) == 8 and sum(r.doc_id == 5 for r in got) == 2
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    none = docs.limit(0)
    assert bpe.digest(bpe.decode(bpe.encode(none, BYTE_BPE, bpe.build_lexicon(none, BYTE_BPE)), BYTE_BPE)).count() == 0


def test_bytes_that_are_no_text_are_replaced(spark):
    from pyspark.sql import functions as F

    encoded = spark.createDataFrame([(1, [161, 0]), (2, None)], "doc_id long, ids array<int>").withColumn("x", F.lit(1))
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r.decoded for r in bpe.decode(encoded, BYTE_BPE).collect()}
    assert got == {1: library.decode([161, 0], skip_special_tokens=False), 2: ""}


def test_letters_newer_than_the_library_before_every_contraction(library):
    unsure = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x33480)]) if unicodedata.category(c) == "Cn"]
    unsure = [c for c in unsure if regex.match(r"[\p{L}\p{N}]", c)]
    marks = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'x"]
    texts = [f"{c}{marks[i % 8]} a{c}{marks[(i + 3) % 8]}1{c} {c}" for i, c in enumerate(unsure)]
    texts += [f"{c}{m}" for c in ["Ɤ", "Ᲊ", "\U00010d40", "࢏"] for m in marks] + ["Ɤ", "'s"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    merger, new = bpe.Merger(BYTE_BPE), bpe.newer_ranges()
    for order in (1, -1):  # what was met before makes no difference
        flat, offsets = bpe.Encoder(merger, None, new)(texts[::order])
        got = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got[::order] == want
    assert len(unsure) > 10_000


def test_round_trip_in_one_step_is_the_two_steps(spark):
    docs = documents(spark, list(enumerate(ODD)))
    name = bpe.build_lexicon(docs, BYTE_BPE, words=20)
    both = bpe.decode(bpe.encode(docs, BYTE_BPE, name), BYTE_BPE)
    assert sorted(map(tuple, bpe.round_trip(docs, BYTE_BPE, name).collect())) == sorted(map(tuple, both.collect()))
