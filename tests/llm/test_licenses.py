from __future__ import annotations

import random
import re

from helpers import DATA, documents, odd_rows

from footfall.llm.licenses import BASE, BINDS, NOTICES, RESTRICTION, digest, family, postfix, scan, value
from footfall.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(lowered(text))


def stands(words, phrases):
    return sorted((i, label) for i in range(len(words)) for p, label in phrases.items() if words[i : i + len(p.split())] == p.split())


def check(row, text):
    words = words_of(text)
    base = stands(words, BASE)
    starts = [i for i, _ in base]
    found = (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels)
    assert found == (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base}))), text
    notices = {label for _, label in [*base, *stands(words, NOTICES)]}
    labels = set(row.labels.split(",")) - {""}
    assert notices <= labels and 0 <= row.score <= 1
    if not re.search(r"licen[sc]e(-expression|-identifier)?[\s\"']*[:=]", lowered(text)):
        assert labels == notices
        assert row.score == max((RESTRICTION[x] for x in notices), default=0.0)


def run(spark, rows):
    return digest(scan(documents(spark, rows)))


def test_base_and_notices_against_brute_force(spark):
    rng = random.Random(12)
    bits = "CC BY by cc NC sa General Public License all ALL rights reserved reserved. MIT mit Apache lesser é漢 ſ K K 4.0 _ - , \n Licence".split(" ")
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "-", "\t", "", " ", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for r in run(spark, list(enumerate(texts))).collect():
        check(r, texts[r.doc_id])


def test_places_overlap_and_repeat(spark):
    text = "CC BY cc by CC-BY-NC-SA; lesser General Public License. ALL RIGHTS RESERVED"
    row = scan(documents(spark, [(1, text)])).first()
    assert [(p.word, p.label) for p in row.places if p.kind == "base"] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by"), (9, "gpl"), (12, "reserved")]
    assert {(p.word, p.label) for p in row.places if p.kind == "notice"} == {(4, "cc-by-nc"), (4, "cc-by-nc-sa"), (8, "lgpl")}


def test_expressions(spark):
    cases = {
        "MIT": ("mit", 0.1),
        "MIT OR GPL-3.0-only": ("gpl,mit", 0.1),
        "MIT AND GPL-3.0-only": ("gpl,mit", 0.6),
        "GPL-2.0+ WITH Classpath-exception-2.0": ("exception,gpl", 0.3),
        "MIT AND GPL-2.0 WITH x OR AGPL-3.0": ("agpl,exception,gpl,mit", 0.3),
        "mit and (gpl-2.0 or agpl-3.0)": ("agpl,gpl,mit", 0.6),
        "(MIT OR Apache-2.0) AND (CC-BY-NC-4.0": ("apache,cc-by,cc-by-nc,mit", 0.8),  # cc-by is a base place
        "MIT) OR AGPL-3.0": ("mit", 0.1),
        "MIT OR": ("mit", 0.1),
        "MIT OR (": ("mit", 0.1),
        "MIT OR (GPL-2.0 AND": ("gpl,mit", 0.1),
        "MIT and more": ("mit", 0.1),
        "MIT GPL-2.0": ("mit", 0.1),
        "OR MIT": ("", 0.0),
        "()": ("", 0.0),
        "unheard-of": ("", 0.0),
        "unheard-of AND MIT": ("mit", 0.1),
        "LicenseRef-ours": ("licenseref", 0.9),
        "": ("", 0.0),
        "MIT OR\nGPL-2.0": ("mit", 0.1),
    }
    texts = [f"// é SPDX-License-Identifier: {e}\nint main" for e in cases]
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in run(spark, list(enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(cases.values())


def test_tags_need_a_sign(spark):
    texts = ['"license": "MIT",', "License = Apache-2.0", "license MIT", "Licence: (ISC OR MPL-2.0)", "License-Expression: EPL-2.0", "no license: none", "licenses: MIT"]
    got = {r.doc_id: r.labels for r in run(spark, list(enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == ["mit", "apache", "", "isc,mpl", "epl", "", ""]


def descend(tokens):
    """Restriction and labels by recursive descent, for whole expressions."""

    def part(level):
        if level == 4:
            if tokens[0] == "(":
                tokens.pop(0)
                out = part(1)
                tokens.pop(0)
                return out
            label = family(tokens.pop(0))
            return ({label}, RESTRICTION[label]) if label else (set(), None)
        left = part(level + 1)
        while tokens and BINDS.get(tokens[0]) == level:
            op, right = tokens.pop(0), part(level + 1)
            if op == "with":
                left = (left[0] | {"exception"}, left[1] / 2) if left[1] is not None else (set(), None)
            else:
                known = [x for x in (left[1], right[1]) if x is not None]
                left = (left[0] | right[0], ((min if op == "or" else max)(known) if known else None))
        return left

    return part(1)


def test_shunting_yard_against_recursive_descent():
    rng = random.Random(7)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["mit", "gpl-2.0", "apache-2.0", "strange", "cc-by-nc-4.0", "mpl-2.0"])
        left, right, op = made(depth - 1), made(depth - 1), rng.choice(["and", "or", "with"])
        return f"( {left} ) {op} {right}" if rng.random() < 0.5 else f"{left} {op} ( {right} )" if rng.random() < 0.5 else f"{left} {op} {right}"

    for _ in range(2000):
        text = made(5)
        assert value(postfix(text)) == descend(text.split()), text


def test_long_expressions_take_linear_time():
    n = 100_000
    assert value(postfix("(" * n + "mit" + ")" * n)) == ({"mit"}, 0.1)
    assert value(postfix("mit or " * n + "gpl")) == ({"mit", "gpl"}, 0.1)


def test_odd_rows_and_empty_table(spark):
    rows = [*odd_rows(), (7, "All rights reserved"), (7, "All rights reserved")]
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    by_text = dict(rows)
    for r in got:
        check(r, by_text[r.doc_id])
    assert run(spark, []).limit(0).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert run(spark, []).count() == 0
    clash = spark.createDataFrame([("a", "cc by", 1, "x")], "doc_id string, text string, places int, id string")
    assert digest(scan(clash)).first().base_labels == "cc-by"


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op12_licenses"](spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        check(r, docs[r.doc_id])
    assert sum(r.n_base for r in got) > 0
