"""Licence scans: identifier tags and notice phrases of texts, and the value of licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices

# The phrases that every scan reports, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices by the words they are known by.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit license": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "without the prior written permission of the publisher": "reserved",
}
# Tags whose value is an expression; the last two need a sign right after them.
TAGS = ("spdx license identifier", "license expression", "license", "licence")
# How much each licence keeps from those who reuse a text, from nothing (0) to everything (1).
RESTRICTION = {
    "public-domain": 0.0, "unlicense": 0.0, "cc0": 0.0, "mit": 0.1, "isc": 0.1, "zlib": 0.1, "bsd": 0.1, "apache": 0.2,
    "cc-by": 0.2, "artistic": 0.3, "mpl": 0.4, "epl": 0.4, "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.6, "agpl": 0.7,
    "cc-by-nd": 0.7, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "licenseref": 0.9, "reserved": 1.0,
}
#: An exception takes away this share of what the licence keeps.
EXCEPTION = 0.5
#: Operators by how tightly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}

#: A word before its letters are lowered.
_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[^\S\n]*([()]|[A-Za-z0-9.+-]*[A-Za-z0-9+])")
_SIGN = re.compile(r"[\x20\t\"']*[:=][\x20\t\"']*")
#: Bytes of a text to those of its words: A-Z in lower case, every other ASCII sign a blank, the rest as it is.
_WORD_BYTES = bytes(c if chr(c).isdigit() or c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))

PLACES = "array<struct<word:long,label:string,kind:string,restriction:double>>"


def family(identifier: str) -> str | None:
    """The licence that an identifier is a version of: the longest known name that it starts with."""
    parts = re.split(r"[-+]", identifier.lower())
    names = ("-".join(parts[:n]) for n in range(len(parts), 0, -1))
    return next((name for name in names if name in RESTRICTION), None)


def postfix(text: str, start: int = 0) -> list[str]:
    """The expression that begins at ``start``, operators after their operands (shunting yard).

    It ends with its line or with what no expression goes on with: a name after a name, a sign, a closing bracket too many.
    An operator without its right side is dropped, and open brackets are closed at the end.
    """
    out: list[str] = []
    held: list[str] = []
    depth = 0  # brackets that are open
    operand = True  # whether a name or an opening bracket may come next
    at = start
    while token := _TOKEN.match(text, at):
        word, at = token[1], token.end()
        kind = word.lower()
        if operand and kind == "(":
            held.append(kind)
            depth += 1
        elif operand and kind not in BINDS and kind != ")":
            out.append(word)
            operand = False
        elif not operand and kind in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[kind]:
                out.append(held.pop())
            held.append(kind)
            operand = True
        elif not operand and kind == ")" and depth:
            depth -= 1
            while (top := held.pop()) != "(":
                out.append(top)
        else:
            break
    if operand:
        while held and (held[-1] == "(" or operand):
            operand &= held.pop() == "("  # drops the operator that waits for its right side, and brackets opened after it
    return out + [top for top in reversed(held) if top != "("] if out else []


def value(expression: list[str]) -> tuple[set[str], float | None]:
    """Labels and restriction of an expression in postfix order: ``or`` leaves the choice, ``and`` binds to both, ``with`` an
    exception eases. Unknown names have no label and leave the rest as it is."""
    stack: list[tuple[set[str], float | None]] = []
    for token in expression:
        if token not in BINDS:
            label = family(token)
            stack.append((set(), None) if label is None else ({label}, RESTRICTION[label]))
            continue
        right, left = stack.pop(), stack.pop()
        known = [x for x in (left[1], right[1]) if x is not None]
        if token == "with":
            stack.append((left[0] | {"exception"}, left[1] * EXCEPTION) if left[1] is not None else (set(), None))
        else:
            stack.append((left[0] | right[0], (min if token == "or" else max)(known, default=None)))
    return stack[0] if stack else (set(), None)


class Scanner:
    """Places of one text after another."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        kinds = [("tag", dict.fromkeys(TAGS, "")), ("notice", NOTICES), ("base", BASE)]
        for kind, phrases in kinds:
            for phrase, label in phrases.items():
                self.automaton.add_word(f" {phrase} ", (phrase, label, kind))
        self.automaton.make_automaton()

    def __call__(self, raw: bytes) -> tuple[int, list[dict]]:
        words = raw.translate(_WORD_BYTES).split()
        line = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
        places: list[dict] = []
        tags: list[tuple[int, str]] = []
        last, before = 0, 0  # words that begin before position `last` of the line
        for end, (phrase, label, kind) in self.automaton.iter(line):
            before += line.count(" ", last, end)
            last = end
            word = before - phrase.count(" ") - 1
            if kind == "tag":
                tags.append((before - 1, phrase))
            else:
                places.append({"word": word, "label": label, "kind": kind, "restriction": RESTRICTION[label]})
        return len(words), places + (self._tagged(raw, tags) if tags else [])

    def _tagged(self, raw: bytes, tags: list[tuple[int, str]]) -> list[dict]:
        """Labels of the expressions after the tags, given the number of each tag's last word."""
        text = raw.decode("utf-8", "replace")
        ends = [m.end() for m in _ANY_CASE.finditer(text)]
        found: list[dict] = []
        for word, phrase in tags:
            sign = _SIGN.match(text, ends[word])
            if sign:
                labels, restriction = value(postfix(text, sign.end()))
                first = word - phrase.count(" ")
                found += [{"word": first, "label": label, "kind": "tag", "restriction": restriction} for label in sorted(labels)]
        return found


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, places`` of every whole text: where (words counted from 0) each phrase or tag stands, the label it gives,
    its kind (``base``, ``notice`` or ``tag``) and its restriction. A tag whose expression names several licences has a
    place for each, with the restriction of the whole expression.

    Phrases are found by an automaton over the words, all places, overlapping ones too, in one pass. A null or empty text has
    no words and no places. Repeated rows give repeated results; other columns are left out, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        scanner = Scanner()
        shape = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("restriction", pa.float64())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, places = zip(*(scanner(raw or b"") for raw in batch.column("text").to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(places, shape)], ["id", "n_words", "places"]
            )

        return work

    raw = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    return map_slices(raw, make, f"id {kind}, n_words long, places {PLACES}").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last word and labels of the base phrases, all labels, and the highest restriction as the score."""

    def of(places: str | Column, field: str) -> Column:
        return F.transform(places, lambda place: place[field])

    def labels(places: str | Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(of(places, "label"))), ",")

    base = F.filter("places", lambda place: place["kind"] == "base")
    return scanned.withColumns(
        {
            "n_base": F.size(base).cast("long"),
            "first_word": F.array_min(of(base, "word")),
            "last_word": F.array_max(of(base, "word")),
            "base_labels": labels(base),
            "labels": labels("places"),
            "score": F.coalesce(F.array_max(of("places", "restriction")), F.lit(0.0)),
        }
    ).drop("places")
