"""Spelling variants: words that one inserted, deleted or replaced character turns into each other, found along a trie.

The trie is a table of edges, one set of rows per level; a node is the beginning of the words below it, and an edge carries
all characters down to the next place where words part or end, so there are far fewer levels than characters. A state says
how far a word has been read, at which node, and with how many edits. All states go down one level per join:

* without an edit a word stays on its own path, so these states are the paths that the building of the trie leaves behind;
* at every node of its path a word may replace its next character by a greater one, or leave it out, and go down another
  edge; the smaller and the longer partner of a pair are enough to find it, the other direction is the mirror image;
* with an edit made, the rest must be read exactly, which leaves one edge at most.

An edit is made where a pair first differs, and nowhere else, so every pair is found once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import salted_join
from footfall.sources.staging import stage

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199
#: Edges of a level that are broadcast at most, as bytes of rows. Those of the upper two levels fit (90 letters give no more than
#: 90 and 8,190 of them) unless words are very long, and so do those of the last levels.
FEW_BYTES, ROW_BYTES = 4 << 20, 96


def runs(docs: DataFrame, id_col: str, text: str, min_chars: int, noise: int) -> DataFrame:
    """``word``: all runs of letters in lower case (A-Z alone), one in ``noise`` with a character left out."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run")
    spelt = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found)
    # Few runs have capitals, and only those need the slow way.
    small = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    spelt = spelt.select("id", small.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return spelt.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, min_chars: int, min_count: int) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough; repeats are added up before they are moved."""
    counted = words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def common_chars(a: Column, b: Column) -> Column:
    """How many characters two strings have in common from the start."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs == 0, F.char_length(a).cast("long")).otherwise(differs - 1).cast("int")


def next_char(skip: int = 0) -> Column:
    return F.substr("word", F.col("pos") + 1 + skip, F.lit(1))


@dataclass(frozen=True)
class Level:
    """One level of the trie: ``edges`` (node, first, label, child, child_n, leaf) and the ``paths`` (word, n, pos, node,
    node_n) that come to its nodes and go on. ``child_n`` and ``node_n`` are counts, null where no word ends. ``few`` says whether
    the edges are broadcast."""

    edges: DataFrame
    paths: DataFrame
    few: bool


def are_few(edges: DataFrame) -> bool:
    """Whether the written ``edges`` are at most ``FEW_BYTES`` as rows; files say little, as names of nodes repeat in them."""
    chars = sum((F.octet_length(c) for c in ("node", "label", "child")), F.lit(ROW_BYTES))
    size = edges.agg(F.sum(chars.cast("long")).alias("size")).first().size
    return size is None or size <= FEW_BYTES


def step(states: DataFrame, edges: DataFrame, on: list[str], few: bool) -> DataFrame:
    """States with the edges of their nodes. Few edges go to every task; else the states of one node are dealt to several
    tasks, each with the node's edges. Spark must not choose to broadcast those: it goes by the size of their files, without
    the copies for each task, and the driver would hold them all."""
    if few:
        return states.join(F.broadcast(edges), on)
    return salted_join(states, edges.hint("merge"), on, spread_by=["word"])


def trie(words: DataFrame) -> list[Level]:
    """The levels of the trie of ``words`` (word, n), the root's first. Every round reads each unfinished word once."""
    root = {"pos": F.lit(0), "node": F.lit(""), "node_n": F.lit(None).cast("long")}
    paths, levels = words.select("word", "n", *(c.alias(k) for k, c in root.items())), []
    while not paths.isEmpty():
        # The least word of a branch is its common beginning, if that is a word.
        ends = paths.groupBy("node", next_char().alias("first")).agg(
            F.min(F.struct("word", "n")).alias("least"), F.max("word").alias("most")
        )
        child = F.substr("most", F.lit(1), common_chars(F.col("least.word"), F.col("most")))
        edges = ends.withColumn("child", child).select(
            "node",
            "first",
            F.substr("child", F.char_length("node") + 1).alias("label"),
            "child",
            F.when(F.col("least.word") == F.col("child"), F.col("least.n")).alias("child_n"),
            (F.col("least.word") == F.col("most")).alias("leaf"),
        )
        edges = stage(edges, "trie-edges")
        levels.append(Level(edges, paths, are_few(edges)))
        on = paths.withColumn("first", next_char())
        down = step(on, edges, ["node", "first"], levels[-1].few).where(F.char_length("word") > F.char_length("child"))
        paths = down.select(
            "word", "n", F.char_length("child").alias("pos"), F.col("child").alias("node"), F.col("child_n").alias("node_n")
        )
        paths = stage(paths, "trie-paths")
    return levels


def moved(states: DataFrame, skipped: Column) -> DataFrame:
    """States that are down their edge, with ``skipped`` characters read beside its label; those at the end of their word say
    whether they met one."""
    pos = F.col("pos") + skipped + F.char_length("label")
    done = pos == F.char_length("word")
    return states.where(~done & ~F.col("leaf") | done & F.col("child_n").isNotNull()).select(
        "word", "n", pos.alias("pos"), F.col("child").alias("node"), F.when(done, F.col("child_n")).alias("near_n")
    )


def reads(label: str, skipped: int) -> Column:
    """Whether the word goes on with ``label`` after ``skipped`` characters."""
    return F.substr("word", F.col("pos") + 1 + skipped, F.char_length(label)) == F.col(label)


def one_edit_states(levels: list[Level]) -> Iterable[DataFrame]:
    """Level by level, the states with one edit after that level's edges: ``word, n, pos, node, near_n``, where ``near_n`` is
    the count of the node's word if the state has come to the end of both words."""
    before = None
    for level in levels:
        edges = level.edges.withColumn("tail", F.substr("label", F.lit(2)))
        # The word without its last character: it ends at this node.
        shorter = level.paths.where(F.col("node_n").isNotNull() & (F.col("pos") + 1 == F.char_length("word")))
        found = shorter.select("word", "n", F.char_length("word").alias("pos"), "node", F.col("node_n").alias("near_n"))
        # A word may go down one edge both ways, so the edges are joined once for the two of them.
        aside = step(level.paths, edges, ["node"], level.few).where(F.col("first") != next_char())
        replaced, omitted = (F.col("first") > next_char()) & reads("tail", 1), reads("label", 1)
        ways = F.explode(F.array(F.when(replaced, F.lit(0)), F.when(omitted, F.lit(1)))).alias("skipped")
        edited = aside.where(replaced | omitted).select("*", ways).where("skipped is not null")
        found = found.unionByName(moved(edited, F.col("skipped")))
        if before is not None:
            open_states = before.where("near_n is null").drop("near_n").withColumn("first", next_char())
            kept = step(open_states, edges, ["node", "first"], level.few).where(reads("label", 0))
            found = found.unionByName(moved(kept, F.lit(0)))
        before = stage(found, "trie-states")
        yield before


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words (word, n) one edit apart, in both directions."""
    pairs = [s.where("near_n is not null").select("word", "n", F.col("node").alias("near"), "near_n") for s in one_edit_states(trie(words))]
    if not pairs:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    one_way = reduce(DataFrame.unionByName, pairs)
    names = ["word", "n", "near", "near_n"]
    swapped = F.struct(*(F.col(c).alias(name) for c, name in zip(["near", "near_n", "word", "n"], names, strict=True)))
    return one_way.select(F.explode(F.array(F.struct(*names), swapped)).alias("pair")).select("pair.*")


def last_forms(forms: DataFrame, longest: int) -> DataFrame:
    """``word, root``: where the chain of ``forms`` (word, form) from a word ends, if it has ``longest`` links at most. Each round
    doubles the part of a chain that is known. Nothing is broadcast, as every round reads the forms twice as often."""
    chains = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        later = chains.select(F.col("word").alias("root"), F.col("root").alias("later"))
        chains = chains.join(later.hint("merge"), "root", "left").select("word", F.coalesce("later", "root").alias("root"))
    return chains


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    noise: int = NOISE,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the whole texts.

    Words are runs of letters of at least ``min_chars`` characters that occur ``min_count`` times or more, one run in ``noise``
    with a character left out by the hash of its document and itself. A word's form is its most frequent near word (then the
    least in code-point order), if that is ``ratio`` times as frequent, and its root the last word reached over forms.

    A null or empty text has no words; a null id hashes as no digits; repeated rows count again; other columns are ignored,
    whatever their names. An empty table gives no rows. Words of any length are compared whole.
    """
    if ratio < 2:
        raise ValueError("chains of forms end only if every form is more frequent than the word before it")
    words = stage(word_counts(runs(docs, id_col, text, min_chars, noise), min_chars, min_count), "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left")
    close = -F.col("best.less") >= F.col("n") * ratio
    chosen = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(close, F.col("best.near")).alias("form"),
        F.when(close, -F.col("best.less")).alias("form_n"),
    )
    chosen = stage(chosen, "forms")
    highest = chosen.agg(F.max("form_n").alias("n")).first().n
    longest = 0 if highest is None else math.floor(math.log(highest / min_count, ratio) + 1e-9)
    roots = last_forms(chosen.where(F.col("form").isNotNull()), longest)
    out = chosen.join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
