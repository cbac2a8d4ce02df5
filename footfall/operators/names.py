"""Finding which of many names stand in a text, by an index of the names' rarest pieces.

Every name is filed under one of its pieces of ``GRAM`` characters (a shorter name under itself), the one that is rarest in
the texts. A text is cut into its pieces, the pieces meet the index, and only the few names filed there are looked for. The
work per text grows with its length and not with the number of names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import SHORT_LIST, maybe_in, salted_join, split_hot_keys
from footfall.sources.staging import stage

GRAM = 3
#: Texts from which the rarity of pieces is estimated. It decides where a name is filed, never what is found.
SAMPLE_TEXTS = 10_000

# Signs that a pattern gives a meaning to, and those that make the sign before them optional.
META, OPTIONAL = set("\\.^$|?*+()[]{}"), set("?*{")


def pieces(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters, in one pass over the text."""
    chars = F.split(text, "")

    def piece(char: Column, i: Column) -> Column:
        rest = [F.get(chars, i + k) for k in range(1, size)]
        return F.concat(char, *rest)  # null beyond the end

    return F.array_distinct(F.filter(F.transform(chars, piece), lambda p: F.char_length(p) == size))


def all_pieces(text: Column, sizes: Iterable[int]) -> Column:
    """The distinct pieces of every size but 0."""
    return F.concat(F.array().cast("array<string>"), *(pieces(text, size) for size in sizes if size))


def required_text(pattern: str) -> str:
    """The longest piece of text that whatever matches a pattern must hold; empty if none is certain.

    Alternatives, groups, settings and escapes may leave nothing that must occur, so a pattern with one of them has no such text.
    """
    if set("|(\\") & set(pattern):
        return ""
    outside = re.sub(r"\{[^}]*\}", "{", re.sub(r"\[\^?\]?[^\]]*\]", "[", pattern))
    found, run = [""], ""
    for sign, after in zip(outside, outside[1:] + " ", strict=False):
        if sign in META or after in OPTIONAL:
            found.append(run)
            run = ""
        else:
            run += sign
    return max([*found, run], key=len)


def _required(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in batches:
        yield names.map(required_text)


def _filed(names: DataFrame, texts: DataFrame, sample: int) -> DataFrame:
    """``appname, gram``: the piece of every name's certain text (``sure``) under which it is filed."""
    held = F.when(F.char_length("sure") < GRAM, F.array("sure")).otherwise(pieces(F.col("sure"), GRAM))
    offered = names.select("appname", F.explode(held).alias("gram"))
    said = texts.limit(sample).toPandas()  # a bounded list, read from as few files as it takes
    said = texts.sparkSession.createDataFrame(said, texts.schema)
    heard = F.explode(all_pieces(F.col(texts.columns[0]), range(1, GRAM + 1))).alias("gram")
    common = said.select(heard).groupBy("gram").agg(F.count("*").alias("texts"))
    shared = offered.groupBy("gram").agg(F.count("*").alias("names"))
    rarity = shared.join(common, "gram", "left").select("gram", F.coalesce("texts", F.lit(0)).alias("texts"), "names")
    best = F.min(F.struct("texts", "names", "gram")).alias("best")
    rated = salted_join(offered, rarity, ["gram"], spread_by=["appname"])
    return rated.groupBy("appname").agg(best).select("appname", F.col("best.gram").alias("gram"))


def names_in_texts(
    rows: DataFrame,
    text: str,
    names: DataFrame,
    owners: DataFrame,
    *,
    regex: bool = False,
    sample: int = SAMPLE_TEXTS,
    short_list: int = SHORT_LIST,
) -> DataFrame:
    """Each row once for every name (``appname``) that its text holds; ``regex`` reads names as patterns.

    A row whose text is null holds no name, and a null name is never found. Texts stay where they are read while the index is
    small enough for Spark to broadcast it; beyond that a text moves once for each of its pieces that may be in the index, and
    a piece that very many texts share is dealt to several tasks. An empty name and a pattern that needs no certain text
    (``.*``) have no piece: they are tried on the rows of their ``owners`` (imei, appname).
    """
    found: Callable[[Column, Column], Column] = F.rlike if regex else F.contains
    sure = F.pandas_udf(_required, "string")(F.col("appname")) if regex else F.col("appname")
    known = names.where(F.col("appname").isNotNull()).select("appname").distinct().withColumn("sure", sure)
    filed = stage(_filed(known, rows.select(text).where(F.col(text).isNotNull()), sample), "name-index")
    sizes = sorted(r[0] for r in filed.select(F.char_length("gram")).distinct().collect())  # from 0 to GRAM
    columns = rows.columns
    cut = rows.select("*", F.explode(all_pieces(F.col(text), sizes)).alias("gram"))
    if filed.limit(short_list + 1).count() > short_list:
        cut = cut.where(maybe_in(filed, "gram"))
    met = salted_join(cut, filed, ["gram"], spread_by=columns)
    hits = met.where(found(F.col(text), F.col("appname"))).select(*columns, "appname")
    if 0 not in sizes:
        return hits
    pairs = owners.join(filed.where(F.col("gram") == ""), "appname").select("imei", "appname").distinct()
    tried = split_hot_keys(rows, pairs, ["imei"]).where(found(F.col(text), F.col("appname")))
    return hits.unionByName(tried.select(*columns, "appname"))
