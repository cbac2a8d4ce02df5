"""Fill-in-the-middle transformation: a text is cut at two seeded places and written in another order."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices, texts

#: What stands before the prefix, the suffix and the middle. A text that holds one of them stays as it is, so an output can
#: always be read back: no marker ends with a character that it begins with.
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
CODE_POINT = "."
#: Percentages: texts that are cut at all, and those among them whose suffix stands first.
CUT, SUFFIX_FIRST = 90, 20
FORMS = "n long, form string, prefix_chars long, middle_chars long, output string"


def seeds(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(pattern: str) -> regex.Pattern:
    """Any number of ``pattern`` in one group, which keeps the end of every repetition."""
    return regex.compile(f"({pattern})*", regex.DOTALL)


def transform(text: str, whole: regex.Pattern, h: list[int], cut: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """``n, form, prefix_chars, middle_chars, output`` of one text.

    One full match gives the ends of all units; the number of units and both offsets are read off that list.
    """
    match = whole.fullmatch(text)
    if match is None:
        raise ValueError("the pattern of a unit does not cover every text")
    ends = match.ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= cut or any(mark in text for mark in MARKERS):
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    ends.append(0)  # the end before the first unit, at position -1
    a, b = ends[first - 1], ends[last - 1]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    unit: str = CODE_POINT,
    seed: int = 1,
    cut: int = CUT,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every whole text; ``unit`` is the regular expression of what is
    never cut apart, and ``n`` the number of units.

    A null text is an empty one, which stays plain with ``n`` 0. A null id has a seed of its own. The cuts depend on the id
    and the text alone: repeated rows give equal results. Other columns are left out, whatever their names. A task holds
    the ends of one text at a time, some 130 bytes a unit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    seeded = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.array(*seeds(id_col, seed)).alias("h"))

    def make():
        whole = units(unit)
        names = [part.split()[0] for part in FORMS.split(", ")]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            drawn = batch.column("h").to_pylist()
            rows = [transform(t, whole, h, cut, suffix_first) for t, h in zip(texts(batch), drawn, strict=True)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(column, k) for column, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *names])

        return work

    return map_slices(seeded, make, f"id {kind}, {FORMS}").withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from, read from the output and its form alone."""

    def between(left: str, right: str | None) -> Column:
        start = F.locate(left, output) + len(left)
        rest = F.substr(output, start)
        return rest if right is None else F.substr(output, start, F.locate(right, output) - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """Digests of the output and of the restored text in place of the output."""
    shown = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("form"), F.col("output"))}
    return cut.withColumns({name: F.sha2(value, 256) for name, value in shown.items()}).drop("output")


ORACLE_SQL = """with h as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as d
    from documents),
seeded as (select *, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
    cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4 from h),
formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90
    then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from seeded),
parts as (select *, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from formed)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars,
    case when form <> 'plain' then b - a end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(text) as restored_sha256 from parts"""
