"""CSV records with quoted line breaks, found in parallel inside large files.

Whether a line break ends a record depends on the quotes before it, from the start of the file on. Only their parity matters,
and parities add up: one pass counts the quotes of every chunk that Spark cuts a file into, a scan over the chunks tells which
of them begin inside a quoted field, and a second pass then finds the records of all chunks at the same time. What a chunk
holds of a record that it shares with others is put together at the end; that is two rows a chunk at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = ["file", "start"]
WHOLE, TAIL, MIDDLE, HEAD = "whole", "tail", "middle", "head"
BATCH = 4096


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: the bytes of all lines with the chunk that they begin in, in file order within a chunk."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )


def open_chunks(lines: DataFrame) -> DataFrame:
    """``file, start, opened``: whether a chunk begins inside a quoted field. A row per chunk."""
    quotes = F.octet_length("line") - F.octet_length(F.replace(F.col("line").cast("string"), F.lit('"'), F.lit("")))
    counts = lines.groupBy(*CHUNK).agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return counts.select(*CHUNK, opened.alias("opened"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and shared parts of records, chunk after chunk."""
    out: list[tuple] = []
    chunk, lines, inside, first = None, [], False, True

    def close(ended: bool) -> None:
        """Hand on the lines since the last record: a record, or what belongs to one that began earlier or goes on later."""
        nonlocal lines, first
        if lines:
            began = not (first and opened)
            kind = {(True, True): WHOLE, (True, False): TAIL, (False, True): HEAD, (False, False): MIDDLE}[began, ended]
            out.append((*chunk, kind, b"\n".join(lines), first and chunk[1] == 0 and began))
            first = False
        lines = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [*CHUNK, "kind", "record", "header"])

    opened = False
    for batch in batches:
        for name, start, line, odd in zip(*(batch.column(c).to_pylist() for c in (*CHUNK, "line", "opened")), strict=True):
            if (name, start) != chunk:
                if chunk:
                    close(False)
                chunk, opened, inside, first = (name, start), odd, odd, True
            lines.append(line)
            inside ^= bool(line.count(b'"') % 2)
            if not inside:
                close(True)
        if len(out) >= BATCH:
            yield flush()
    if chunk:
        close(False)
    if out:
        yield flush()


def csv_records(spark: SparkSession, path: str, *, header: bool = True) -> DataFrame:
    """``record``: the bytes of every record, without the first of each file if that is a header, and without blank ones.

    Quotes stand around fields, and twice for one quote inside (RFC 4180). A quote that is never closed makes the rest of its
    file one record. Both passes have to see the same chunks: a change of the session's settings between them is an error.
    """
    lines = file_lines(spark, path)
    chunks = open_chunks(lines)
    told = lines.join(F.broadcast(chunks), CHUNK, "left")  # a row per chunk, of 128 MB by default
    known = F.when(F.col("opened").isNull(), F.raise_error(F.lit("a file was cut in another way than before")).cast("boolean")).otherwise(F.col("opened"))
    shape = "file string, start long, kind string, record binary, header boolean"
    parts = told.select(*CHUNK, "line", known.alias("opened")).mapInArrow(_records, shape)
    whole = parts.where(F.col("kind") == WHOLE)
    in_file = W.partitionBy("file").orderBy("start", (F.col("kind") == TAIL).cast("int"))
    shared = parts.where(F.col("kind") != WHOLE).withColumn("number", F.sum((F.col("kind") == TAIL).cast("int")).over(in_file))
    pieces = F.array_sort(F.collect_list(F.struct("start", F.hex("record").alias("hex"))))
    joined = shared.groupBy("file", "number").agg(pieces.alias("pieces"), F.max("header").alias("header"))
    bytes_of = F.unhex(F.array_join(F.transform("pieces", lambda p: p["hex"]), "0A"))
    every = whole.select("record", "header").unionByName(joined.select(bytes_of.alias("record"), "header"))
    body = every.where(~F.col("header")) if header else every
    text = F.col("record").cast("string")
    return body.where(~text.rlike(r"\A[\r\n\t ]*\z")).select("record")


def read_records(spark: SparkSession, path: str, schema: str, *, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A CSV table whose quoted fields may span lines. Any encoding in which a byte below 128 is an ASCII sign or, from 0x30 on,
    a part of a longer one (UTF-8, GBK, GB18030)."""
    text = F.decode("record", encoding)
    row = F.from_csv(F.regexp_replace(text, r"\r\z", ""), schema, {"escape": '"', "multiLine": "true"})
    return csv_records(spark, path, header=header).select(row.alias("row")).select("row.*")
