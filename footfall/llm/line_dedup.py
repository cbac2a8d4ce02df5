"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents arrive in batches, the largest ids first. The keys of a batch are anti-joined with the runs kept so far: a key
that no run holds is new, and its largest document of the batch becomes its holder. The batch then becomes a run of its
own. Runs are bucketed and sorted by hash, so the anti-joins merge them without a shuffle; as soon as a level has
``fanout`` runs they are merged into one of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.sources.staging import stage, staging_path

#: White space at the ends of a line (fixed value).
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case; other letters keep their case."""
    line = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """Two independent hashes, 128 bits together."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


class Runs:
    """Levels of sorted runs of ``h1, h2, n, holder``: documents that hold the key, and the one that keeps it."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, run: DataFrame) -> tuple[str, str]:
        """Name and path of a run as a table in buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = staging_path(self.spark, name)
        dealt = run.select(*KEY, "n", "holder").repartition(self.buckets, *KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _read(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Several runs to merge: read as plain files, as a union of tables in buckets may group them apart."""
        return self.spark.read.schema(self.spark.table(runs[0][0]).schema).parquet(*(path for _, path in runs))

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of ``h1, h2, n, holder``, one row per key. Keys that a run holds already add to the count only."""
        keys = stage(keys.repartition(self.buckets, *KEY), "line-keys")
        new = keys
        for name, _ in self.runs():
            new = new.join(self.spark.table(name), list(KEY), "left_anti")
        if self.runs():
            held = new.select(*KEY, F.lit(True).alias("is_new"))
            keys = keys.join(held, list(KEY), "left").withColumn("holder", F.when(F.col("is_new"), F.col("holder")))
        self._push(0, self._write(keys))

    def _push(self, level: int, run: tuple[str, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(merged(self._read(full))))
            self._forget(full)

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        """Take runs out of the catalog; their files stay in the shared folder until it is discarded."""
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        self._forget(self.runs())
        self.levels = []

    def total(self) -> DataFrame:
        """All runs merged."""
        return merged(self._read(self.runs()))


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


def repeated_lines(
    docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int, batches: int, fanout: int
) -> DataFrame:
    """``id, dropped``: for every document with lines to drop, the hashes of their keys."""
    spark = docs.sparkSession
    key = line_key(F.col("line"))
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc"), F.explode(lines_of(F.col(text))).alias("line"))
        .select("doc", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", *_hashes(F.col("key")))
    )
    lines = stage(lines, "lines")
    cuts = lines.agg(F.percentile_approx("doc", [n / batches for n in range(1, batches)]).alias("cuts")).first().cuts or []
    cuts = sorted(set(cuts))
    runs = Runs(spark, fanout)
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None], strict=True))):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        once = batch.distinct()
        runs.add(once.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc").alias("holder")))
    frequent = stage(runs.total().where(F.col("n") >= min_docs).select(*KEY, "holder"), "frequent-lines")
    runs.close()
    hits = lines.join(frequent, list(KEY)).where(F.col("doc") != F.col("holder"))
    return hits.groupBy("doc").agg(F.collect_set(F.struct(*KEY)).alias("dropped"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 4,
) -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points or more and occurs in ``min_docs`` documents or more, but not
    in the largest document id that holds it.

    All rows and columns are returned, with the lines that stay in ``text`` (an empty text if none stays, or if the text
    was null), ``n_lines`` before and ``n_dropped``, which replace columns of those names. Rows of one id count as one
    document. A row whose id is null counts for no document and keeps all its lines. All lines of a document that have
    the key go, and all stay in its holder.
    """
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    dropped = repeated_lines(docs, id_col, text, min_chars, min_docs, batches, fanout)
    dropped = dropped.select(F.col("doc").alias("__doc"), F.col("dropped").alias("__dropped"))
    rows = docs.select(*keep, F.col(text).alias("__text")).join(dropped, F.col(id_col) == F.col("__doc"), "left")
    h1, h2 = (lambda x: F.xxhash64(line_key(x))), (lambda x: F.xxhash64(F.lit(7), line_key(x)))
    stays = F.filter(
        lines_of(F.col("__text")),
        lambda x: (F.char_length(line_key(x)) < min_chars)
        | ~F.array_contains("__dropped", F.struct(h1(x).alias("h1"), h2(x).alias("h2"))),
    )
    rows = rows.withColumn("__kept", F.when(F.col("__dropped").isNull(), lines_of(F.col("__text"))).otherwise(stays))
    n_lines = F.size(lines_of(F.col("__text"))).cast("long")
    out = {c: F.col(c) for c in keep} | {
        text: F.array_join("__kept", "\n"),
        "n_lines": n_lines,
        "n_dropped": n_lines - F.size("__kept"),
    }
    order = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    return rows.select(*(out[c].alias(c) for c in order))


def digest(kept: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return kept.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: translate(
    trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM docs),
flat AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(keys) AS k FROM keyed) WHERE length(k) >= 40),
often AS (SELECT k, max(doc_id) AS holder FROM flat GROUP BY k HAVING count(*) >= 5),
drops AS (SELECT f.doc_id, list(f.k) AS gone FROM flat f JOIN often o ON f.k = o.k AND f.doc_id <> o.holder GROUP BY 1),
kept AS (
  SELECT y.doc_id, len(lines) AS n_lines,
    CASE WHEN gone IS NULL THEN lines
      ELSE list_transform(list_filter(list_zip(lines, keys), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS stay
  FROM keyed y LEFT JOIN drops USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines, (n_lines - len(stay))::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256
FROM kept
"""
