"""Exact row numbers and fixed-size samples of groups too large for one task.

A group is cut into ordered buckets. Counting the buckets gives each one its offset, and rows are only
sorted inside a bucket, so the widest sort is a bucket and not the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.sources.staging import stage

PREFIX = 3  # hex digits of the hash that name a bucket: 4096 buckets per group


def md5_key(*cols: str) -> Column:
    """Reproducible pseudo-random order: the same in every run, engine and partitioning."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in cols)))


def _offsets(keyed: DataFrame, group: list[str], buckets: list[str]) -> DataFrame:
    """Rows before each bucket within its group; buckets are nested, outermost first."""
    counts = keyed.groupBy(*group, *buckets).agg(F.count("*").alias("_n"))
    out = counts.drop("_n").withColumn("_offset", F.lit(0).cast("long"))
    for depth in range(1, len(buckets) + 1):
        outer, inner = group + buckets[: depth - 1], buckets[depth - 1]
        level = counts.groupBy(*outer, inner).agg(F.sum("_n").alias("_n")) if depth < len(buckets) else counts
        before = W.partitionBy(*outer).orderBy(inner).rowsBetween(W.unboundedPreceding, -1)
        level = level.select(*outer, inner, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        if len(buckets) == 1:
            return level.withColumnRenamed("_before", "_offset")
        out = out.join(level, [*outer, inner]).withColumn("_offset", F.col("_offset") + F.col("_before"))
        out = out.drop("_before")
    return out


def numbered(
    df: DataFrame,
    group: list[str],
    buckets: dict[str, Column],
    order: list[Column],
    alias: str,
    quota: DataFrame | int | None = None,
) -> DataFrame:
    """1-based row number within ``group`` by the (ascending) buckets, then by ``order``.

    ``order`` must make rows distinct within a bucket, and group columns must not be NULL. With a
    ``quota`` (a number, one row per group with column ``quota``, or a single value) only the first ``quota`` rows of a
    group are kept, and buckets wholly beyond it are dropped before any sort.
    """
    names = list(buckets)
    keyed = df.withColumns(buckets)
    offsets = _offsets(keyed, group, names)
    if isinstance(quota, DataFrame) and group:
        offsets = offsets.join(quota, group)
    elif quota is not None:
        limit = quota.scalar() if isinstance(quota, DataFrame) else F.lit(quota)
        offsets = offsets.withColumn("quota", limit.cast("long"))
    if quota is not None:
        offsets = offsets.where(F.col("_offset") < F.col("quota"))
    within = F.row_number().over(W.partitionBy(*group, *names).orderBy(*order))
    out = keyed.join(offsets, [*group, *names]).withColumn(alias, F.col("_offset") + within)
    if quota is not None:
        out = out.where(F.col(alias) <= F.col("quota")).drop("quota")
    return out.drop("_offset", *names)


def first_by_hash(
    df: DataFrame, group: list[str], keys: list[str], quota: DataFrame | int, prefix: int = PREFIX
) -> DataFrame:
    """The first ``quota`` rows of every group in md5 order of ``keys``, which identify a row."""
    hashed = df.withColumn("_md5", md5_key(*keys))
    bucket = {"_bucket": F.substring("_md5", 1, prefix)}
    order = [F.col("_md5"), *(F.col(k) for k in keys)]
    return numbered(hashed, group, bucket, order, "_rn", quota).drop("_md5", "_rn")


def ranked(df: DataFrame, order: list[Column], alias: str = "rank", n_tasks: int | None = None) -> DataFrame:
    """The whole table in ``order``, which makes rows distinct, with its ranks from 1.

    Spark samples the order for boundaries and deals the rows to ranges, each of which is sorted by one task; the sizes of the
    ranges before it make a task's positions ranks. Rows move once, and a range is a small part of the table whatever the
    values are, as the order has no ties. The files are written in the order of the ranks.
    """
    spark = df.sparkSession
    tasks = n_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stage(df, "to_rank").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = stage(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)  # Spark puts the task in front of the position
    position = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"_part": part, "_pos": position}).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per task
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    found = placed.join(F.broadcast(offsets), "_part")
    return found.withColumn(alias, F.col("_offset") + F.col("_pos") + 1).select(*df.columns, alias)
