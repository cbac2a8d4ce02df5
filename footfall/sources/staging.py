"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A local session without it has one temporary folder, removed at its
    end."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    if sc.applicationId not in _local_folders:
        folder = _local_folders[sc.applicationId] = tempfile.mkdtemp(prefix="footfall-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_folders[sc.applicationId]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path for one table of this application."""
    return f"{shared_folder(spark)}/footfall/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove the staged tables of this application, when none of its results is needed any more."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/footfall/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the written copy, so that lost executors do not recompute it."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, keys: list[str], n_buckets: int | None = None) -> DataFrame:
    """Write a table once in sorted buckets of ``keys``: joins, aggregations and windows on them read it without a shuffle.

    The catalog only lends its name while the table is written and resolved; the files stay in the shared folder like those of
    ``stage``. By default there are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", staging_path(spark, name)
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", path).saveAsTable(table)
    written = spark.table(table)
    written.schema  # noqa: B018 - resolved while the name is there
    spark.sql(f"DROP TABLE {table}")
    return written
