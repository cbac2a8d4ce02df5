"""Small files that the driver makes and every executor reads from its own disk."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from footfall.sources.staging import shared_folder

#: A published file is a fixed-size table, never something that grows with the data.
MOST_BYTES = 64 << 20


def publish(spark: SparkSession, data: bytes, name: str) -> str:
    """Write bytes to the shared folder and let Spark copy them to each executor; ``SparkFiles.get`` finds the name.

    An executor that joins later, after a loss, fetches the file again from the shared folder.
    """
    if len(data) > MOST_BYTES:
        raise ValueError(f"{name} has {len(data)} bytes; published files are bounded by {MOST_BYTES}")
    sc = spark.sparkContext
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/footfall/{sc.applicationId}/{name}"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    sc.addFile(path)
    return name
