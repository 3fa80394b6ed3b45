"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it, only where driver and executors are one process, a
    folder of the machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftplane-")
        sc.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage is cut, and the loss of executors
    costs nothing.  Removed when the application ends."""
    spark = df.sparkSession
    to = f"{folder(spark)}/driftplane-{uuid.uuid4().hex}"
    df.write.parquet(to)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(to)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to as many tasks as shuffles have, for work that is dear for each row: a
    small file is one task, however much there is to do for its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
