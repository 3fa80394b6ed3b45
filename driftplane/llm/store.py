"""Tables in, and intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch.  Texts are long: Spark's default of 10,000 rows may be gigabytes.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS, if above."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local master may go without: there
    driver and executors are one process, and a temporary folder is shared by nature."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftplane-")
        sc.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def keep(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, and
    survives the loss of any executor.  Removed when the application ends, or by
    :func:`drop`."""
    spark = df.sparkSession
    bound_batches(spark)
    to = f"{shared_folder(spark)}/driftplane-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*by).parquet(to)
    path = _path(spark, to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path.getParent())
    return spark.read.schema(df.schema).parquet(to)


def drop(df: DataFrame) -> None:
    """Removes what :func:`keep` wrote, once nothing will read it again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = _path(spark, f)
        while path is not None and not path.getName().startswith("driftplane-"):
            path = path.getParent()
        if path is not None:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of least hashed key: a deterministic sample of bounded size."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def labelled(docs: DataFrame, labels: DataFrame, rows: int, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label) of the ``rows`` labelled ids of least hash, one row a different text;
    if ids repeat with different texts, of at most twice as many texts of least hash.  The
    same rows give the same sample, however they are dealt out."""
    some = few_rows(labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").cast("double").alias("label")), "id", rows)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = got.select("id", "h").join(F.broadcast(some), "id").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(2 * rows)
    # as many parts as there are cores: what reads them is Python
    parts = docs.sparkSession.sparkContext.defaultParallelism
    return got.join(F.broadcast(keys), ["id", "h"]).repartition(parts, "id", "h").dropDuplicates(["id", "h"]).select("id", "text", "label")


def only_ids(df: DataFrame, ids: DataFrame, key: str, bound: int = 2_000_000, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (``left_anti``: is not) in ``ids``.  The ids are counted:
    up to ``bound`` they are broadcast, beyond it the join shuffles."""
    return df.join(F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids, key, how)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """While open, Arrow batches have few rows: for jobs run inside whose rows are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def doomed(spark: SparkSession, folder: str) -> str:
    """A folder that goes when the application ends."""
    path = _path(spark, folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
