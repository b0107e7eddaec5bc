"""Where jobs put what they write and read again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that `spark.checkpoint.dir` names.

    Where that is unset, a session on one machine gets a temporary folder; a cluster has no folder that all its machines
    see, so there it is an error.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-jobs-")
    return f"{shared}/jobs-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def job(spark: SparkSession):
    """What is stored within is removed at the end, when the job's results are written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written once and read back: what several branches of a plan use is computed once, and survives lost executors.

    The folder goes with the innermost job() that is open, or stays until the shared folder is cleared.
    """
    path = shared_folder(df.sparkSession)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Remove what `stored` wrote for `df`, once nothing reads it any more."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if "/jobs-" not in folder:
            raise ValueError(f"no table of a job: {folder}")
        _remove(spark, folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` where it is read in fewer partitions than the session has cores, else as it is.

    For work that costs far more than moving the rows, such as reading source text.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
