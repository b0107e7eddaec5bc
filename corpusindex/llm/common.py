"""Helpers that several operators share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the cluster's shared checkpoint folder.

    The folder is the one that `spark.checkpoint.dir` names. Where that is unset, a session on one machine gets a temporary
    folder; a cluster has no folder that all its machines see, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches, max_bytes: int = 8 << 20):
    """The record batches cut into pieces of about `max_bytes`, one row at least, so that a task's memory stays small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by `keys` and sorted by them within each partition, for `grouped`."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def grouped(batches, keys: int):
    """The rows of sorted batches in groups of equal values in the first `keys` columns: (key, table), one at a time."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            now = tuple(batch.column(i)[int(a)].as_py() for i in range(keys))
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


ROW_KEY = ("k_id", "k_named", "k_key")


def quoted(name: str):
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_rows(docs: DataFrame, text_key=None) -> DataFrame:
    """`docs` with each row as a struct `row` and the columns ROW_KEY, never null, of its id and text.

    Joins and windows on the same plain columns need the texts shuffled once only. `text_key` stands for the hash of the
    text where rows are to be told apart by more.
    """
    doc_id = F.col("doc_id").cast("long")
    row = F.struct(*[quoted(n) for n in docs.columns]).alias("row")
    return docs.select(row, *row_key(doc_id, F.xxhash64("text") if text_key is None else text_key))


def row_key(doc_id, text_key) -> list:
    return [F.coalesce(doc_id, F.lit(0)).alias("k_id"), doc_id.isNotNull().alias("k_named"), text_key.alias("k_key")]


def row_hash():
    """A hash of all columns of the struct `row`, of which map columns could not be hashed otherwise."""
    return F.xxhash64(F.to_json("row"))
