"""Digests of groups of rows, in the memory of one row."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def group_digest(rows: DataFrame, keys: list[str], line: Column, separator: str) -> DataFrame:
    """(keys, n, digest): how many rows a group has, and the first 8 hex digits of the SHA-1 of its lines, sorted and joined.

    The lines are sorted on their way to the tasks, which feed one after the other to a running hash: no group is gathered,
    whatever its size. A null line counts as empty.
    """
    lines = rows.select(*keys, F.coalesce(line, F.lit("")).alias("line"))
    out = T.StructType([*[lines.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])
    schema = to_arrow_schema(out)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = separator.encode()

    def run(batches):
        now, n, held = None, 0, None
        for batch in batches:
            done = []
            for *key, text in zip(*[batch.column(c).to_pylist() for c in (*keys, "line")]):
                if held is None or key != now:
                    if held is not None:
                        done.append((*now, n, held.hexdigest()[:8]))
                    now, n, held = key, 0, hashlib.sha1()
                if n:
                    held.update(first)
                held.update(text.encode("utf-8", "replace"))
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, n, held.hexdigest()[:8]), schema)], schema=schema)

    return lines.repartition(parts, *keys).sortWithinPartitions(*keys, "line").mapInArrow(run, out)
