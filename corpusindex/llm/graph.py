"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import checkpointed, record

STAR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of `n` nodes' component, by hooking larger roots on smaller and halving paths."""
    root = np.arange(n)
    while len(left):
        x, y = root[left], root[right]
        apart = x != y
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by a star for each of its components."""

    def contract(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        roots = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        leaf = np.flatnonzero(roots != np.arange(len(nodes)))
        yield record(STAR, [pa.array(nodes[leaf]), pa.array(nodes[roots[leaf]])])

    return edges.mapInArrow(contract, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), both long; `component` is the smallest node reachable.

    Rows with a null end and self-loops are skipped; repeated rows count once; an empty table gives an empty table. Every
    partition first replaces its edges by stars; then neighbours are linked to the smallest neighbour, larger ones first,
    until nothing changes. Minima are aggregated before the shuffle, so a hub's edges never have to meet in one task.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = checkpointed(_contracted(edges).distinct())
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select("b", "m").toDF("a", "b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
    leaves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return checkpointed(leaves.unionAll(heads)) if before else spark.createDataFrame([], "node long, component long")
