"""Exact top-k search by inner product: vectors in buckets by length, pruned per bucket from local cosine thresholds."""

from __future__ import annotations

import heapq
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.llm.common import checkpointed, record

#: From this local cosine threshold on, coordinates are tested before products are computed.
COORDINATE_FROM = 0.75
FOCUS = 4
#: Length of a row from which on its products are computed with Python's integers.
WIDE_FROM = float(1 << 31)


def integers(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each finite component as a Python integer, however large."""
    return [math.floor(scale * x) if abs(x) < WIDE_FROM else scale * int(x) for x in vector.tolist()]


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, norm, wide, ints) of vectors whose components are all finite.

    A row is wide if its length is 2**31 or more: then `ints` holds the components as they are, as doubles, and `norm` is
    null; else `ints` holds floor(scale * x) as 64-bit integers, whose products with any other such row fit 63 bits.
    """
    names = ("id", "dim", "norm", "wide", "ints")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.binary()))))

    def scan(batches):
        for batch in batches:
            rows = []
            for vec_id, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if vec_id is None or vector is None or any(x is None for x in vector):
                    continue
                raw = np.array(vector, np.float64)
                if not np.isfinite(raw).all():
                    continue
                if np.abs(raw).max(initial=0) * scale < WIDE_FROM:
                    x = np.floor(scale * raw)
                    norm = float(np.sqrt((x * x).sum()))
                    if norm < WIDE_FROM:
                        rows.append((vec_id, len(x), norm, False, x.astype(np.int64).tobytes()))
                        continue
                rows.append((vec_id, len(raw), None, True, raw.tobytes()))
            if rows:
                yield record(schema, [list(c) for c in zip(*rows)])

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col)
    return picked.mapInArrow(scan, "id long, dim int, norm double, wide boolean, ints binary")


def _packed(rows: DataFrame, keys: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with its vectors packed, longest first: blobs of ids, ints, and the longest and shortest length."""
    order = F.struct(F.negative("norm").alias("n"), "id", "norm", "ints", *extra)
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("rows"))
    return grouped.select(*keys, "rows", F.element_at("rows", 1)["norm"].alias("longest"))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; floats are exact below 2**53, else integers are multiplied."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return np.rint(queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def search_bucket(q_ids, queries, q_norms, floors, ids, rows, norms, k):
    """The `k` best rows of one bucket for each query, as (query position, row position, score), none below its floor.

    A query's floor divided by its length and the bucket's longest is the cosine that a row must reach, at least. Beyond 1
    the bucket is skipped. A low threshold leaves pruning by length: rows, longest first, end where the longest possible
    product falls below the floor. A high one also tests the query's largest coordinates: at cosine t or more to q, a unit
    vector's coordinate lies within sqrt((1 - q_i**2) * (1 - t**2)) of t * q_i, or beyond it towards q_i.
    """
    found = []
    longest = norms[0] if len(norms) else 0.0
    slack = 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = q_norms * longest
        local = np.where(reach > 0, floors / reach, np.where(floors > 0, np.inf, -np.inf))
    lengths = np.where(norms > 0, norms, 1.0)
    plain = np.flatnonzero(local <= COORDINATE_FROM)
    parts = []
    if len(plain):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q_norms[plain] > 0, floors[plain] / q_norms[plain], -np.inf).min()
        upto = int(np.searchsorted(-norms, -need * (1 - slack), side="right")) if need > 0 else len(norms)
        parts.append((plain, np.arange(upto)))
    for i in np.flatnonzero((local > COORDINATE_FROM) & (local <= 1 + slack)):
        upto = int(np.searchsorted(-norms, -floors[i] / q_norms[i] * (1 - slack), side="right"))
        unit = queries[i] / q_norms[i]
        alive = np.arange(upto)
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            t = np.minimum(1.0, floors[i] / (q_norms[i] * lengths[alive]))
            span = np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - t * t)) + 1e-7
            x = rows[alive, f] / lengths[alive]
            alive = alive[np.where(unit[f] >= 0, x >= t * unit[f] - span, x <= t * unit[f] + span)]
        parts.append((np.array([i]), alive))
    for which, alive in parts:
        if not len(alive):
            continue
        score = _products(queries[which], rows[alive])
        for at, i in enumerate(which):
            own = np.flatnonzero((score[at] >= floors[i]) & (ids[alive] != q_ids[i]))
            if len(own) > k:
                cut = np.partition(score[at][own], len(own) - k)[len(own) - k]
                own = own[score[at][own] >= cut]
                own = own[np.lexsort((ids[alive][own], -score[at][own]))[:k]]
            found += [(int(i), int(alive[j]), int(score[at][j])) for j in own]
    return found


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each pair of a query block and a bucket."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def unpack(rows):
        ids = np.array([r["id"] for r in rows], np.int64)
        ints = np.frombuffer(b"".join(r["ints"] for r in rows), np.int64).reshape(len(rows), -1)
        return ids, ints, np.array([r["norm"] for r in rows])

    def scan(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q_rows, rows = (batch.column(c)[at].as_py() for c in ("queries", "rows"))
                q_ids, queries, q_norms = unpack(q_rows)
                ids, ints, norms = unpack(rows)
                floors = np.array([-np.inf if r["floor"] is None else float(r["floor"]) for r in q_rows])
                found = search_bucket(q_ids, queries, q_norms, floors, ids, ints, norms, k)
                if found:
                    i, j, score = (np.array(c) for c in zip(*found))
                    yield record(schema, [pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score.astype(np.int64))])

    return pairs.select("queries", "rows").mapInArrow(scan, "query_id long, vec_id long, score long")


def best_exact(q_ids, queries, ids, rows, k):
    """The `k` best rows for each query, as (query position, row position, score), of products of Python's integers.

    A product that does not fit a 64-bit integer is left out.
    """
    found = []
    for i, query in enumerate(queries):
        scored = []
        for j, row in enumerate(rows):
            score = sum(map(operator.mul, query, row))
            if ids[j] != q_ids[i] and -(1 << 63) <= score < 1 << 63:
                scored.append((-score, int(ids[j]), j))
        found += [(i, j, -score) for score, _, j in heapq.nsmallest(k, scored)]
    return found


def _searched_wide(queries: DataFrame, rows: DataFrame, k: int, scale: int, at_once: int = 256) -> DataFrame:
    """(query_id, vec_id, score) of pairs of which one side at least is wide, in blocks of both; nothing is pruned."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def packed(side: DataFrame, name: str) -> DataFrame:
        # blocks are numbered by dimension and kind, so that a pair of blocks is all wide, all plain or mixed
        counted = side.groupBy("dim", "wide").agg(F.ceil(F.count("*") / at_once).cast("int").alias("blocks"))
        placed = side.join(counted, ["dim", "wide"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        return placed.groupBy("dim", F.col("wide").alias(f"{name}_wide"), "block").agg(F.collect_list(F.struct("id", "ints")).alias(name)).drop("block")

    def unpack(side, wide):
        kind = np.float64 if wide else np.int64
        values = (np.frombuffer(r["ints"], kind) for r in side)
        return [r["id"] for r in side], [integers(v, scale) if wide else v.tolist() for v in values]

    def scan(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                q_rows, rows, q_wide, wide = (batch.column(c)[at].as_py() for c in ("queries", "rows", "queries_wide", "rows_wide"))
                q_ids, q_ints = unpack(q_rows, q_wide)
                ids, ints = unpack(rows, wide)
                found = best_exact(q_ids, q_ints, ids, ints, k)
                if found:
                    yield record(schema, [[q_ids[i] for i, _, _ in found], [ids[j] for _, j, _ in found], [x for _, _, x in found]])

    wide, plain = rows.where("wide"), rows.where("NOT wide")
    pairs = packed(queries, "queries").join(packed(wide, "rows"), "dim")
    pairs = pairs.unionByName(packed(queries.where("wide"), "queries").join(packed(plain, "rows"), "dim"))
    return pairs.select("queries", "rows", "queries_wide", "rows_wide").mapInArrow(scan, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket_rows: int = 2048,
    query_rows: int = 512,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows of highest integer inner product with each query.

    Each component becomes floor(scale * x). Queries are the rows whose id is divisible by `every`; candidates are all
    rows but those with the query's id and with its number of components. Ties go to the smaller id; rows that repeat an
    id and vector count each; fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Products are exact whatever the components; a pair whose product
    does not fit a 64-bit integer is left out, and no other pair is touched by it. Other columns are not read.

    Buckets of about `bucket_rows` rows are ranges of length. The longest bucket of a dimension is searched first; the
    k-th score found there is each query's floor for all others. Blocks of `query_rows` queries meet each bucket that
    their lengths and floors allow; each meeting gives at most `k` rows a query. Rows of length 2**31 or more meet all
    queries, and such queries all rows, in blocks that multiply Python's integers.
    """
    everything = checkpointed(_quantised(vectors, id_col, vector_col, scale))
    asked = everything.where(F.col("id") % every == 0)
    wide = _searched_wide(asked, everything, k, scale) if everything.where("wide").take(1) else None
    rows = everything.where("NOT wide").drop("wide")
    ranges = max(1, math.ceil(rows.count() / bucket_rows))
    ranged = rows.repartitionByRange(ranges, "dim", F.col("norm").desc(), "id").withColumn("bucket", F.spark_partition_id())
    ranged = checkpointed(ranged)
    buckets = _packed(ranged, ("dim", "bucket"))
    firsts = ranged.groupBy("dim").agg(F.min("bucket").alias("first"))
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, math.ceil(queries.count() / query_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    plain = _packed(queries.withColumn("floor", F.lit(None).cast("long")), ("dim", "block"), ("floor",))
    plain = plain.select("dim", "block", F.col("rows").alias("queries"))
    first = _searched(plain.join(firsts, "dim").join(buckets.withColumnRenamed("bucket", "first"), ["dim", "first"]), k)
    first = checkpointed(_best(first, k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor")).distinct()
    ready = _packed(queries.join(floors, "id", "left"), ("dim", "block"), ("floor",))
    ready = ready.select("dim", "block", F.col("rows").alias("queries"))
    # a block meets a bucket unless its lowest floor is out of reach for the longest vectors of both; that is settled by
    # numbers alone, before any vectors are copied
    lowest = F.when(F.count("*") == F.count("floor"), F.min("floor")).alias("lowest")
    asking = queries.select("id", "dim", "block", "norm").join(floors, "id", "left")
    asking = asking.groupBy("dim", "block").agg(lowest, F.max("norm").alias("q_longest"))
    spread = ranged.groupBy("dim").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    asking = asking.join(spread, "dim").where("last > first").withColumn("bucket", F.explode(F.sequence(F.col("first") + 1, F.col("last"))))
    lengths = ranged.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"))
    meetings = asking.join(lengths, ["dim", "bucket"]).where("lowest IS NULL OR q_longest * longest * (1 + 1e-9) >= lowest")
    pairs = meetings.select("dim", "block", "bucket").join(ready, ["dim", "block"]).join(buckets, ["dim", "bucket"])
    found = _searched(pairs, k).unionAll(first.select("query_id", "vec_id", "score"))
    if wide is not None:
        found = found.unionAll(wide)
    best = _best(found, k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
