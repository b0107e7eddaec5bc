"""Mixing sources to target weights: each source's word budget is met by fitting a subset of document sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.llm.common import ROW_KEY, checkpointed, keyed_rows, record, row_hash, row_key, shuffle_partitions, sliced
from corpusindex.llm.words import word_counts

#: Remainder, in words, that the dynamic programme fits; twice the longest document where that is more.
DP_WORDS = 1 << 16
#: Bits (words fitted times lengths) up to which the part that is fitted is doubled while the budget is missed.
EXACT_BITS = 1 << 30
#: Documents of one source and size that are ranked together.
RANKED = 4096


def _fitted(size: np.ndarray, have: np.ndarray, goal: int) -> tuple[int, np.ndarray]:
    """The largest sum of at most `have` of each size that is no more than `goal`, and how many of each give it."""
    reach, mask, steps = 1, (1 << (goal + 1)) - 1, []
    for i in range(len(size)):
        left, width = int(min(have[i], goal // size[i])), int(size[i])
        if left <= 0:
            continue
        steps.append((i, reach))
        chunk = 1
        while left:
            chunk = min(chunk, left)
            reach |= (reach << (chunk * width)) & mask
            left -= chunk
            chunk *= 2
        if reach >> goal & 1:
            break
    best = at = reach.bit_length() - 1
    used = np.zeros(len(size), object)
    for i, before in reversed(steps):
        while not before >> at & 1:
            at -= int(size[i])
            used[i] += 1
    return best, used


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near `budget` from below as can be.

    First every length gives its proportional share; then the longest that fit go in until about `dp_words` words, or
    twice the longest document, remain; bounded-knapsack dynamic programming over the reachable sums, kept as the bits of
    an integer, fits those. While that misses the budget by more than a remainder that no documents can fill, documents are
    given back and twice as many words fitted, up to the whole budget from all documents, or to EXACT_BITS of work.
    """
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(object), counts[order].astype(object)
    total = int(sum(size * have))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    share = np.array([int(h) * budget // total for h in have], object)
    unfillable = budget % math.gcd(*[int(x) for x in size])
    wide = max(dp_words, 2 * int(size[0]))
    opened, missed, kept = 0, budget, np.zeros(len(size), object)
    while missed > unfillable:
        take = np.array([int(s) * (budget - opened) // budget for s in share], object)
        rest, most = budget - int(sum(size * take)), max(wide, opened)
        for i in range(len(size)):
            if rest > most:
                more = min(have[i] - take[i], (rest - most) // size[i])
                take[i] += more
                rest -= more * size[i]
        best, used = _fitted(size, have - take, int(rest))
        if rest - best < missed:
            missed, kept = int(rest - best), take + used
        if opened >= budget or max(wide, 2 * opened) * len(size) > EXACT_BITS:
            break
        opened = min(budget, max(wide, 2 * opened))
    out = np.zeros(len(lengths), np.int64)
    out[order] = kept.astype(np.int64)
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, key, size): `key` tells texts apart."""
    picked = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("key", pa.int64()), ("size", pa.int64())])

    def count(batches):
        for batch in sliced(batches):
            yield record(schema, [*batch.columns[:3], pa.array(word_counts(batch.column(3)))])

    return checkpointed(picked.mapInArrow(count, "id long, source string, key long, size long"))


def _ranked_sources(sized: DataFrame) -> DataFrame:
    """(source, source_size, place): sources by code point, null last, numbered from 0 over all range partitions."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(shuffle_partitions(sized.sparkSession), order)
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = heads.alias("x").join(heads.alias("y"), F.col("y.part") < F.col("x.part"), "left")
    before = before.groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(order)
    placed = ranged.join(before, "part").select(
        "source", "source_size", (F.col("before") + F.row_number().over(within) - 1).alias("place")
    )
    return checkpointed(placed)


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources in order; no target exceeds `most` times its source.

    The words that a capped source can't take are shared among the others by weight until none is above its cap. Only
    sums travel to the driver in each step.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = _ranked_sources(sized).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        found = sources.agg(
            F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))
        ).first()
        if found[0] == capped or not found[2]:
            break
        capped, level = found[0], (total - found[1]) / found[2]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return sources.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    most: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of `docs`: id, source, key, size, source_size, target, times, taken.

    `size` is the number of words (0 for a null or empty text), `target` the words that the row's source should give and
    `times` how often the mix takes the row, at most `most`; `taken` is size * times. Every row of a source is taken as
    often as its target holds the whole source; what is left of the target, a whole number of words below the source's
    size, is met by taking some rows once more: rows are counted by size, the counts are fitted to the budget and, for
    each size, the rows first in a seeded order of ids are taken. Rows with equal ids and sizes are alike, so it does not
    matter which of them is taken. A null source is a source of its own, the last. Rows without words are never taken.
    `key` is a hash of the text. Other columns are not read; an empty table gives an empty table.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    targets = source_targets(sized, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "budget",
        F.when(F.col("whole") < most, F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5)).otherwise(0).cast("long"),
    )
    targets = checkpointed(targets)
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("rows"))
    with_budget = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(sizes.source, "size", "rows", "budget")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        take = fit_counts(frame["size"].to_numpy(), frame["rows"].to_numpy(), int(frame["budget"].iloc[0]))
        return frame[["source", "size", "rows"]].assign(take=take)

    fitted = checkpointed(
        with_budget.groupBy("source").applyInPandas(fit, "source string, size long, rows long, take long").where("take > 0")
    )
    # ranks are taken within slices of a size's rows by hash, so that no size has to meet in one task
    slices = F.ceil(F.col("rows") / RANKED).cast("long")
    place = F.xxhash64(F.lit(seed), "id")
    slice_of = F.pmod(F.shiftrightunsigned(place, 20), F.col("slices"))
    joined = sized.alias("d").join(
        fitted.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.size") == F.col("f.size")), "left"
    )
    joined = joined.select("d.*", "rows", F.coalesce("take", F.lit(0)).alias("take"), F.coalesce(slices, F.lit(1)).alias("slices"))
    joined = joined.withColumn("place", place).withColumn("slice", slice_of)
    keyed = Window.partitionBy("source", "size").orderBy("slice")
    partial = joined.where("take > 0 AND take < rows")
    before = partial.groupBy("source", "size", "slice").agg(F.count("*").alias("n"))
    before = before.select("source", "size", "slice", (F.sum("n").over(keyed) - F.col("n")).alias("before"))
    before = before.toDF("s_source", "s_size", "s_slice", "before")
    within = Window.partitionBy("source", "size", "slice").orderBy("place", "id", "key")
    ranked = partial.join(
        before,
        F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("slice") == F.col("s_slice")),
    )
    ranked = ranked.withColumn("more", (F.col("before") + F.row_number().over(within) <= F.col("take")).cast("long"))
    rest = joined.where("NOT (take > 0 AND take < rows) OR rows IS NULL").withColumn("more", F.when(F.col("take") > 0, 1).otherwise(0).cast("long"))
    picked = ranked.select("id", "source", "key", "size", "more").unionAll(rest.select("id", "source", "key", "size", "more"))
    times = F.when(F.col("p.size") > 0, F.col("whole") + F.col("more")).otherwise(0)
    return (
        picked.alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("id").alias(id_col),
            F.col("p.source").alias("source"),
            "key",
            F.col("p.size").alias("size"),
            "source_size",
            "target",
            times.alias("times"),
            (times * F.col("p.size")).alias("taken"),
        )
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: a row that is taken n times stands n times, a row that is not taken is gone.

    All columns stay. The decisions are joined back by id, text and source; of rows that are equal in these, the first
    ones by a hash of the whole row take the larger shares.
    """
    mixed = mix_sources(docs).select(*row_key(F.col("doc_id"), F.xxhash64("key", "source")), "times")
    mixed = mixed.groupBy(*ROW_KEY).agg(F.sum("times").alias("sum_times"), F.count("*").alias("alike")).where("sum_times > 0")
    keyed = keyed_rows(docs, F.xxhash64(F.xxhash64("text"), F.col("source").cast("string")))
    joined = keyed.join(mixed, list(ROW_KEY)).withColumn("tie", row_hash())
    number = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("tie"))
    share = F.floor(F.col("sum_times") / F.col("alike")) + (number <= F.col("sum_times") % F.col("alike")).cast("long")
    repeated = joined.withColumn("copies", share).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
