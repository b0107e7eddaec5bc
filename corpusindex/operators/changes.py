"""Change detection by content hash, per repo and path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.functions.text import content_hash
from corpusindex.operators.digests import group_digest


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", content_hash(F.coalesce("content", F.lit(""))))


def classify_changes(hashes: DataFrame, manifest: DataFrame, engine_hash: str, force: bool = False) -> DataFrame:
    """(repo, path, status): `reused`, `parsed` or `gone`.

    `hashes` has repo, path, hash; `manifest` repo, path, hash, parse_error, engine_hash, cached. A file is reused where
    its hash is the recorded one, it was parsed without an error, its facts are cached and the engine is the same. Only
    hashes are shuffled.
    """
    old = manifest.select("repo", "path", F.col("hash").alias("old"), "parse_error", F.col("engine_hash").alias("old_engine"), "cached")
    joined = hashes.select("repo", "path", "hash").join(old, ["repo", "path"], "full_outer")
    same = (F.col("hash") == F.col("old")) & F.col("parse_error").isNull() & (F.col("old_engine") == engine_hash) & F.col("cached")
    reused = F.coalesce(same, F.lit(False)) & F.lit(not force)
    status = F.when(F.col("hash").isNull(), "gone").when(reused, "reused").otherwise("parsed")
    return joined.select("repo", "path", status.alias("status"))


def change_totals(classes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(repo, total, parsed, reused, gone), and errors of `facts` where given."""
    counts = classes.groupBy("repo").agg(
        F.count_if(F.col("status") != "gone").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("parsed", "reused", "gone")],
    )
    if facts is None:
        return counts
    errors = facts.groupBy("repo").agg(F.count_if(F.col("parse_error").isNotNull()).alias("errors"))
    return counts.join(errors, "repo", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


def incremental_facts(files: DataFrame, cache: DataFrame, classes: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of all current files: `extract` runs on parsed files only, reused ones come from `cache`."""
    todo = files.join(classes.where("status = 'parsed'").select("repo", "path"), ["repo", "path"], "left_semi")
    kept = cache.join(classes.where("status = 'reused'").select("repo", "path"), ["repo", "path"], "left_semi")
    return extract(todo).unionByName(kept, allowMissingColumns=True)


def context_fingerprint(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, file_count, src_hash): the hash of a context's sorted file hashes joined by bars."""
    found = group_digest(facts, ["repo", "ctx_id"], F.col("hash"), "|")
    return found.select("repo", "ctx_id", F.col("n").alias("file_count"), F.col("digest").alias("src_hash"))


def functional_drift(contexts: DataFrame, functional: DataFrame) -> DataFrame:
    """`contexts` with functional_stale: whether the stored source hash differs from the current one."""
    stored = functional.select("repo", "ctx_id", F.col("src_hash").alias("stored"))
    joined = contexts.join(stored, ["repo", "ctx_id"], "left")
    return joined.withColumn("functional_stale", F.coalesce(F.col("stored") != F.col("src_hash"), F.lit(False))).drop("stored")


def refreshed(
    touched: DataFrame, files: DataFrame, cache: DataFrame, manifest: DataFrame, engine_hash: str, extract: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(classes, facts) of the touched files (repo, path): classify_changes and incremental_facts on them alone."""
    names = touched.select("repo", "path").distinct()
    now, known = files.join(names, ["repo", "path"], "left_semi"), manifest.join(names, ["repo", "path"], "left_semi")
    classes = classify_changes(now, known, engine_hash)
    return classes, incremental_facts(now, cache.join(names, ["repo", "path"], "left_semi"), classes, extract)


def touched_groups(classes: DataFrame, old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The distinct `keys` of groups that lose, gain or change a file: those, in the facts before and now, of files that are
    not reused. Only names are shuffled."""
    moved = classes.where("status <> 'reused'").select("repo", "path")
    found = [facts.select("path", *keys).join(moved, ["repo", "path"], "left_semi").select(*keys) for facts in (old, new)]
    return found[0].unionByName(found[1]).distinct()


def rolled_up(previous: DataFrame, rows: DataFrame, touched: DataFrame, keys: tuple[str, ...], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`previous` with the groups in `touched` built anew from `rows`, which hold all rows of the next level below; groups
    that have none left go. Groups that nothing touched are neither read nor aggregated again.

    A rollup of several levels goes on with the touched keys of the level above: files to contexts, contexts to modules.
    """
    fresh = build(rows.join(touched, list(keys), "left_semi"))
    return previous.join(touched, list(keys), "left_anti").unionByName(fresh)
