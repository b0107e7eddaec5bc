"""Answer cache: look up, append, collect, and answer from cache where its dependencies are unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.functions.text import idf, normalize_terms, normalized_query


def answer_lookup(queries: DataFrame, ledger: DataFrame, current: DataFrame, engine: str | None = None, tau: float = 0.6) -> DataFrame:
    """(repo, query_id, entry, score, verdict, stale_ctx): the best ledger entry of each query and whether it still holds.

    `queries` has repo, query_id, q, scope; `ledger` repo, entry (a place in order), terms, scope, engine, deps; `current`
    repo, ctx, h. Scores are idf**2 overlaps over the ledger; an entry of another scope, where both have one, is no
    candidate; the earliest entry wins ties. Verdicts: weak (score < tau), engine (another engine wrote it), stale (the
    first dependency whose hash is unknown or different, named in stale_ctx) or fresh. Queries without a candidate give
    no row.
    """
    n = ledger.groupBy("repo").agg(F.count("*").alias("n"))
    held = ledger.select("repo", "entry", F.col("scope").alias("e_scope"), F.explode(F.array_distinct("terms")).alias("term"))
    df = held.groupBy("repo", "term").agg(F.count("*").alias("df"))
    asked = queries.select("repo", "query_id", "scope", F.explode(normalize_terms(F.col("q"))).alias("term"))
    weighed = asked.join(n, "repo").join(df, ["repo", "term"], "left").withColumn("w2", idf(F.col("df"), F.col("n")) ** 2)
    q_self = weighed.groupBy("repo", "query_id").agg(F.sum("w2").alias("q_self"))
    e_weights = held.join(df, ["repo", "term"]).join(n, "repo").withColumn("w2", idf(F.col("df"), F.col("n")) ** 2)
    e_self = e_weights.groupBy("repo", "entry").agg(F.sum("w2").alias("e_self"))
    open_ = F.col("scope").isNull() | F.col("e_scope").isNull() | (F.col("scope") == F.col("e_scope"))
    dots = weighed.join(held, ["repo", "term"]).where(open_).groupBy("repo", "query_id", "entry").agg(F.sum("w2").alias("dot"))
    scored = dots.join(q_self, ["repo", "query_id"]).join(e_self, ["repo", "entry"])
    scored = scored.withColumn("score", F.round(F.col("dot") / F.least("q_self", "e_self"), 6)).where("score > 0")
    order = Window.partitionBy("repo", "query_id").orderBy(F.col("score").desc(), "entry")
    best = scored.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    best = best.join(ledger.select("repo", "entry", F.col("engine").alias("e_engine"), "deps"), ["repo", "entry"])
    deps = best.select("repo", "query_id", F.posexplode("deps").alias("pos", "dep"))
    deps = deps.select("repo", "query_id", "pos", F.col("dep.ctx").alias("ctx"), F.col("dep.h").alias("h"))
    now = current.select("repo", "ctx", F.col("h").alias("now"))
    moved = deps.join(now, ["repo", "ctx"], "left").where(~F.col("h").eqNullSafe(F.col("now")) | F.col("now").isNull())
    moved = moved.groupBy("repo", "query_id").agg(F.min_by("ctx", "pos").alias("moved_ctx"))
    other = F.lit(False) if engine is None else F.coalesce(F.col("e_engine") != engine, F.lit(False))
    verdict = (
        F.when(F.col("score") < tau, "weak").when(other, "engine").when(F.col("moved_ctx").isNotNull(), "stale").otherwise("fresh")
    )
    out = best.join(moved, ["repo", "query_id"], "left").withColumn("verdict", verdict)
    return out.select(
        "repo", "query_id", "entry", "score", "verdict", F.when(F.col("verdict") == "stale", F.col("moved_ctx")).alias("stale_ctx")
    )


def cache_answers(answers: DataFrame, current: DataFrame) -> DataFrame:
    """Ledger rows of new answers (repo, q, a, ctxs, scope, engine, ts); `outcome` tells why others are refused.

    The hashes of the named contexts are attached in their order; an unknown context or an empty answer is refused.
    """
    numbered = answers.select("repo", "q", "a", "scope", "engine", "ts", F.posexplode_outer("ctxs").alias("pos", "ctx"))
    known = numbered.join(current.select("repo", "ctx", "h"), ["repo", "ctx"], "left")
    grouped = known.groupBy("repo", "q", "a", "scope", "engine", "ts").agg(
        F.array_sort(F.collect_list(F.when(F.col("ctx").isNotNull(), F.struct("pos", "ctx", "h")))).alias("found"),
        F.bool_or(F.col("ctx").isNotNull() & F.col("h").isNull()).alias("unknown"),
    )
    terms = normalize_terms(F.col("q"))
    outcome = F.when(F.coalesce(F.trim("a"), F.lit("")) == "", "empty").when(F.col("unknown"), "unknown-context").otherwise("cached")
    return grouped.select(
        "repo", "q", normalized_query(terms).alias("qn"), terms.alias("terms"), "a",
        F.transform("found", lambda d: F.struct(d["ctx"].alias("ctx"), d["h"].alias("h"))).alias("deps"),
        "scope", "engine", F.lit(0).alias("hits"), "ts", outcome.alias("outcome"),
    )


def ledger_gc(ledger: DataFrame, engine: str) -> DataFrame:
    """`ledger` with `kept`: whether the entry names no engine or this one."""
    return ledger.withColumn("kept", F.coalesce(F.col("engine") == engine, F.lit(True)))


def ledger_stats(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("repo").agg(F.count("*").alias("entries"), F.sum(F.coalesce("hits", F.lit(0))).cast("long").alias("hits"))


def cached_or(found: DataFrame, ledger: DataFrame, live: DataFrame) -> DataFrame:
    """(repo, query_id, origin, answer, id, score, rank): the cached answer where the verdict is fresh, else live hits."""
    fresh = found.where("verdict = 'fresh'").select("repo", "query_id", "entry").join(ledger.select("repo", "entry", "a"), ["repo", "entry"])
    none = lambda kind: F.lit(None).cast(kind)
    cached = fresh.select(
        "repo", "query_id", F.lit("cache").alias("origin"), F.col("a").alias("answer"), none("string").alias("id"),
        none("double").alias("score"), none("int").alias("rank"),
    )
    rest = live.join(fresh, ["repo", "query_id"], "left_anti")
    return cached.unionByName(
        rest.select("repo", "query_id", F.lit("index").alias("origin"), none("string").alias("answer"), "id", "score", "rank")
    )


def with_deps(ledger: DataFrame, ctx: Column, h: Column) -> DataFrame:
    """`ledger` with terms of its question and a single dependency."""
    return ledger.withColumn("terms", normalize_terms(F.col("q"))).withColumn("deps", F.array(F.struct(ctx.alias("ctx"), h.alias("h"))))
