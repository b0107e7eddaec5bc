"""Bookkeeping of the inferred layer: evidence, staleness, merging, module rollups. All keys are per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.functions.text import content_hash
from corpusindex.operators.digests import group_digest
from corpusindex.operators.retrieval import containing

# Words that are no keywords.
KEYWORD_STOPS = (
    "le la les un une des de du et à a au aux en pour par sur avec ou ce cette ces est sont son sa ses dans qui que se ne pas plus "
    "the of and to in for with par leur lel utilisateur"
).split()
CUT_MARK = "\n/* …truncated… */"
# What makes a Java type evidence, and the file names that are evidence in front ends and Node.
EVIDENCE_TYPES = "@(RestController|Controller|Service|Repository|Component|Configuration|Entity)"
EVIDENCE_NAMES = r"\.(component|service|directive|pipe|guard|resolver|module|routes)\.ts$|routing"
FIELDS = ("name", "purpose", "capabilities", "business_rules", "intents")


def eligible_files(files: DataFrame, lang: str, types: DataFrame | None = None) -> DataFrame:
    """`files` (repo, ctx_id, path, content) that are evidence of their contexts, with their `place` in a context.

    Java: those of `types` (repo, path, place, ann) with a stereotype, in the order of paths and types, once for each such
    type; front ends and Node: those with telling names; Python: all.
    """
    if lang == "java":
        marked = types.where(F.array_join("ann", " ").rlike(EVIDENCE_TYPES + r"(?![A-Za-z0-9_])")).select("repo", "path", F.col("place").alias("nth"))
        return files.join(marked, ["repo", "path"]).select(*files.columns, F.struct("path", "nth").alias("place"))
    found = files if lang == "python" else files.where(F.col("path").rlike(EVIDENCE_NAMES))
    return found.select(*files.columns, F.struct("path", F.lit(0).alias("nth")).alias("place"))


def evidence_sources(files: DataFrame, per_file: int = 4000, total: int = 16000) -> DataFrame:
    """(repo, ctx_id, path, place, source, truncated): the eligible files of each context, in order, cut and bounded.

    A file longer than `per_file` characters is cut and marked. Files are taken while those before hold fewer than `total`
    characters, so the last may exceed it; `truncated` tells whether the context lost files. A file that comes again counts
    again but is given once. Only cut texts travel, and only lengths are added up in order.
    """
    order = Window.partitionBy("repo", "ctx_id").orderBy("place")
    cut = F.when(F.length("content") > per_file, F.concat(F.substring("content", 1, per_file), F.lit(CUT_MARK))).otherwise(F.col("content"))
    sized = files.select("repo", "ctx_id", "path", "place", cut.alias("source")).withColumn("n", F.length("source"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumn("before", before)
    lost = F.max(F.col("before") >= total).over(Window.partitionBy("repo", "ctx_id"))
    nth = F.row_number().over(Window.partitionBy("repo", "ctx_id", "path").orderBy("place"))
    kept = sized.withColumn("truncated", lost).withColumn("nth", nth).where((F.col("before") < total) & (F.col("nth") == 1))
    return kept.select("repo", "ctx_id", "path", "place", "source", "truncated")


def evidence_packs(contexts: DataFrame, routes: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, ctx_id, routes, units, sources, truncated): what a context's meaning is inferred from.

    `routes` are its flows (labels where a route has none), `units` its units by group, a line each, sorted; `sources` are
    evidence_sources() joined by line breaks, each after its path.
    """
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    flows = routes.groupBy("repo", "ctx_id").agg(lines(F.coalesce("flow", "label")).alias("routes"))
    named = units.groupBy("repo", "ctx_id").agg(lines(F.concat_ws(" ", "grp", "name")).alias("units"))
    parts = F.array_sort(F.collect_list(F.struct("place", "path", "source")))
    texts = F.array_join(F.transform(parts, lambda p: F.concat_ws("\n", p["path"], p["source"])), "\n")
    held = sources.groupBy("repo", "ctx_id").agg(texts.alias("sources"), F.bool_or("truncated").alias("truncated"))
    out = contexts.select("repo", "ctx_id")
    for part in (flows, named, held):
        out = out.join(part, ["repo", "ctx_id"], "left")
    return out.withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def evidence_hash(packs: DataFrame) -> DataFrame:
    """(repo, ctx_id, evidence_hash) over a pack's facts and sources; a changed body changes it."""
    return packs.select("repo", "ctx_id", content_hash(F.concat_ws("\n", "ctx_id", "routes", "units", "sources")).alias("evidence_hash"))


def stale_contexts(hashes: DataFrame, functional: DataFrame, limit: int | None = None) -> DataFrame:
    """(repo, ctx_id, reason, evidence_hash, total_stale): missing or changed contexts, the first `limit` of each repo by id."""
    stored = functional.select("repo", "ctx_id", F.col("evidence_hash").alias("stored"), F.lit(True).alias("there"))
    joined = hashes.join(stored, ["repo", "ctx_id"], "left")
    changed = F.coalesce(F.col("stored") != F.col("evidence_hash"), F.lit(True))
    reason = F.when(F.col("there").isNull(), "missing").when(changed, "changed")
    out = joined.select("repo", "ctx_id", reason.alias("reason"), "evidence_hash").where("reason IS NOT NULL")
    totals = out.groupBy("repo").agg(F.count("*").alias("total_stale"))
    if limit is not None:
        order = Window.partitionBy("repo").orderBy("ctx_id")
        out = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    return out.join(totals, "repo")


def merge_functional(functional: DataFrame, batch: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert of `batch` (repo, ctx_id, place, fields), and the rows whose context is unknown.

    The last row of a context in the batch replaces the stored one with the context's current hashes.
    """
    known = contexts.select("repo", "ctx_id", F.col("src_hash").alias("now_src"), F.col("evidence_hash").alias("now_evidence"))
    failed = batch.join(known, ["repo", "ctx_id"], "left_anti")
    fields = [c for c in FIELDS if c in batch.columns]
    last = batch.groupBy("repo", "ctx_id").agg(*[F.max_by(c, "place").alias(f"new_{c}") for c in fields])
    fresh = last.join(known, ["repo", "ctx_id"]).withColumn("fresh", F.lit(True))
    joined = functional.join(fresh, ["repo", "ctx_id"], "full_outer")

    def pick(name: str, new: str) -> Column:
        return F.when(F.col("fresh"), F.col(new)).otherwise(F.col(name)).alias(name)

    merged = joined.select(
        "repo", "ctx_id", *[pick(c, f"new_{c}") for c in fields], pick("evidence_hash", "now_evidence"), pick("src_hash", "now_src")
    )
    return merged, failed


def reset_functional(functional: DataFrame) -> DataFrame:
    """No row, with the table's schema: every context is stale."""
    return functional.where(F.lit(False))


def _keyword_text(functional: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("purpose", F.lit("")), F.array_join(F.coalesce("capabilities", F.array()), " ")))


def module_keywords(functional: DataFrame, k: int = 6) -> DataFrame:
    """(repo, module, place, word, count): the `k` most frequent words of a module's purposes and capabilities."""
    words = functional.select("repo", "module", F.explode(F.split(_keyword_text(functional), "[^a-zàâäéèêëïîôöùûüç0-9]+")).alias("word"))
    counted = words.where((F.length("word") >= 3) & ~F.col("word").isin(*KEYWORD_STOPS)).groupBy("repo", "module", "word").agg(F.count("*").alias("count"))
    order = Window.partitionBy("repo", "module").orderBy(F.desc("count"), "word")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("repo", "module", "place", "word", "count")


def module_context_hash(functional: DataFrame) -> DataFrame:
    """(repo, module, context_hash) over sorted lines of id, purpose and capabilities."""
    line = F.concat_ws("|", "ctx_id", F.coalesce("purpose", F.lit("")), F.array_join(F.coalesce("capabilities", F.array()), ","))
    return group_digest(functional, ["repo", "module"], line, "\n").select("repo", "module", F.col("digest").alias("context_hash"))


def stale_modules(functional: DataFrame, stored: DataFrame) -> DataFrame:
    """(repo, module, reason, context_hash): modules with contexts whose stored theme is missing or out of date."""
    old = stored.select("repo", "module", F.col("context_hash").alias("old"), F.lit(True).alias("there"))
    joined = module_context_hash(functional).join(old, ["repo", "module"], "left")
    reason = F.when(F.col("there").isNull(), "missing").when(~F.col("old").eqNullSafe(F.col("context_hash")), "changed")
    return joined.select("repo", "module", reason.alias("reason"), "context_hash").where("reason IS NOT NULL")


def module_evidence(functional: DataFrame) -> DataFrame:
    """(repo, module, ctx_id, purpose, capabilities, context_hash): what a module's theme is inferred from."""
    return functional.select("repo", "module", "ctx_id", "purpose", "capabilities").join(module_context_hash(functional), ["repo", "module"])


def merge_module_functional(stored: DataFrame, batch: DataFrame, functional: DataFrame) -> DataFrame:
    """`stored` (repo, module, theme, keywords, context_hash) after an upsert with the current context hashes."""
    fresh = batch.select("repo", "module", F.col("theme").alias("new_theme"), F.col("keywords").alias("new_keywords"))
    fresh = fresh.join(module_context_hash(functional).withColumnRenamed("context_hash", "now"), ["repo", "module"], "left").withColumn("fresh", F.lit(True))
    joined = stored.join(fresh, ["repo", "module"], "full_outer")
    pick = lambda old, new: F.when(F.col("fresh"), F.col(new)).otherwise(F.col(old)).alias(old)
    return joined.select("repo", "module", pick("theme", "new_theme"), pick("keywords", "new_keywords"), pick("context_hash", "now"))


def capability_map(functional: DataFrame) -> DataFrame:
    """(repo, ctx_id, line): purpose, and capabilities after a dash."""
    caps = F.array_join(F.coalesce("capabilities", F.array()), "; ")
    return functional.select(
        "repo", "ctx_id", F.concat(F.coalesce("purpose", F.lit("")), F.when(caps != "", F.concat(F.lit(" — "), caps)).otherwise("")).alias("line")
    )


def context_listing(contexts: DataFrame, functional: DataFrame) -> DataFrame:
    """(repo, module, ctx_id, name, purpose, files) of every context, inferred or not."""
    inferred = functional.select("repo", "ctx_id", "purpose")
    return contexts.join(inferred, ["repo", "ctx_id"], "left").select("repo", "module", "ctx_id", "name", "purpose", F.col("file_count").alias("files"))


def project_brief(functional: DataFrame, themes: DataFrame) -> DataFrame:
    """(repo, module, role, contexts): the module's theme, else the first purpose by context id."""
    roles = functional.groupBy("repo", "module").agg(
        F.min_by("purpose", F.when(F.col("purpose").isNotNull(), F.col("ctx_id"))).alias("purpose"), F.count("*").alias("contexts")
    )
    return roles.join(themes.select("repo", "module", "theme"), ["repo", "module"], "left").select(
        "repo", "module", F.coalesce("theme", "purpose").alias("role"), "contexts"
    )


def grep_lines(lines: DataFrame, terms: DataFrame, whole: bool = True) -> DataFrame:
    """(repo, term, id, line): lines that hold a term in any case, without the lines unless `whole`; repeated terms count once."""
    wanted = terms.select("repo", "term").distinct().withColumn("word", F.lower("term"))
    keep = ["id", "line"] if whole else ["id"]
    hit = containing(lines.select("repo", *keep, F.lower("line").alias("hay")), wanted, *keep)
    return hit.join(wanted, ["repo", "word"]).select("repo", "term", *keep)
