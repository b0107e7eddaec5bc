"""The inferred layer and streams over the test views, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.functions.text import content_hash
from corpusindex.jobs.decision_queries import CUE_SQL, GAINS_SQL, HASH_SQL
from corpusindex.sources.store import shared_folder
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import functional as fn
from corpusindex.streaming import streams


def functional(spark, d):
    caps = F.array_compact(F.array("cap1", "cap2"))
    return view(spark, d, "functional_v").withColumn("capabilities", caps).withColumn("evidence_hash", F.concat(F.lit("e"), "src_hash"))


CAPS_SQL = "concat_ws({0}, cap1, cap2)"


def _sources(spark, d):
    files = view(spark, d, "files_v").select("repo", "ctx_id", "path", "content", F.col("doc_id").alias("place"))
    return fn.evidence_sources(files)


SOURCES_SQL = f"""
    cutting AS (SELECT repo, ctx_id, path, doc_id AS place, CASE WHEN length(content) > 4000 THEN substr(content, 1, 4000) || chr(10) || '/* …truncated… */' ELSE content END AS source FROM {sql_for("files_v")}),
    running AS (SELECT *, coalesce(sum(length(source)) OVER (PARTITION BY repo, ctx_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cutting),
    sources AS (SELECT repo, ctx_id, path, place, source, (SELECT max(before) FROM running q WHERE q.repo = r.repo AND q.ctx_id = r.ctx_id) >= 16000 AS truncated FROM running r WHERE before < 16000)"""


def _hashes(spark, d):
    """Hash of each context's stored source hash: stands for its evidence."""
    base = functional(spark, d)
    now = F.when(F.col("cap2").isNull(), F.col("evidence_hash")).otherwise(content_hash(F.col("ctx_id")))
    return base.select("repo", "ctx_id", now.alias("evidence_hash"))


def _stale(spark, d):
    stored = functional(spark, d).where("purpose IS NOT NULL").select("repo", "ctx_id", "evidence_hash")
    return fn.stale_contexts(_hashes(spark, d), stored, 40)


STALE_SQL = f"""
    WITH f AS (SELECT *, 'e' || src_hash AS stored, CASE WHEN cap2 IS NULL THEN 'e' || src_hash ELSE {HASH_SQL.format("ctx_id")} END AS now FROM {sql_for("functional_v")}),
    s AS (SELECT repo, ctx_id, CASE WHEN purpose IS NULL THEN 'missing' ELSE 'changed' END AS reason, now AS evidence_hash FROM f WHERE purpose IS NULL OR stored <> now)
    SELECT repo, ctx_id, reason, evidence_hash, total_stale FROM (SELECT *, count(*) OVER (PARTITION BY repo) AS total_stale, row_number() OVER (PARTITION BY repo ORDER BY ctx_id) AS n FROM s) WHERE n <= 40"""


def _merge(spark, d):
    """The stored layer after a batch from every seventh part, sent twice, of which some contexts are unknown."""
    base = functional(spark, d)
    number = F.regexp_extract("ctx_id", "/([0-9]+)$", 1).cast("long")
    batch = base.where(number % 7 == 0).select("repo", F.when(number % 2 == 0, F.concat("ctx_id", F.lit("x"))).otherwise(F.col("ctx_id")).alias("ctx_id"), F.lit(1).alias("place"), F.lit("first").alias("purpose"), "capabilities")
    again = batch.withColumn("place", F.lit(2)).withColumn("purpose", F.lit("second"))
    contexts = base.select("repo", "ctx_id", F.lit("now").alias("src_hash"), F.lit("nowe").alias("evidence_hash"))
    merged, failed = fn.merge_functional(base.select("repo", "ctx_id", "purpose", "capabilities", "evidence_hash", "src_hash"), batch.unionByName(again), contexts)
    rows = merged.select("repo", "ctx_id", "purpose", F.array_join("capabilities", ";").alias("capabilities"), "evidence_hash", "src_hash", F.lit(False).alias("failed"))
    lost = failed.select("repo", "ctx_id", "purpose", F.array_join("capabilities", ";"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True))
    return rows.unionAll(lost)


NUMBER_SQL = "CAST(regexp_extract(ctx_id, '/([0-9]+)$', 1) AS BIGINT)"
MERGE_SQL = f"""
    WITH f AS (SELECT *, {NUMBER_SQL} AS n, {CAPS_SQL.format("';'")} AS capabilities FROM {sql_for("functional_v")})
    SELECT repo, ctx_id, CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 'second' ELSE purpose END AS purpose, capabilities,
           CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 'nowe' ELSE 'e' || src_hash END AS evidence_hash, CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 'now' ELSE src_hash END AS src_hash, FALSE AS failed FROM f
    UNION ALL SELECT repo, ctx_id || 'x', p, capabilities, NULL, NULL, TRUE FROM f, (VALUES ('first'), ('second')) v(p) WHERE n % 7 = 0 AND n % 2 = 0"""
MODULE_HASH_SQL = f"""SELECT repo, module, {HASH_SQL.format("string_agg(line, chr(10) ORDER BY line)")} AS context_hash
    FROM (SELECT repo, module, ctx_id || '|' || coalesce(purpose, '') || '|' || {CAPS_SQL.format("','")} AS line FROM {sql_for("functional_v")}) GROUP BY ALL"""
ODD_BRAND = "CAST(regexp_extract(module, '[0-9]+') AS BIGINT)"


def _stored_modules(spark, d):
    """Themes of two thirds of the modules, some out of date."""
    number = F.regexp_extract("module", "([0-9]+)", 1).cast("long")
    hashes = fn.module_context_hash(functional(spark, d)).where(number % 3 != 0)
    return hashes.select(
        "repo", "module", F.when(number % 2 == 0, F.concat(F.lit("theme "), "module")).alias("theme"), F.lit("k").alias("keywords"),
        F.when(number % 4 == 0, "old").otherwise(F.col("context_hash")).alias("context_hash"),
    )


STORED_SQL = f"""SELECT repo, module, CASE WHEN {ODD_BRAND} % 2 = 0 THEN 'theme ' || module END AS theme, 'k' AS keywords,
    CASE WHEN {ODD_BRAND} % 4 = 0 THEN 'old' ELSE context_hash END AS context_hash FROM ({MODULE_HASH_SQL}) WHERE {ODD_BRAND} % 3 <> 0"""


def _merge_modules(spark, d):
    number = F.regexp_extract("module", "([0-9]+)", 1).cast("long")
    base = functional(spark, d)
    batch = base.select("repo", "module").distinct().where(number % 5 == 0).select("repo", "module", F.lit("fresh").alias("theme"), F.lit("kw").alias("keywords"))
    return fn.merge_module_functional(_stored_modules(spark, d), batch, base)


def _contexts(spark, d):
    return functional(spark, d).select("repo", "ctx_id", "module", F.substring_index("ctx_id", "/", -1).alias("name"), F.lit(1).alias("file_count"))


def _listing(spark, d):
    return fn.context_listing(_contexts(spark, d), functional(spark, d).where("cap2 IS NOT NULL"))


def _grep(spark, d):
    terms = view(spark, d, "nation").select(F.explode(F.array(F.lit("RED"), F.lit("widget"), F.lit("economy"))).alias("term"), F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string")).alias("repo"))
    lines = fn.capability_map(functional(spark, d)).select("repo", F.col("ctx_id").alias("id"), "line")
    return fn.grep_lines(lines, terms)


def _grep_documents(spark, d):
    """Whole documents that hold words of their repo's questions, part words and words of all questions among them."""
    words = view(spark, d, "queries_v").select("repo", F.explode(F.split("q", " ")).alias("w"))
    terms = words.select("repo", F.explode(F.array(F.col("w"), F.concat(F.lit("x"), "w"), F.substring("w", 2, 4), F.concat_ws(" ", "w", F.lit("de")))).alias("term")).where("trim(term) <> ''")
    texts = view(spark, d, "files_v").select("repo", F.col("path").alias("id"), F.col("content").alias("line"))
    return fn.grep_lines(texts, terms, whole=False)


# --- streams ------------------------------------------------------------------------------------------------------------


def _stream(spark, d, table):
    """A table's files as a stream; the pattern holds for a single file and for a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parquet*")


def touches(spark, d):
    """Touched files as a stream."""
    kind = F.when(F.col("event_type") == "error", ".txt").when(F.col("event_type") == "view", ".yml").otherwise(".java")
    return _stream(spark, d, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("repo"), F.concat(F.lit("f"), "user_id", kind).alias("file"), "ts"
    )


def _touches(spark, d):
    out = shared_folder(spark)
    query = streams.touch_queue(touches(spark, d), "java", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/drained"), f"{out}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/drained").select("repo", "file").distinct()


def _cues(spark, d):
    n = F.col("conv_id") + F.col("turn")
    text = F.when(n % 5 == 0, F.concat(F.lit("From now on: "), "text")).when(n % 7 == 0, F.concat("text", F.lit(" by convention"))).otherwise(F.col("text"))
    messages = _stream(spark, d, "conversations").select(
        F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string")).alias("repo"), F.concat_ws("-", "conv_id", "turn").alias("msg_id"), text.alias("text")
    )
    out = shared_folder(spark)
    opted = spark.createDataFrame([("r0",), ("r2",)], "repo string")
    streams.append_sink(streams.cue_stream(messages, opted).select("repo", "msg_id"), f"{out}/cues", f"{out}/state").awaitTermination()
    return spark.read.schema("repo string, msg_id string").parquet(f"{out}/cues")


def _gain_stream(spark, d):
    rows = _stream(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("time"), F.col("event_type").alias("op"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("plugin"),
        F.concat("event_type", F.lit("|"), "props", F.lit("|"), F.repeat("event_type", 12)).alias("detail"), F.floor("value").cast("long").alias("used"), (F.col("event_id") % 90).alias("baseline"),
    )
    out = shared_folder(spark)
    streams.append_sink(streams.gain_stream(rows), f"{out}/gains", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/gains")


QUERIES = {
    "evidence_sources": _sources,
    "stale_contexts": _stale,
    "merge_functional": _merge,
    "module_keywords": lambda s, d: fn.module_keywords(functional(s, d)),
    "module_hash": lambda s, d: fn.module_context_hash(functional(s, d)),
    "stale_modules": lambda s, d: fn.stale_modules(functional(s, d), _stored_modules(s, d)),
    "module_evidence": lambda s, d: fn.module_evidence(functional(s, d)).withColumn("capabilities", F.array_join("capabilities", ";")),
    "merge_module_functional": _merge_modules,
    "capability_map": lambda s, d: fn.capability_map(functional(s, d)),
    "context_listing": _listing,
    "project_brief": lambda s, d: fn.project_brief(functional(s, d), _stored_modules(s, d)),
    "grep_capabilities": _grep,
    "grep_documents": _grep_documents,
    "touch_drain": _touches,
    "cue_stream": _cues,
    "gain_stream": _gain_stream,
}

LINE_SQL = f"SELECT repo, ctx_id, coalesce(purpose, '') || coalesce(' — ' || nullif({CAPS_SQL.format(chr(39) + '; ' + chr(39))}, ''), '') AS line FROM {sql_for('functional_v')}"
STOPS_SQL = ", ".join(f"'{w}'" for w in fn.KEYWORD_STOPS)
ORACLE = {
    "evidence_sources": f"WITH {SOURCES_SQL} SELECT * FROM sources",
    "stale_contexts": STALE_SQL,
    "merge_functional": MERGE_SQL,
    "module_keywords": f"""SELECT repo, module, place, word, count FROM (SELECT *, row_number() OVER (PARTITION BY repo, module ORDER BY count DESC, word) AS place FROM (
        SELECT repo, module, word, count(*) AS count FROM (SELECT repo, module, unnest(string_split_regex(lower(concat_ws(' ', coalesce(purpose, ''), cap1, cap2)), '[^a-zàâäéèêëïîôöùûüç0-9]+')) AS word
        FROM {sql_for("functional_v")}) WHERE length(word) >= 3 AND word NOT IN ({STOPS_SQL}) GROUP BY ALL)) WHERE place <= 6""",
    "module_hash": MODULE_HASH_SQL,
    "stale_modules": f"""SELECT h.repo, h.module, CASE WHEN s.module IS NULL THEN 'missing' ELSE 'changed' END AS reason, h.context_hash
        FROM ({MODULE_HASH_SQL}) h LEFT JOIN ({STORED_SQL}) s USING (repo, module) WHERE s.module IS NULL OR s.context_hash <> h.context_hash""",
    "module_evidence": f"SELECT repo, module, ctx_id, purpose, {CAPS_SQL.format(chr(39) + ';' + chr(39))} AS capabilities, context_hash FROM {sql_for('functional_v')} JOIN ({MODULE_HASH_SQL}) USING (repo, module)",
    "merge_module_functional": f"""WITH s AS ({STORED_SQL}), b AS (SELECT * FROM ({MODULE_HASH_SQL}) WHERE {ODD_BRAND} % 5 = 0)
        SELECT coalesce(s.repo, b.repo) AS repo, coalesce(s.module, b.module) AS module, CASE WHEN b.module IS NULL THEN theme ELSE 'fresh' END AS theme,
               CASE WHEN b.module IS NULL THEN keywords ELSE 'kw' END AS keywords, coalesce(b.context_hash, s.context_hash) AS context_hash FROM s FULL JOIN b ON s.repo = b.repo AND s.module = b.module""",
    "capability_map": LINE_SQL,
    "context_listing": f"""SELECT repo, module, ctx_id, string_split(ctx_id, '/')[-1] AS name, CASE WHEN cap2 IS NOT NULL THEN purpose END AS purpose, 1 AS files FROM {sql_for("functional_v")}""",
    "project_brief": f"""SELECT f.repo, f.module, coalesce(any_value(s.theme), min_by(purpose, ctx_id) FILTER (purpose IS NOT NULL)) AS role, count(*) AS contexts
        FROM {sql_for("functional_v")} f LEFT JOIN ({STORED_SQL}) s USING (repo, module) GROUP BY f.repo, f.module""",
    "grep_capabilities": f"""SELECT l.repo, term, ctx_id AS id, line FROM ({LINE_SQL}) l, (VALUES ('RED'), ('widget'), ('economy')) v(term) WHERE contains(lower(line), lower(term))""",
    "grep_documents": f"""WITH w AS (SELECT repo, unnest(string_split(q, ' ')) AS w FROM {sql_for("queries_v")}),
        t AS (SELECT DISTINCT repo, unnest([w, 'x' || w, substr(w, 2, 4), w || ' de']) AS term FROM w)
        SELECT t.repo, term, path AS id FROM t JOIN {sql_for("files_v")} f ON f.repo = t.repo AND contains(lower(content), lower(term)) WHERE trim(term) <> ''""",
    "touch_drain": "SELECT DISTINCT 'r' || (user_id % 3) AS repo, 'f' || user_id || CASE event_type WHEN 'view' THEN '.yml' ELSE '.java' END AS file FROM events WHERE event_type <> 'error'",
    "cue_stream": f"SELECT repo, msg_id FROM {sql_for('messages_v')} WHERE regexp_matches(text, '{CUE_SQL}') AND repo IN ('r0', 'r2')",
    "gain_stream": GAINS_SQL,
}
