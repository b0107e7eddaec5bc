"""Round trips through the sinks and sources; each oracle is the table that was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.facts.blank import with_code_only
from corpusindex.facts.front import extract_angular_facts, extract_react_facts
from corpusindex.facts.java import extract_java_facts
from corpusindex.facts.node import extract_node_facts
from corpusindex.facts.python import extract_python_facts
from corpusindex.functions.text import content_hash
from corpusindex.jobs.decision_queries import HASH_SQL, files, ledger, with_evidence
from corpusindex.jobs.functional_queries import functional, touches
from corpusindex.sources.store import shared_folder, stored
from corpusindex.jobs.retrieval_queries import HAYSTACK, DECISIONS_SQL, decisions, terms_sql
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import retrieval, web
from corpusindex.operators.changes import refreshed, with_hash
from corpusindex.sources import files as io
from corpusindex.streaming import streams


def _decisions(spark, d):
    path = shared_folder(spark)
    io.write_decisions(with_evidence(spark, d), path)
    back = io.read_decisions(spark, path)
    hashes = F.array_join(F.transform(F.array_sort(F.map_entries("evidence_hashes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return back.select("repo", "id", "title", "type", "status", "scope", "domain", "date", "decision", "rationale", "supersedes", F.array_join("tags", " ").alias("tags"), hashes.alias("hashes"), "error")


def _facts(spark, d):
    path = shared_folder(spark)
    base = files(spark, d).select("repo", "path", "hash")
    io.write_fact_cache(base.withColumn("written", F.lit(1)), path)
    io.write_fact_cache(base.where("substr(hash, 1, 1) < '8'").withColumn("hash", F.upper("hash")).withColumn("written", F.lit(2)), path)
    spark.range(1).select(F.lit('{"repo": "broken').alias("value")).write.mode("append").text(path)
    return io.read_fact_cache(spark, path, "repo string, path string, hash string, written int").select("repo", "path", "hash")


def _functional(spark, d):
    """Contexts with rules, and modules, written as JSON texts of few entries each and read back."""
    rules = F.when(F.length("ctx_id") % 2 == 0, F.array(F.concat(F.lit("rule \""), "ctx_id"), F.lit("rule two")))
    base = functional(spark, d).select("repo", "ctx_id", "module", "purpose", "capabilities", rules.alias("business_rules"), "src_hash")
    modules = base.groupBy("repo", "module").agg(F.concat(F.lit("theme of "), "module").alias("theme"), F.array(F.col("module")).alias("keywords"), F.lit("h").alias("context_hash"))
    contexts, themes = io.read_functional(io.functional_json(base.drop("module"), modules, 50))
    joined = lambda c: F.array_join(c, ";").alias(c)
    out = contexts.select("repo", "ctx_id", "purpose", joined("capabilities"), joined("business_rules"), "src_hash")
    return out.unionByName(themes.select("repo", F.col("module").alias("ctx_id"), F.col("theme").alias("purpose"), joined("keywords").alias("capabilities"), F.lit(None).cast("string").alias("business_rules"), F.col("context_hash").alias("src_hash")))


def _batch(spark, d):
    rows = view(spark, d, "functional_v").select("ctx_id", F.to_json(F.struct(F.col("ctx_id").alias("id"), "purpose")).alias("j"), F.length("ctx_id").alias("n"))
    text = F.when(F.col("n") % 2 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.concat(F.lit("["), "j", F.lit("]")))
    return io.read_inference_batch(rows.select(text.alias("content")), "id:string,purpose:string")


INDEX_COLUMNS = "path string, content string"


def _index(spark, d):
    """A table of files by context written three times, a module gone the second time and back the third: what each write
    reports, and how many rows its generation holds, the first two read after the third was written."""
    path = shared_folder(spark)
    old = view(spark, d, "old_files_v").where("path NOT LIKE 'gone/%'").select(F.concat_ws("/", "repo", "ctx_id").alias("ctx"), "path", "content")
    new = view(spark, d, "files_v").select(F.concat_ws("/", "repo", "ctx_id").alias("ctx"), "path", "content", "module")
    writes = [old, new.where("module <> 'src3'").drop("module"), new.drop("module")]
    changes = [io.write_index(spark, table, path, "ctx").select("ctx", "change") for table in writes]
    out = None
    for n, change in enumerate(changes, 1):
        held = io.read_index(spark, path, "ctx", INDEX_COLUMNS, n).groupBy("ctx").agg(F.count("*").alias("held"))
        rows = change.join(held, "ctx", "full_outer").select(F.lit(n).alias("write"), "ctx", "change", F.coalesce("held", F.lit(0)).alias("held"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _postings(spark, d):
    path = shared_folder(spark)
    io.write_postings(retrieval.postings(retrieval.decision_terms(decisions(spark, d))), path)
    return spark.read.parquet(path).select("repo", "term", F.array_join("ids", ",").alias("ids"))


def _ledger(spark, d):
    path = shared_folder(spark)
    ledger(spark, d).write.mode("append").json(path)
    return spark.read.schema("repo string, entry long, q string, a string, scope string, terms array<string>").json(path).select("repo", "entry", "q", "a", "scope", F.size("terms").alias("n_terms"))


def _code(spark, d):
    """Blanked sources of every generated file: lengths and line counts stay."""
    out = with_code_only(view(spark, d, "javasrc_v"), "java")
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return out.select("repo", "path", F.length("code").alias("n"), lines(F.col("code")).alias("lines"), F.contains("code", F.lit("Fake")).alias("fake"))


def _scan(spark, d):
    """Generated sources of Python among files that a scan leaves out, written as a tree and scanned."""
    base = view(spark, d, "pysrc_v").select("repo", "path", "content", "k")
    k = F.col("k").cast("string")
    odd = F.when(F.col("k") % 4 == 0, F.concat(F.lit("venv/x"), k, F.lit(".py"))).when(F.col("k") % 4 == 1, F.concat(F.lit("a/test_"), k, F.lit(".py")))
    odd = odd.when(F.col("k") % 4 == 2, F.concat(F.lit("a/x"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("a/nul"), k, F.lit(".py")))
    content = F.when(F.col("k") % 4 == 3, F.concat(F.lit("x = 1"), F.decode(F.unhex(F.lit("00")), "UTF-8"))).otherwise(F.lit("x = 1"))
    root = shared_folder(spark)
    io.write_tree(base.select("repo", "path", "content").unionByName(base.select("repo", odd.alias("path"), content.alias("content"))), root)
    return io.scan_source_files(spark, root, "python").select("repo", "path", content_hash(F.col("content")).alias("hash"), "size")


def _projects(spark, d):
    files = view(spark, d, "buildfiles_v")
    parts = [io.read_projects(files, lang).select(F.lit(lang).alias("lang"), "repo", "dir", "name", "root") for lang in ("java", "node", "angular")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _workspaces(spark, d):
    """Files of workspaces with several projects, of which the third repo names none."""
    files = view(spark, d, "workspaces_v")
    listed = '{"projects": {"shop": {"sourceRoot": "projects/shop/src"}, "admin": {"root": "projects/admin"}, "lib": {"sourceRoot": "lib"}}}'
    build = files.select("repo").distinct().select("repo", F.when(F.col("repo") == "r2", "readme").otherwise("angular.json").alias("path"), F.lit(listed).alias("content"))
    return web.assign_feature(files, io.read_projects(build, "angular"), "angular").select("repo", "path", "module", "ctx_id")


def _odd(spark, d):
    """What the readers find in sources that are easily misread."""
    files = stored(with_hash(view(spark, d, "oddsrc_v")))
    of = lambda lang: files.where(F.col("lang") == lang)
    facts = stored(extract_angular_facts(of("angular")))
    calls = facts.select("repo", "path", F.explode("types").alias("t")).select("repo", "path", F.explode("t.http").alias("h")).select(F.lit("angular").alias("lang"), "repo", "path", F.concat_ws(" ", "h.verb", "h.url").alias("found"))
    react = extract_react_facts(of("react")).select("repo", "path", F.explode("routes").alias("r")).select(F.lit("react").alias("lang"), "repo", "path", F.concat_ws(" ", "r.path", "r.target").alias("found"))
    python = web.python_routes(web.assign_python(extract_python_facts(of("python")))).select(F.lit("python").alias("lang"), "repo", F.col("file").alias("path"), F.concat_ws(" ", "verb", "path", "fn").alias("found"))
    node = extract_node_facts(of("node"))
    routes = node.select("repo", "path", F.explode("routes").alias("r")).select(F.lit("node").alias("lang"), "repo", "path", F.concat_ws(" ", "r.verb", "r.path").alias("found"))
    return calls.unionByName(react).unionByName(python).unionByName(routes)


def _reconcile(spark, d):
    """Touched files drained from a stream, their facts read again where their hash changed, taken from the cache else."""
    users = view(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("f"), "user_id", F.lit(".java"))
    body = F.concat(F.lit("class A"), "user_id", F.lit(" { }"))
    repo = F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))
    files = stored(with_hash(users.where("user_id % 7 <> 0").select(repo.alias("repo"), name.alias("path"), body.alias("content"), "user_id")))
    manifest = stored(users.where("user_id % 5 <> 0").join(files.select("user_id", "hash"), "user_id", "left").select(
        repo.alias("repo"), name.alias("path"), F.when(F.col("user_id") % 2 == 0, "old").otherwise(F.coalesce("hash", F.lit("x"))).alias("hash"),
        F.lit(None).cast("string").alias("parse_error"), F.lit("E1").alias("engine_hash"), F.lit(True).alias("cached"),
    ))
    cache = files.select("repo", "path", "hash").withColumn("types", F.lit("from cache"))
    out = shared_folder(spark)

    def drain(batch, number):
        names = batch.select("repo", F.col("file").alias("path"))
        extract = lambda todo: extract_java_facts(todo).select("repo", "path", "hash", F.array_join(F.transform("types", lambda t: t["name"]), ",").alias("types"))
        classes, facts = refreshed(names, files, cache, manifest, "E1", extract)
        rows = classes.join(facts.select("repo", "path", "types"), ["repo", "path"], "left").withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/drained/batch={number}")

    streams.touch_queue(touches(spark, d), "java", drain, f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/drained").select("repo", "path", "status", "types").distinct()


QUERIES = {
    "scan_files": _scan,
    "build_projects": _projects,
    "angular_workspaces": _workspaces,
    "odd_sources": _odd,
    "touch_reconcile": _reconcile,
    "decision_roundtrip": _decisions,
    "fact_cache_roundtrip": _facts,
    "functional_roundtrip": _functional,
    "inference_batch": _batch,
    "index_write_changes": _index,
    "postings_write": _postings,
    "ledger_roundtrip": _ledger,
    "code_only": _code,
}

LINE2 = "coalesce(string_split(decision, chr(10))[2], '')"
TOUCHED_SQL = "(SELECT DISTINCT user_id AS k, 'r' || (user_id % 3) AS repo, 'f' || user_id || '.java' AS path FROM events WHERE event_type NOT IN ('error', 'view'))"
ORACLE = {
    "scan_files": f"SELECT repo, path, {HASH_SQL.format('content')} AS hash, octet_length(encode(content)) AS size FROM {sql_for('pysrc_v')}",
    "build_projects": """SELECT 'java' AS lang, 'r' || s_suppkey AS repo, '' AS dir, CASE WHEN s_suppkey % 2 = 0 THEN 'own' || s_suppkey ELSE 'r' || s_suppkey END AS name, '' AS root FROM supplier
        UNION ALL SELECT 'node', 'r' || s_suppkey, 'web', CASE WHEN s_suppkey % 3 = 0 THEN 'web' ELSE 'web' || s_suppkey END, CASE WHEN s_suppkey % 5 = 0 THEN 'web/src' ELSE 'web' END FROM supplier
        UNION ALL SELECT 'angular', 'r' || s_suppkey, '', name, root FROM supplier, (VALUES ('shop', 'projects/shop/src'), ('admin', 'projects/admin/src')) v(name, root) WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'angular', 'r' || s_suppkey, '', 'r' || s_suppkey, 'src' FROM supplier WHERE s_suppkey % 2 = 1""",
    "angular_workspaces": f"""SELECT repo, path, CASE WHEN repo = 'r2' THEN 'r2' WHEN k % 4 = 0 THEN 'shop' WHEN k % 4 = 1 THEN 'admin' ELSE 'lib' END AS module,
        CASE WHEN repo = 'r2' THEN 'r2/app' WHEN k % 4 = 0 THEN 'shop/features.f' || (k % 5) WHEN k % 4 = 1 THEN 'admin/pages.f' || (k % 5) WHEN k % 4 = 2 THEN 'lib/f' || (k % 5) ELSE 'lib/app' END AS ctx_id
        FROM {sql_for("workspaces_v")}""",
    "odd_sources": f"""WITH o AS (SELECT * FROM {sql_for("oddsrc_v")})
        SELECT lang, repo, path, 'GET /o' || k AS found FROM o WHERE lang = 'angular'
        UNION ALL SELECT lang, repo, path, unnest(['/a' || k || ' A', '/b B', '(index) Home']) FROM o WHERE lang = 'react'
        UNION ALL SELECT lang, repo, path, 'GET /q' || k || ' ok' || k FROM o WHERE lang = 'python'
        UNION ALL SELECT lang, repo, path, 'GET /n' || k FROM o WHERE lang = 'node'""",
    "touch_reconcile": f"""SELECT repo, path, CASE WHEN k % 7 = 0 THEN 'gone' WHEN k % 5 = 0 OR k % 2 = 0 THEN 'parsed' ELSE 'reused' END AS status,
        CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 OR k % 2 = 0 THEN 'A' || k ELSE 'from cache' END AS types FROM {TOUCHED_SQL} WHERE k % 7 <> 0 OR k % 5 <> 0""",
    "decision_roundtrip": f"""SELECT repo, id, title, type, status, scope, domain, date, decision, rationale, supersedes, lang || ' ' || source AS tags,
        CASE WHEN doc_id % 3 = 0 THEN path ELSE path || ':2' END || '=' || CASE WHEN doc_id % 10 = 0 THEN '00000000' WHEN doc_id % 3 = 0 THEN {HASH_SQL.format("decision")} ELSE {HASH_SQL.format(LINE2)} END AS hashes, NULL AS error
        FROM {sql_for("decisions_v")}""",
    "fact_cache_roundtrip": f"SELECT repo, path, CASE WHEN h < '8' THEN upper(h) ELSE h END AS hash FROM (SELECT repo, path, {HASH_SQL.format('content')} AS h FROM {sql_for('files_v')})",
    "functional_roundtrip": f"""SELECT repo, ctx_id, purpose, concat_ws(';', cap1, cap2) AS capabilities, CASE WHEN length(ctx_id) % 2 = 0 THEN 'rule "' || ctx_id || ';rule two' END AS business_rules, src_hash
        FROM {sql_for("functional_v")} UNION ALL SELECT DISTINCT repo, module, 'theme of ' || module, module, NULL, 'h' FROM {sql_for("functional_v")}""",
    "inference_batch": f"SELECT ctx_id AS id, purpose FROM {sql_for('functional_v')}",
    "index_write_changes": f"""WITH o AS (SELECT 1 AS write, repo || '/' || ctx_id AS ctx, count(*) AS held, string_agg(path || content, chr(0) ORDER BY path) AS c FROM {sql_for("old_files_v")} WHERE path NOT LIKE 'gone/%' GROUP BY 2),
        f AS (SELECT 3 AS write, repo || '/' || ctx_id AS ctx, any_value(module) AS module, count(*) AS held, string_agg(path || content, chr(0) ORDER BY path) AS c FROM {sql_for("files_v")} GROUP BY 2),
        g AS (SELECT write, ctx, held, c FROM o UNION ALL SELECT 2, ctx, held, c FROM f WHERE module <> 'src3' UNION ALL SELECT write, ctx, held, c FROM f)
        SELECT coalesce(n.write, p.write + 1) AS write, coalesce(n.ctx, p.ctx) AS ctx, CASE WHEN p.ctx IS NULL THEN 'added' WHEN n.ctx IS NULL THEN 'removed' WHEN n.c <> p.c THEN 'changed' ELSE 'same' END AS change,
            coalesce(n.held, 0) AS held FROM g n FULL JOIN (SELECT * FROM g WHERE write < 3) p ON n.ctx = p.ctx AND n.write = p.write + 1""",
    "postings_write": f"""WITH dec AS ({DECISIONS_SQL}), dt AS ({terms_sql("dec", "repo, id", HAYSTACK)}) SELECT repo, term, string_agg(id, ',' ORDER BY id) AS ids FROM dt GROUP BY ALL""",
    "ledger_roundtrip": f"""WITH led AS (SELECT * FROM {sql_for("ledger_v")}), et AS ({terms_sql("led", "repo, entry", "q")})
        SELECT l.repo, l.entry, q, a, scope, (SELECT count(*) FROM et WHERE et.repo = l.repo AND et.entry = l.entry) AS n_terms FROM led l""",
    "code_only": f"SELECT repo, path, length(content) AS n, length(content) - length(replace(content, chr(10), '')) AS lines, FALSE AS fake FROM {sql_for('javasrc_v')}",
}
