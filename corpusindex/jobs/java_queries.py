"""Java sources generated from the test tables, from text to index; oracles compute the facts from the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.facts.java import extract_java_facts
from corpusindex.jobs.views import view
from corpusindex.operators import java
from corpusindex.operators.changes import with_hash
from corpusindex.sources.store import spread, stored


def facts(spark, d):
    """Facts of all generated files with module and context, read once and written; every second module has a project."""
    files = view(spark, d, "javasrc_v")
    projects = files.select("repo", F.substring_index("path", "/", 1).alias("dir")).distinct()
    projects = projects.where("dir <> 'mod3'").withColumn("name", F.concat(F.lit("m-"), "dir"))
    read = extract_java_facts(with_hash(spread(files, "repo", "path")))
    return stored(java.assign_java(read, projects, files.select("repo", "path")))


def _tables(spark, d):
    base = facts(spark, d)
    types = java.types_of(base)
    contexts = java.java_contexts(base)
    return base, types, contexts


def _endpoints(spark, d):
    return java.java_endpoints(java.types_of(facts(spark, d)))


def _flows(spark, d):
    _, types, contexts = _tables(spark, d)
    return java.java_flows(java.java_endpoints(types), java.java_beans(types), contexts)


def _module_index(spark, d):
    _, types, contexts = _tables(spark, d)
    return java.module_index(contexts, java.java_endpoints(types))


def _overview(spark, d):
    _, types, contexts = _tables(spark, d)
    return java.overview(contexts, java.java_endpoints(types), java.java_beans(types), java.java_entities(types))


def _cards(spark, d):
    _, types, contexts = _tables(spark, d)
    return java.context_cards(contexts, types, java.java_endpoints(types), java.java_beans(types), java.java_entities(types))


def _leaks(spark, d):
    _, types, _ = _tables(spark, d)
    return java.entity_leaks(java.java_endpoints(types), java.java_entities(types)).select("repo", "ctx_id", "fn", "entity")


def _cross(spark, d):
    _, types, contexts = _tables(spark, d)
    return java.cross_context_deps(java.java_beans(types), contexts)


def _wanted(spark, d):
    """Names to look for: an entity, a service and a method per nation."""
    n = view(spark, d, "nation").select(F.concat(F.lit("r"), (F.col("n_nationkey") % 2).cast("string")).alias("repo"), "n_nationkey")
    names = F.array(F.concat(F.lit("S"), "n_nationkey", F.lit("Entity")), F.concat(F.lit("N"), "n_nationkey", F.lit("Service")), F.lit("run"))
    return n.select("repo", F.explode(names).alias("name")).distinct()


MODULE_SQL = "CASE WHEN {0} % 5 = 3 THEN 'r' || ({0} % 2) ELSE 'm-mod' || ({0} % 5) END"
CTX_SQL = MODULE_SQL + " || '/com.shop.n' || {0}"
DATA_CTX = "m-mod0/com.shop.data"
ENDPOINTS_SQL = f"""
    ep AS (SELECT 'r' || (c_nationkey % 2) AS repo, c_nationkey AS n, c_custkey AS c, {MODULE_SQL.format("c_nationkey")} AS module, {CTX_SQL.format("c_nationkey")} AS ctx_id,
               'GET' AS verb, '/c' || c_custkey || '/{{id}}' AS path, 'C' || c_custkey || 'Controller' AS controller, 'get' AS m, 9 AS line, NULL AS req,
               'S' || (c_custkey % 7) || 'Entity' AS resp FROM customer
        UNION ALL SELECT 'r' || (c_nationkey % 2), c_nationkey, c_custkey, {MODULE_SQL.format("c_nationkey")}, {CTX_SQL.format("c_nationkey")}, 'POST', '/c' || c_custkey || '/make',
               'C' || c_custkey || 'Controller', 'create', 12, 'C' || c_custkey || 'Dto', 'List<String>' FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'r' || (c_nationkey % 2), c_nationkey, c_custkey, {MODULE_SQL.format("c_nationkey")}, {CTX_SQL.format("c_nationkey")}, 'PUT', '/c' || c_custkey,
               'C' || c_custkey || 'Controller', 'touch', 11, NULL, 'void' FROM customer WHERE c_mktsegment = 'MACHINERY')"""
BEANS_SQL = f"""
    beans AS (SELECT 'r' || (c_nationkey % 2) AS repo, {CTX_SQL.format("c_nationkey")} AS ctx_id, 'C' || c_custkey || 'Controller' AS name, '@RestController' AS stereotype,
                     'N' || c_nationkey || 'Service' AS deps FROM customer
        UNION ALL SELECT 'r' || (n_nationkey % 2), {CTX_SQL.format("n_nationkey")}, 'N' || n_nationkey || 'Service', '@Service', 'R' || n_regionkey || 'Repository' FROM nation
        UNION ALL SELECT DISTINCT 'r' || (n_nationkey % 2), '{DATA_CTX}', 'R' || n_regionkey || 'Repository', '@Repository', '' FROM nation)"""
ENTITIES_SQL = f"""
    entities AS (SELECT 'r' || (s_nationkey % 2) AS repo, {MODULE_SQL.format("s_nationkey")} AS module, {CTX_SQL.format("s_nationkey")} AS ctx_id, 'S' || s_suppkey || 'Entity' AS name,
                        CASE WHEN s_suppkey % 2 = 0 THEN 't_' || s_suppkey ELSE 's' || s_suppkey || 'entity' END AS "table", 'OneToMany:S1Entity,ManyToOne:S2Entity' AS relations,
                        CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_regionkey = s_suppkey AND n_nationkey % 2 = s_nationkey % 2) THEN 'R' || s_suppkey || 'Repository' END AS repository
                 FROM supplier)"""
FILES_SQL = f"""
    files AS (SELECT 'r' || (c_nationkey % 2) AS repo, {MODULE_SQL.format("c_nationkey")} AS module, {CTX_SQL.format("c_nationkey")} AS ctx_id, 'C' || c_custkey || 'Controller' AS name, 'mod' || (c_nationkey % 5) || '/src/C' || c_custkey || 'Controller.java' AS path FROM customer
        UNION ALL SELECT 'r' || (n_nationkey % 2), {MODULE_SQL.format("n_nationkey")}, {CTX_SQL.format("n_nationkey")}, 'N' || n_nationkey || 'Service', 'mod' || (n_nationkey % 5) || '/src/N' || n_nationkey || 'Service.java' FROM nation
        UNION ALL SELECT DISTINCT 'r' || (n_nationkey % 2), 'm-mod0', '{DATA_CTX}', 'R' || n_regionkey || 'Repository', 'mod0/src/R' || n_regionkey || 'Repository.java' FROM nation
        UNION ALL SELECT 'r' || (s_nationkey % 2), {MODULE_SQL.format("s_nationkey")}, {CTX_SQL.format("s_nationkey")}, 'S' || s_suppkey || 'Entity', 'mod' || (s_nationkey % 5) || '/src/S' || s_suppkey || 'Entity.java' FROM supplier),
    ctxs AS (SELECT repo, module, ctx_id, count(*) AS files FROM files GROUP BY ALL)"""
WITH = f"WITH {ENDPOINTS_SQL}, {BEANS_SQL}, {ENTITIES_SQL}, {FILES_SQL}"
WANTED_SQL = """wanted AS (SELECT DISTINCT 'r' || (n_nationkey % 2) AS repo, unnest(['S' || n_nationkey || 'Entity', 'N' || n_nationkey || 'Service', 'run']) AS name FROM nation)"""
REFS_SQL = f"""
    refs AS (SELECT repo, unnest(['S' || (c % 7) || 'Entity', 'N' || n || 'Service']) AS word, controller AS owner FROM ep WHERE m = 'get'
        UNION ALL SELECT 'r' || (n_nationkey % 2), unnest(['S0Entity', 'S1Entity', 'R' || n_regionkey || 'Repository']), 'N' || n_nationkey || 'Service' FROM nation
        UNION ALL SELECT DISTINCT 'r' || (n_nationkey % 2), 'S' || n_regionkey || 'Entity', 'R' || n_regionkey || 'Repository' FROM nation
        UNION ALL SELECT repo, unnest(['S1Entity', 'S2Entity']), name FROM entities)"""

QUERIES = {
    "java_modules": lambda s, d: facts(s, d).select("repo", "path", "module", "ctx_id"),
    "java_endpoints": _endpoints,
    "java_beans": lambda s, d: java.java_beans(java.types_of(facts(s, d))).select("repo", "ctx_id", "name", "stereotype", F.array_join("deps", ",").alias("deps")),
    "java_entities": lambda s, d: java.java_entities(java.types_of(facts(s, d))),
    "java_flows": lambda s, d: _flows(s, d).select("repo", "fn", "flow"),
    "java_contexts": lambda s, d: java.java_contexts(facts(s, d)).select("repo", "module", "ctx_id", "name", "file_count"),
    "module_index": _module_index,
    "context_cards": _cards,
    "context_details": lambda s, d: java.dense_types(java.types_of(facts(s, d))).select("repo", "ctx_id", "name", F.size("methods").alias("methods"), "accessors_omitted"),
    "endpoint_lines": lambda s, d: java.endpoint_lines(_endpoints(s, d)),
    "arch_style": lambda s, d: java.arch_style(java.java_contexts(facts(s, d))),
    "overview": _overview,
    "config_properties": lambda s, d: java.config_properties(java.types_of(facts(s, d))),
    "mutating_endpoints": lambda s, d: java.mutating_endpoints(_endpoints(s, d)).select("repo", "verb", "path"),
    "entity_leaks": _leaks,
    "cross_context_deps": _cross,
    "symbol_defs": lambda s, d: java.symbol_defs(java.types_of(facts(s, d)), _wanted(s, d)),
    "symbol_refs": lambda s, d: java.symbol_refs(java.types_of(facts(s, d)), _wanted(s, d)).select("repo", "word", "owner"),
    "referenced_symbols": lambda s, d: java.referenced_symbols(java.types_of(facts(s, d))).select("repo", "name", "kind"),
}

ORACLE = {
    "java_modules": f"{WITH} SELECT repo, path, module, ctx_id FROM files",
    "java_endpoints": f"{WITH} SELECT repo, module, ctx_id, verb, path, controller, controller || '.' || m AS fn, line, req, resp FROM ep",
    "java_beans": f"{WITH} SELECT * FROM beans",
    "java_entities": f"{WITH} SELECT * FROM entities",
    "java_flows": f"""{WITH} SELECT repo, controller || '.' || m AS fn, verb || ' ' || path || ' → ' || controller || '.' || m || ' → N' || n || 'Service → R' || n_regionkey || 'Repository' AS flow
        FROM ep JOIN nation ON n = n_nationkey""",
    "java_contexts": f"{WITH} SELECT repo, module, ctx_id, string_split(ctx_id, '.')[-1] AS name, files AS file_count FROM ctxs",
    "module_index": f"""{WITH} SELECT repo, module, count(*) AS contexts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS endpoints, CAST(sum(files) AS BIGINT) AS files
        FROM ctxs LEFT JOIN (SELECT repo, ctx_id, count(*) AS n FROM ep GROUP BY ALL) USING (repo, ctx_id) GROUP BY GROUPING SETS ((repo, module), (repo))""",
    "context_cards": f"""{WITH}, ty AS (SELECT repo, ctx_id, path, 0 AS place, name FROM files UNION ALL
            SELECT repo, ctx_id, path, 1, 'Kind' FROM files WHERE name LIKE 'S%Entity')
        SELECT c.repo, c.ctx_id, string_split(c.ctx_id, '.')[-1] AS name, (SELECT string_agg(name, ',' ORDER BY path, place) FROM ty WHERE ty.repo = c.repo AND ty.ctx_id = c.ctx_id) AS types,
            coalesce((SELECT string_agg(verb || ' ' || path, ',' ORDER BY verb || ' ' || path) FROM ep WHERE ep.repo = c.repo AND ep.ctx_id = c.ctx_id), '') AS endpoints,
            (SELECT count(*) FROM beans b WHERE b.repo = c.repo AND b.ctx_id = c.ctx_id) AS beans, (SELECT count(*) FROM entities e WHERE e.repo = c.repo AND e.ctx_id = c.ctx_id) AS entities FROM ctxs c""",
    "context_details": f"""{WITH} SELECT repo, ctx_id, controller AS name, 1 + count(*) AS methods, 1 AS accessors_omitted FROM ep GROUP BY ALL
        UNION ALL SELECT repo, ctx_id, name, CASE WHEN name LIKE 'N%' THEN 1 ELSE 0 END, 0 FROM files WHERE name NOT LIKE '%Controller'
        UNION ALL SELECT repo, ctx_id, 'Kind', 0, 0 FROM entities""",
    "endpoint_lines": f"""{WITH} SELECT repo, ctx_id, controller || '.' || m AS fn, verb || ' ' || path || '  ' || controller || '.' || m || '  ' || coalesce(req || ' ', '') || '-> ' || resp || '  (' || ctx_id || ')' AS line FROM ep""",
    "arch_style": f"{WITH} SELECT DISTINCT repo, 'layered (controller/service/repository)' AS style FROM ctxs",
    "overview": f"""{WITH} SELECT c.repo, c.ctx_id, files, (SELECT count(*) FROM ep WHERE ep.repo = c.repo AND ep.ctx_id = c.ctx_id) AS endpoints,
        (SELECT count(*) FROM beans b WHERE b.repo = c.repo AND b.ctx_id = c.ctx_id) AS beans, (SELECT count(*) FROM entities e WHERE e.repo = c.repo AND e.ctx_id = c.ctx_id) AS entities FROM ctxs c""",
    "config_properties": """SELECT 'r' || (s_nationkey % 2) AS repo, '@ConfigurationProperties' AS kind, 'app.s' || s_suppkey AS value, 'S' || s_suppkey || 'Entity' AS owner,
            'mod' || (s_nationkey % 5) || '/src/S' || s_suppkey || 'Entity.java' AS path FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT 'r' || (n_nationkey % 2), '@Value', '("${limit:' || n_nationkey || '}")', 'N' || n_nationkey || 'Service.limit', 'mod' || (n_nationkey % 5) || '/src/N' || n_nationkey || 'Service.java' FROM nation""",
    "mutating_endpoints": f"{WITH} SELECT repo, verb, path FROM ep WHERE verb <> 'GET'",
    "entity_leaks": f"{WITH} SELECT ep.repo, ep.ctx_id, controller || '.' || m AS fn, resp AS entity FROM ep WHERE (repo, resp) IN (SELECT (repo, name) FROM entities)",
    "cross_context_deps": f"""{WITH} SELECT b.repo, b.ctx_id, b.name AS owner, b.deps AS dep, o.ctx_id AS owner_ctx FROM beans b JOIN beans o ON o.repo = b.repo AND o.name = b.deps WHERE o.ctx_id <> b.ctx_id""",
    "symbol_defs": f"""{WITH}, {WANTED_SQL}, syms AS (SELECT repo, name, CASE WHEN name LIKE 'R%Repository' THEN 'interface' ELSE 'class' END AS kind, name AS signature, path,
            CASE WHEN name LIKE '%Controller' THEN 5 WHEN name LIKE '%Entity' THEN 3 + CASE WHEN CAST(regexp_extract(name, '[0-9]+') AS INT) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN CAST(regexp_extract(name, '[0-9]+') AS INT) % 5 = 0 THEN 1 ELSE 0 END ELSE 3 END AS line FROM files
        UNION ALL SELECT repo, 'run', 'method', name || '.run(String, int[]):List<S1Entity>', path, 9 FROM files WHERE name LIKE '%Service')
        SELECT s.* FROM syms s WHERE (repo, name) IN (SELECT (repo, name) FROM wanted)""",
    "symbol_refs": f"{WITH}, {WANTED_SQL}, {REFS_SQL} SELECT DISTINCT repo, word, owner FROM refs WHERE word <> owner AND (repo, word) IN (SELECT (repo, name) FROM wanted)",
    "referenced_symbols": f"""{WITH}, {REFS_SQL} SELECT repo, name, CASE WHEN name LIKE 'R%Repository' THEN 'interface' ELSE 'class' END AS kind FROM files
        WHERE (repo, name) IN (SELECT (repo, word) FROM refs WHERE word <> owner)""",
}
