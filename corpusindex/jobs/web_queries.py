"""Python and Node sources generated from the test tables; oracles compute the facts from the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.facts.node import extract_node_facts
from corpusindex.facts.python import extract_python_facts
from corpusindex.jobs.views import view
from corpusindex.operators import web
from corpusindex.operators.changes import with_hash
from corpusindex.sources.store import spread, stored


def python_facts(spark, d):
    return web.assign_python(stored(extract_python_facts(with_hash(spread(view(spark, d, "pysrc_v"), "repo", "path")))))


def node_facts(spark, d):
    files = view(spark, d, "nodesrc_v")
    projects = files.select("repo").distinct().select("repo", F.concat(F.lit("app-"), "repo").alias("name"), F.lit("src").alias("root"))
    return stored(web.assign_feature(extract_node_facts(with_hash(spread(files, "repo", "path"))), projects, "node", files.select("repo", "path")))


def _python_frameworks(facts):
    return web.context_framework(web.python_signals(facts, web.python_routes(facts)), "python")


def _frameworks(spark, d):
    node = web.context_framework(web.node_signals(node_facts(spark, d)), "node")
    return _python_frameworks(python_facts(spark, d)).select(F.lit("python").alias("lang"), "*").unionByName(node.select(F.lit("node").alias("lang"), "*"))


def _routes_without_di(spark, d):
    facts = python_facts(spark, d)
    return web.routes_without_di(web.python_routes(facts), web.python_di(facts), _python_frameworks(facts)).select("repo", "ctx_id", "fn")


def _python_flows(spark, d):
    facts = python_facts(spark, d)
    return web.python_flows(web.python_routes(facts), web.python_di(facts)).select("repo", "fn", "flow")


def _node_flows(spark, d):
    facts = node_facts(spark, d)
    return web.node_flows(web.node_routes(facts), web.node_units(facts)).select("repo", "file", "flow")


PY = "(SELECT 'r' || (p_partkey % 2) AS repo, 'shop/shop.pkg' || (p_partkey % 9) AS ctx_id, p_partkey AS k, p_size, 'src/shop/pkg' || (p_partkey % 9) || '/m' || p_partkey || '.py' AS file FROM part)"
OK = "NOT (k % 3 = 2 AND p_size % 10 = 0)"
PY_ROUTES = f"""routes AS (
    SELECT repo, ctx_id, 'GET' AS verb, '/p' || k || '/{{item_id}}' AS path, 'read' || k AS fn, file, CASE WHEN p_size % 2 = 0 THEN ' → get_db → auth.current' ELSE '' END AS tail FROM {PY} WHERE k % 3 = 0
    UNION ALL SELECT repo, ctx_id, unnest(['GET', 'POST']), '/f' || k, 'view' || k, file, '' FROM {PY} WHERE k % 3 = 1
    UNION ALL SELECT repo, ctx_id, 'GET', '/g' || k, 'Plain' || k || '.show', file, '' FROM {PY} WHERE k % 3 = 1
    UNION ALL SELECT repo, ctx_id, 'ANY', '/d' || k || '/', 'views.D' || k, file, '' FROM {PY} WHERE k % 3 = 2
    UNION ALL SELECT repo, ctx_id, 'ANY', '/e' || k, 'handler', file, '' FROM {PY} WHERE k % 3 = 2)"""
ND = "(SELECT 'r' || (c_custkey % 2) AS repo, 'app-r' || (c_custkey % 2) || '/modules.f' || (c_custkey % 9) AS ctx_id, c_custkey AS k, 'src/modules/f' || (c_custkey % 9) || '/c' || c_custkey || '.ts' AS file FROM customer)"
ND_ROUTES = f"""routes AS (
    SELECT repo, ctx_id, file, 'GET' AS verb, '/c' || k || '/:id' AS path, 'C' || k || 'Controller.find' AS target, 5 AS line, k, ' → S' || k || 'Service → Repo' AS tail FROM {ND} WHERE k % 3 = 0
    UNION ALL SELECT repo, ctx_id, file, 'POST', '/c' || k, 'C' || k || 'Controller.create', 8, k, ' → S' || k || 'Service → Repo' FROM {ND} WHERE k % 3 = 0
    UNION ALL SELECT repo, ctx_id, file, 'GET', '/e' || k, 'users.list', 3, k, '' FROM {ND} WHERE k % 3 = 1
    UNION ALL SELECT repo, ctx_id, file, 'POST', '/e' || k, '(inline)', 4, k, '' FROM {ND} WHERE k % 3 = 1
    UNION ALL SELECT repo, ctx_id, file, 'GET', '/z' || k, '(inline)', 3, k, '' FROM {ND} WHERE k % 3 = 2)"""
FRAMEWORKS_SQL = f"""
    SELECT 'python' AS lang, repo, ctx_id, CASE any_value(k % 3) WHEN 0 THEN 'fastapi' WHEN 1 THEN 'flask' ELSE 'django' END AS framework FROM {PY} GROUP BY repo, ctx_id
    UNION ALL SELECT 'node', repo, ctx_id, CASE any_value(k % 3) WHEN 0 THEN 'nestjs' WHEN 1 THEN 'express' ELSE 'fastify' END FROM {ND} GROUP BY repo, ctx_id"""

QUERIES = {
    "python_routes": lambda s, d: web.python_routes(python_facts(s, d)),
    "python_units": lambda s, d: web.python_models(python_facts(s, d)),
    "python_flows": _python_flows,
    "python_functions": lambda s, d: web.python_functions(python_facts(s, d)),
    "python_errors": lambda s, d: python_facts(s, d).groupBy("repo").agg(F.count("*").alias("files"), F.count_if(F.col("parse_error").isNotNull()).alias("errors")),
    "node_routes": lambda s, d: web.node_routes(node_facts(s, d)),
    "node_units": lambda s, d: web.node_units(node_facts(s, d)),
    "node_flows": _node_flows,
    "frameworks": _frameworks,
    "framework_counts": lambda s, d: web.framework_counts(_frameworks(s, d)),
    "routes_without_di": _routes_without_di,
}

ORACLE = {
    "python_routes": f"WITH {PY_ROUTES} SELECT repo, ctx_id, verb, path, fn, file FROM routes",
    "python_units": f"""SELECT repo, ctx_id, CASE k % 3 WHEN 0 THEN 'Item' WHEN 1 THEN 'Plain' ELSE 'Row' END || k AS name, CASE k % 3 WHEN 0 THEN 'pydantic' WHEN 1 THEN 'class' ELSE 'django' END AS kind,
        CASE k % 3 WHEN 0 THEN 'name:str,size:int' WHEN 1 THEN '' ELSE 'title:models.CharField' END AS fields FROM {PY}""",
    "python_flows": f"WITH {PY_ROUTES} SELECT repo, fn, verb || ' ' || path || ' → ' || fn || tail AS flow FROM routes",
    "python_functions": f"SELECT repo, ctx_id, file, 'helper' AS name, '(y)' AS sig, 12 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS line FROM {PY} WHERE k % 3 = 0",
    "python_errors": f"SELECT repo, count(*) AS files, count(*) FILTER (NOT ({OK})) AS errors FROM {PY} GROUP BY repo",
    "node_routes": f"WITH {ND_ROUTES} SELECT repo, ctx_id, file, verb, path, target, 'endpoint' AS kind, line FROM routes",
    "node_units": f"""SELECT repo, file, 'C' || k || 'Controller' AS name, ctx_id, 'controller' AS kind, NULL AS scope, 'c' || k || '/' AS base_path, 'S' || k || 'Service,Repo' AS deps, NULL AS arrays, 2 AS endpoints FROM {ND} WHERE k % 3 = 0
        UNION ALL SELECT repo, file, 'S' || k || 'Service', ctx_id, 'service', 'app', NULL, 'Db', NULL, 0 FROM {ND} WHERE k % 3 = 0
        UNION ALL SELECT repo, file, 'M' || k || 'Module', ctx_id, 'module', NULL, NULL, '', 'C' || k || 'Controller|S' || k || 'Service,P||', 0 FROM {ND} WHERE k % 3 = 0""",
    "node_flows": f"WITH {ND_ROUTES} SELECT repo, file, verb || ' ' || path || ' → ' || target || tail AS flow FROM routes",
    "frameworks": FRAMEWORKS_SQL,
    "framework_counts": f"SELECT framework, count(*) AS contexts FROM ({FRAMEWORKS_SQL}) GROUP BY framework",
    "routes_without_di": f"WITH {PY_ROUTES} SELECT repo, ctx_id, fn FROM routes WHERE fn LIKE 'read%' AND tail = ''",
}
