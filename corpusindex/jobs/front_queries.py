"""Angular and React sources generated from the test tables; oracles compute the facts from the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.facts.front import extract_angular_facts, extract_react_facts
from corpusindex.jobs.views import view
from corpusindex.operators import web
from corpusindex.operators.changes import with_hash
from corpusindex.sources.store import spread, stored


def _facts(spark, d, name, extract, lang, root):
    files = view(spark, d, name)
    projects = files.select("repo").distinct().select("repo", F.concat(F.lit("app-"), "repo").alias("name"), F.lit(root).alias("root"))
    return stored(web.assign_feature(extract(with_hash(spread(files, "repo", "path"))), projects, lang, files.select("repo", "path")))


def angular_facts(spark, d):
    return _facts(spark, d, "ngsrc_v", extract_angular_facts, "angular", "src")


def react_facts(spark, d):
    return _facts(spark, d, "reactsrc_v", extract_react_facts, "react", "src")


def _angular_flows(spark, d):
    facts = angular_facts(spark, d)
    owners = web.angular_units(facts).where("kind IN ('component', 'directive')")
    return web.front_flows(web.front_routes(facts), owners).select("repo", "file", "path", "kind", "guards", "flow")


def _react_flows(spark, d):
    facts = react_facts(spark, d)
    owners = web.react_units(facts).where("kind <> 'hook'")
    return web.front_flows(web.front_routes(facts), owners).select("repo", "ctx_id", "path", "target", "line", "flow")


NG = """(SELECT 'r' || (p_partkey % 2) AS repo, 'app-r' || (p_partkey % 2) || '/features.f' || (p_partkey % 9) AS ctx_id, p_partkey AS k,
         'src/app/features/f' || (p_partkey % 9) || '/x' || p_partkey || '.ts' AS file FROM part)"""
RE = """(SELECT 'r' || (p_partkey % 2) AS repo, 'app-r' || (p_partkey % 2) || '/pages.f' || (p_partkey % 9) AS ctx_id, p_partkey AS k,
         'src/pages/f' || (p_partkey % 9) || '/x' || p_partkey || '.tsx' AS file FROM part)"""

QUERIES = {
    "angular_units": lambda s, d: web.angular_units(angular_facts(s, d)),
    "angular_http": lambda s, d: web.angular_http(angular_facts(s, d)),
    "angular_flows": _angular_flows,
    "react_units": lambda s, d: web.react_units(react_facts(s, d)),
    "react_flows": _react_flows,
}

ORACLE = {
    "angular_units": f"""
        SELECT repo, ctx_id, file, 'C' || k || 'Component' AS name, 'component' AS kind, 'app-c' || k AS selector, TRUE AS standalone, NULL AS provided_in, 'title' AS inputs,
               'changed' AS outputs, NULL AS arrays, 'Router,Api' || k || 'Service' AS deps FROM {NG} WHERE k % 3 = 0
        UNION ALL SELECT repo, ctx_id, file, 'guard' || k, 'guard', NULL, FALSE, NULL, '', '', NULL, 'Auth' || k FROM {NG} WHERE k % 3 = 0
        UNION ALL SELECT repo, ctx_id, file, 'Api' || k || 'Service', 'service', NULL, FALSE, 'root', '', '', NULL, 'HttpClient' FROM {NG} WHERE k % 3 = 1
        UNION ALL SELECT repo, ctx_id, file, 'M' || k || 'Module', 'module', NULL, FALSE, NULL, '', '', 'A,B|||A', '' FROM {NG} WHERE k % 3 = 1""",
    "angular_http": f"""
        SELECT repo, ctx_id, 'Api' || k || 'Service' AS owner, place, verb, CASE place WHEN 0 THEN '{{apiUrl}}/items' || k WHEN 1 THEN '{{apiUrl}}/items' || k || '/new' END AS url
        FROM {NG}, (VALUES (0, 'GET'), (1, 'POST'), (2, 'DELETE')) v(place, verb) WHERE k % 3 = 1""",
    "angular_flows": f"""
        WITH f AS (SELECT * FROM {NG} WHERE k % 3 = 2)
        SELECT repo, file, '' AS path, 'redirect' AS kind, '' AS guards, 'route ''/'' → ↪ p' || k AS flow FROM f
        UNION ALL SELECT repo, file, 'p' || k, 'component', 'guard' || k || ', scope("a,b")', 'route ''p' || k || ''' → C' || k || 'Component  (guards: guard' || k || ', scope("a,b"))' FROM f
        UNION ALL SELECT repo, file, 'lazy' || k, 'lazy', '', 'route ''lazy' || k || ''' → ./x' || k FROM f
        UNION ALL SELECT repo, file, 'kids' || k, 'parent', '', NULL FROM f""",
    "react_units": f"""
        SELECT repo, ctx_id, file, 'Page' || k AS name, 'function' AS kind, 'useState,useItems' || k AS hooks, 'useItems' || k AS deps, 'title,size' AS props FROM {RE} WHERE k % 3 = 0
        UNION ALL SELECT repo, ctx_id, file, 'useItems' || k, 'hook', 'useEffect,useFetch', 'useFetch', 'Query' FROM {RE} WHERE k % 3 = 1
        UNION ALL SELECT repo, ctx_id, file, 'Old' || k, 'class', '', '', '' FROM {RE} WHERE k % 3 = 1
        UNION ALL SELECT repo, ctx_id, file, 'App' || k, 'function', '', '', '' FROM {RE} WHERE k % 3 = 2""",
    "react_flows": f"""
        SELECT repo, ctx_id, p || k AS path, 'Page' || k AS target, line, 'route ''' || p || k || ''' → Page' || k AS flow
        FROM {RE}, (VALUES ('/r', 2), ('/d', 4)) v(p, line) WHERE k % 3 = 2""",
}
