"""Index tables, symbols and evidence of every language over generated sources; oracles compute them from the rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from corpusindex.jobs import front_queries as fq
from corpusindex.jobs import java_queries as jq
from corpusindex.jobs import web_queries as wq
from corpusindex.jobs.decision_queries import HASH_SQL, LEDGER_SQL, current_hashes, ledger
from corpusindex.jobs.retrieval_queries import RANKED_SQL
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import changes
from corpusindex.operators import functional as fn
from corpusindex.operators import index, java, retrieval, web
from corpusindex.operators import ledger as cache
from corpusindex.sources.store import stored

FACTS = {"java": jq.facts, "python": wq.python_facts, "node": wq.node_facts, "angular": fq.angular_facts, "react": fq.react_facts}
LANGS = tuple(FACTS)


# --- the inferred layer of the generated contexts, by the last character of an id ----------------------------------------


def _layer(contexts, routes):
    n = F.ascii(F.substring("ctx_id", -1, 1))
    keys = routes.select("repo", "ctx_id", "key").where(F.length("key") % 2 == 0).distinct()
    intents = keys.groupBy("repo", "ctx_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.concat(F.lit("do "), "key")))).alias("intents"))
    return contexts.join(intents, ["repo", "ctx_id"], "left").select(
        "repo", "ctx_id", F.when(n % 5 != 0, F.concat(F.lit("Handles "), "name", F.lit(" of "), "module")).alias("purpose"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("reads "), "name"), F.concat(F.lit("writes "), "module"))).alias("capabilities"),
        F.when(n % 3 == 0, F.array(F.concat(F.lit("rule a of "), "ctx_id"), F.concat(F.lit("rule b of "), "ctx_id"))).alias("business_rules"), "intents",
        F.when(n % 4 == 0, "old").otherwise(F.col("src_hash")).alias("src_hash"),
    )


def _themes(contexts):
    n = F.ascii(F.substring("module", -1, 1))
    modules = contexts.select("repo", "module").distinct().where(n % 2 == 0)
    return modules.select("repo", "module", F.concat(F.lit("Theme of "), "module").alias("theme"), F.when(n % 4 == 0, "k1,k2").alias("keywords"))


def _tables(lang, spark, d):
    facts = FACTS[lang](spark, d)
    contexts, routes, units = index.TABLES[lang](facts)
    return facts, stored(contexts), stored(routes), stored(units)


def _overview(lang, spark, d):
    return index.overview(*_tables(lang, spark, d)[1:], lang)


def _cards(lang, spark, d):
    _, contexts, routes, units = _tables(lang, spark, d)
    return index.context_cards(contexts, routes, units, _layer(contexts, routes), lang)


def _details(lang, spark, d):
    _, contexts, routes, units = _tables(lang, spark, d)
    return index.context_details(contexts, routes, units, _layer(contexts, routes), lang)


def _lines(lang, spark, d):
    return _tables(lang, spark, d)[2].select("repo", "ctx_id", "line")


def _module_index(lang, spark, d):
    _, contexts, routes, _ = _tables(lang, spark, d)
    return index.module_index(contexts, routes, _layer(contexts, routes), _themes(contexts))


def _styles(lang, facts, contexts):
    if lang != "angular":
        return index.architecture_style(contexts, lang)
    units = web.angular_units(facts)
    return index.architecture_style(contexts, lang, units.where("standalone AND kind = 'component'"), units.where("kind = 'module'"))


def _brief(lang, spark, d):
    facts, contexts, routes, _ = _tables(lang, spark, d)
    return index.project_brief(contexts, routes, _layer(contexts, routes), _themes(contexts), _styles(lang, facts, contexts))


# --- their oracles -------------------------------------------------------------------------------------------------------

EMPTY_SQL = "CAST(NULL AS VARCHAR)"
NG_WITH = f"""nf AS (SELECT * FROM {fq.NG}), nr AS (
    SELECT repo, ctx_id, '' AS path, 'p' || k AS target, 'redirect' AS kind, '' AS guards, 'route ''/'' → ↪ p' || k AS flow FROM nf WHERE k % 3 = 2
    UNION ALL SELECT repo, ctx_id, 'p' || k, 'C' || k || 'Component', 'component', 'guard' || k || ', scope("a,b")', 'route ''p' || k || ''' → C' || k || 'Component  (guards: guard' || k || ', scope("a,b"))' FROM nf WHERE k % 3 = 2
    UNION ALL SELECT repo, ctx_id, 'lazy' || k, './x' || k, 'lazy', '', 'route ''lazy' || k || ''' → ./x' || k FROM nf WHERE k % 3 = 2
    UNION ALL SELECT repo, ctx_id, 'kids' || k, NULL, 'parent', '', NULL FROM nf WHERE k % 3 = 2)"""
C_SQL = "SELECT repo, ctx_id, split_part(ctx_id, '/', 1) AS module, {name} AS name, {framework} AS framework, count(*) AS files FROM {source} GROUP BY repo, ctx_id"
LOCAL = "split_part(ctx_id, '/', 2)"
#: CTEs c (contexts), r (routes) and u (units) of each language.
BASE_SQL = {
    "java": f"""{jq.ENDPOINTS_SQL}, {jq.BEANS_SQL}, {jq.ENTITIES_SQL}, {jq.FILES_SQL},
        c AS (SELECT repo, ctx_id, module, string_split(ctx_id, '.')[-1] AS name, {EMPTY_SQL} AS framework, files FROM ctxs),
        r AS (SELECT repo, ctx_id, controller || '.' || m AS key, controller || '.' || m AS title, verb || ' ' || path AS label,
                verb || ' ' || path || '  ' || controller || '.' || m || '  ' || coalesce(req || ' ', '') || '-> ' || resp || '  (' || ctx_id || ')' AS line,
                verb || ' ' || path || '  (' || controller || ')' AS brief,
                verb || ' ' || path || ' → ' || controller || '.' || m || ' → N' || n || 'Service → R' || n_regionkey || 'Repository' AS flow FROM ep JOIN nation ON n = n_nationkey),
        u AS (SELECT repo, ctx_id, 'types' AS grp, name FROM files UNION ALL SELECT repo, ctx_id, 'types', 'Kind' FROM entities
              UNION ALL SELECT repo, ctx_id, 'beans', name FROM beans UNION ALL SELECT repo, ctx_id, 'entities', name FROM entities)""",
    "python": f"""pf AS (SELECT * FROM {wq.PY}), {wq.PY_ROUTES},
        c AS ({C_SQL.format(name="string_split(ctx_id, '.')[-1]", framework="CASE any_value(k % 3) WHEN 0 THEN 'fastapi' WHEN 1 THEN 'flask' ELSE 'django' END", source="pf")}),
        r AS (SELECT repo, ctx_id, path AS key, fn AS title, verb || ' ' || path AS label, verb || ' ' || path || '  ' || fn || '  (' || ctx_id || ')' AS line,
                verb || ' ' || path || '  (' || fn || ')' AS brief, verb || ' ' || path || ' → ' || fn || tail AS flow FROM routes),
        u AS (SELECT repo, ctx_id, CASE WHEN k % 3 = 1 THEN 'classes' ELSE 'models' END AS grp, CASE k % 3 WHEN 0 THEN 'Item' WHEN 1 THEN 'Plain' ELSE 'Row' END || k AS name FROM pf)""",
    "node": f"""nf AS (SELECT * FROM {wq.ND}), {wq.ND_ROUTES},
        c AS ({C_SQL.format(name=LOCAL, framework="CASE any_value(k % 3) WHEN 0 THEN 'nestjs' WHEN 1 THEN 'express' ELSE 'fastify' END", source="nf")}),
        r AS (SELECT repo, ctx_id, path AS key, target AS title, verb || ' ' || path || ' → ' || target AS label, verb || ' ' || path || '  ' || target || '  (' || ctx_id || ')' AS line,
                verb || ' ' || path || ' → ' || target AS brief, verb || ' ' || path || ' → ' || target || tail AS flow FROM routes),
        u AS (SELECT repo, ctx_id, 'controllers' AS grp, 'C' || k || 'Controller' AS name FROM nf WHERE k % 3 = 0 UNION ALL SELECT repo, ctx_id, 'services', 'S' || k || 'Service' FROM nf WHERE k % 3 = 0)""",
    "angular": f"""{NG_WITH}, c AS ({C_SQL.format(name=LOCAL, framework=EMPTY_SQL, source="nf")}),
        r AS (SELECT repo, ctx_id, path AS key, coalesce(target, path) AS title, coalesce(nullif(path, ''), '/') || ' → ' || coalesce(target, kind) AS label,
                coalesce(nullif(path, ''), '/') || ' → ' || coalesce(target, '-') || '  ' || kind || CASE WHEN guards <> '' THEN '  guards: ' || guards ELSE '' END || '  (' || ctx_id || ')' AS line,
                coalesce(nullif(path, ''), '/') || ' → ' || coalesce(target, kind) AS brief, flow FROM nr),
        u AS (SELECT repo, ctx_id, 'components' AS grp, 'C' || k || 'Component' AS name FROM nf WHERE k % 3 = 0 UNION ALL SELECT repo, ctx_id, 'services', 'Api' || k || 'Service' FROM nf WHERE k % 3 = 1)""",
    "react": f"""nf AS (SELECT * FROM {fq.RE}), c AS ({C_SQL.format(name=LOCAL, framework=EMPTY_SQL, source="nf")}),
        r AS (SELECT repo, ctx_id, p || k AS key, 'Page' || k AS title, p || k || ' → Page' || k AS label, p || k || ' → Page' || k || '  route  (' || ctx_id || ')' AS line,
                p || k || ' → Page' || k AS brief, 'route ''' || p || k || ''' → Page' || k || ' → useItems' || k AS flow FROM nf, (VALUES ('/r'), ('/d')) v(p) WHERE k % 3 = 2),
        u AS (SELECT repo, ctx_id, 'components' AS grp, CASE k % 3 WHEN 0 THEN 'Page' WHEN 1 THEN 'Old' ELSE 'App' END || k AS name FROM nf
              UNION ALL SELECT repo, ctx_id, 'services', 'useItems' || k FROM nf WHERE k % 3 = 1)""",
}
# a page and its route are never of one number in the generated sources, so no route of theirs has dependencies
BASE_SQL["react"] = BASE_SQL["react"].replace(" || ' → useItems' || k AS flow", " AS flow")
LAYER_SQL = """
    f AS (SELECT repo, ctx_id, CASE WHEN ascii(right(ctx_id, 1)) % 5 <> 0 THEN 'Handles ' || name || ' of ' || module END AS purpose,
            CASE WHEN ascii(right(ctx_id, 1)) % 2 = 0 THEN 'reads ' || name END AS cap1, CASE WHEN ascii(right(ctx_id, 1)) % 2 = 0 THEN 'writes ' || module END AS cap2,
            ascii(right(ctx_id, 1)) % 3 = 0 AS ruled, ascii(right(ctx_id, 1)) % 4 = 0 AS stale, module FROM c),
    themes AS (SELECT DISTINCT repo, module, 'Theme of ' || module AS theme, CASE WHEN ascii(right(module, 1)) % 4 = 0 THEN 'k1,k2' END AS keywords FROM c WHERE ascii(right(module, 1)) % 2 = 0)"""


def _with(lang):
    return f"WITH {BASE_SQL[lang]}, {LAYER_SQL}"


def _names_sql(lang):
    return ", ".join(f"coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM u WHERE u.repo = c.repo AND u.ctx_id = c.ctx_id AND grp = '{g}'), '') AS {g}" for g in index.GROUPS[lang])


LABELS_SQL = "coalesce((SELECT string_agg(label, ', ' ORDER BY label) FROM r WHERE r.repo = c.repo AND r.ctx_id = c.ctx_id), '') AS labels"
CAPS_SQL = "nullif(concat_ws('; ', f.cap1, f.cap2), '')"
STYLE_SQL = {
    "java": "'layered (controller/service/repository)'",
    "angular": "'mixed (standalone + NgModule)'",
    "react": "'React'",
    "node": "(SELECT string_agg(DISTINCT framework, ' + ' ORDER BY framework) FROM c q WHERE q.repo = c.repo)",
    "python": "(SELECT string_agg(framework, ' + ' ORDER BY first) || ' (mixed)' FROM (SELECT framework, min(ctx_id) AS first FROM c q WHERE q.repo = c.repo GROUP BY framework))",
}


def _overview_sql(lang):
    counts = ", ".join(f"(SELECT count(*) FROM u WHERE u.repo = c.repo AND u.ctx_id = c.ctx_id AND grp = '{g}') AS {g}" for g in index.GROUPS[lang])
    return f"{_with(lang)} SELECT repo, ctx_id, files, (SELECT count(*) FROM r WHERE r.repo = c.repo AND r.ctx_id = c.ctx_id) AS routes, {counts} FROM c"


def _cards_sql(lang):
    return f"{_with(lang)} SELECT c.repo, c.ctx_id, name, framework, purpose, {CAPS_SQL} AS capabilities, {_names_sql(lang)}, {LABELS_SQL} FROM c JOIN f ON f.repo = c.repo AND f.ctx_id = c.ctx_id"


def _details_sql(lang):
    intent = "CASE WHEN length(key) % 2 = 0 THEN 'do ' || key END"
    return f"""{_with(lang)} SELECT c.repo, c.ctx_id, c.module, name, framework, purpose, stale AS functional_stale, {CAPS_SQL} AS capabilities,
        CASE WHEN ruled THEN 'rule a of ' || c.ctx_id || '; rule b of ' || c.ctx_id END AS rules, {_names_sql(lang)}, {LABELS_SQL},
        coalesce((SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT coalesce({intent}, title) || ': ' || flow AS x FROM r WHERE r.repo = c.repo AND r.ctx_id = c.ctx_id AND flow IS NOT NULL)), '') AS use_cases,
        coalesce((SELECT string_agg(x, '; ' ORDER BY x) FROM (SELECT label || ' = ' || {intent} AS x FROM r WHERE r.repo = c.repo AND r.ctx_id = c.ctx_id)), '') AS intended
        FROM c JOIN f ON f.repo = c.repo AND f.ctx_id = c.ctx_id"""


STOPS_SQL = ", ".join(f"'{w}'" for w in fn.KEYWORD_STOPS)


def _index_sql(lang):
    return f"""{_with(lang)},
        words AS (SELECT repo, module, unnest(string_split_regex(lower(concat_ws(' ', coalesce(purpose, ''), cap1, cap2)), '[^a-zàâäéèêëïîôöùûüç0-9]+')) AS word FROM f),
        tops AS (SELECT *, row_number() OVER (PARTITION BY repo, module ORDER BY n DESC, word) AS place FROM (SELECT repo, module, word, count(*) AS n FROM words WHERE length(word) >= 3 AND word NOT IN ({STOPS_SQL}) GROUP BY ALL)),
        kw AS (SELECT repo, module, string_agg(word, ',' ORDER BY place) AS found FROM tops WHERE place <= 6 GROUP BY ALL),
        sums AS (SELECT repo, module, count(*) AS contexts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS routes, CAST(sum(files) AS BIGINT) AS files
                 FROM c LEFT JOIN (SELECT repo, ctx_id, count(*) AS n FROM r GROUP BY ALL) USING (repo, ctx_id) GROUP BY GROUPING SETS ((repo, module), (repo)))
        SELECT s.repo, s.module, theme, coalesce(keywords, found) AS keywords, contexts, routes, files FROM sums s LEFT JOIN themes t ON t.repo = s.repo AND t.module = s.module LEFT JOIN kw ON kw.repo = s.repo AND kw.module = s.module"""


def _brief_sql(lang):
    return f"""{_with(lang)}, total AS (SELECT repo, count(*) AS total FROM r GROUP BY repo),
        rules AS (SELECT repo, ctx_id, pos, 'rule ' || l || ' of ' || ctx_id AS rule FROM f, (VALUES (0, 'a'), (1, 'b')) v(pos, l) WHERE ruled)
        SELECT DISTINCT repo, 'arch' AS kind, NULL AS place, NULL AS name, {STYLE_SQL[lang]} AS text, NULL AS contexts, NULL AS routes FROM c
        UNION ALL SELECT f.repo, 'module', NULL, f.module, coalesce(any_value(theme), min_by(purpose, f.ctx_id) FILTER (purpose IS NOT NULL)), count(*),
            CAST(sum(coalesce(n, 0)) AS BIGINT) FROM f LEFT JOIN themes USING (repo, module) LEFT JOIN (SELECT repo, ctx_id, count(*) AS n FROM r GROUP BY ALL) q ON q.repo = f.repo AND q.ctx_id = f.ctx_id GROUP BY f.repo, f.module
        UNION ALL SELECT repo, 'rule', place, NULL, rule, NULL, NULL FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ctx_id, pos) AS place FROM rules) WHERE place <= 8
        UNION ALL SELECT repo, 'route', NULL, NULL, brief, NULL, NULL FROM r WHERE repo IN (SELECT repo FROM total WHERE total <= 50)
        UNION ALL SELECT repo, 'routes', NULL, NULL, NULL, NULL, total FROM total WHERE total > 50"""


# --- symbols -------------------------------------------------------------------------------------------------------------


def _wanted(spark, d):
    """Names to look for in every repo: some of each kind, of every tenth part and customer."""
    k = F.col("k").cast("string")
    parts = view(spark, d, "part").select(F.col("p_partkey").alias("k")).where("k % 10 = 0")
    names = [F.concat(F.lit(a), k, F.lit(b)) for a, b in (("C", "Component"), ("Api", "Service"), ("Auth", ""), ("guard", ""), ("Item", ""), ("read", ""), ("Page", ""), ("useItems", ""))]
    found = parts.select(F.explode(F.array(*names)).alias("name"))
    customers = view(spark, d, "customer").select(F.col("c_custkey").alias("k")).where("k % 10 = 0")
    found = found.unionByName(customers.select(F.explode(F.array(F.concat(F.lit("C"), k, F.lit("Controller")), F.concat(F.lit("S"), k, F.lit("Service")))).alias("name")))
    fixed = parts.select(F.explode(F.array(*[F.lit(n) for n in ("find", "create", "helper", "make", "get_db", "User", "BaseModel")])).alias("name")).distinct()
    repos = parts.select(F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("repo")).distinct()
    return found.unionByName(fixed).distinct().crossJoin(F.broadcast(repos))


WEB_LANGS = ("python", "node", "angular", "react")


def _web_symbols(table, column, columns, spark, d):
    wanted, out = stored(_wanted(spark, d)), None
    for lang in WEB_LANGS:
        part = index.by_name(table(FACTS[lang](spark, d), lang), wanted, column).select(F.lit(lang).alias("lang"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


def _referenced(spark, d):
    out = None
    for lang in WEB_LANGS:
        facts = FACTS[lang](spark, d)
        words = index.reference_words(facts, lang).select("repo", F.col("word").alias("name"))
        part = index.symbol_table(facts, lang).join(words, ["repo", "name"], "left_semi").select(F.lit(lang).alias("lang"), "repo", "name", "kind", "path")
        out = part if out is None else out.unionByName(part)
    return out


KEY10 = "k % 10 = 0"
SYMBOLS_SQL = f"""
    syms AS (
        SELECT 'python' AS lang, repo, 'Item' || k AS name, 'class' AS kind, 'Item' || k AS signature, file AS path, 3 AS line, k FROM {wq.PY} WHERE k % 3 = 0
        UNION ALL SELECT 'python', repo, 'read' || k, 'def', 'read' || k || CASE WHEN p_size % 2 = 0 THEN '(item_id: int, db=Depends(get_db), user: User=Depends(auth.current))' ELSE '(item_id: int)' END, file, 8, k FROM {wq.PY} WHERE k % 3 = 0
        UNION ALL SELECT 'python', repo, 'helper', 'def', 'helper(y)', file, 12 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END, 0 FROM {wq.PY} WHERE k % 3 = 0
        UNION ALL SELECT 'node', repo, 'C' || k || 'Controller', 'class', 'C' || k || 'Controller', file, 3, k FROM {wq.ND} WHERE k % 3 = 0
        UNION ALL SELECT 'node', repo, 'S' || k || 'Service', 'class', 'S' || k || 'Service', file, 12, k FROM {wq.ND} WHERE k % 3 = 0
        UNION ALL SELECT 'node', repo, 'find', 'method', 'C' || k || 'Controller.find(id: string)', file, 7, 0 FROM {wq.ND} WHERE k % 3 = 0
        UNION ALL SELECT 'node', repo, 'create', 'method', 'C' || k || 'Controller.create()', file, 9, 0 FROM {wq.ND} WHERE k % 3 = 0
        UNION ALL SELECT 'angular', repo, 'C' || k || 'Component', 'class', 'C' || k || 'Component', file, 3, k FROM {fq.NG} WHERE k % 3 = 0
        UNION ALL SELECT 'angular', repo, 'guard' || k, 'guard', 'guard' || k, file, 9, k FROM {fq.NG} WHERE k % 3 = 0
        UNION ALL SELECT 'angular', repo, 'Api' || k || 'Service', 'class', 'Api' || k || 'Service', file, 2, k FROM {fq.NG} WHERE k % 3 = 1
        UNION ALL SELECT 'angular', repo, 'make', 'method', 'Api' || k || 'Service.make(b: Item)', file, 6, 0 FROM {fq.NG} WHERE k % 3 = 1
        UNION ALL SELECT 'react', repo, 'Page' || k, 'component', 'Page' || k, file, 2, k FROM {fq.RE} WHERE k % 3 = 0
        UNION ALL SELECT 'react', repo, 'useItems' || k, 'hook', 'useItems' || k, file, 1, k FROM {fq.RE} WHERE k % 3 = 1)"""
WEB_REFS_SQL = f"""
    refs AS (
        SELECT 'python' AS lang, repo, 'BaseModel' AS word, 'Item' || k AS owner, 0 AS k FROM {wq.PY} WHERE k % 3 = 0
        UNION ALL SELECT 'python', repo, unnest(['get_db', 'User']), 'read' || k, 0 FROM {wq.PY} WHERE k % 3 = 0 AND p_size % 2 = 0
        UNION ALL SELECT 'node', repo, 'S' || k || 'Service', 'C' || k || 'Controller', k FROM {wq.ND} WHERE k % 3 = 0
        UNION ALL SELECT 'angular', repo, 'Api' || k || 'Service', 'C' || k || 'Component', k FROM {fq.NG} WHERE k % 3 = 0
        UNION ALL SELECT 'angular', repo, 'Auth' || k, 'guard' || k, k FROM {fq.NG} WHERE k % 3 = 0
        UNION ALL SELECT 'react', repo, 'useItems' || k, 'Page' || k, k FROM {fq.RE} WHERE k % 3 = 0)"""


# --- evidence ------------------------------------------------------------------------------------------------------------


def _module_sums(contexts):
    return contexts.groupBy("repo", "module").agg(F.count("*").alias("contexts"), F.sum("files").alias("files"))


def _rollup(spark, d):
    """Contexts and modules of Python sources after some files came, changed and went, from those before and the changes."""
    new = wq.python_facts(spark, d).select("repo", "path", "ctx_id", "module", "hash").withColumn("k", F.regexp_extract("path", "m([0-9]+)[.]py$", 1).cast("long"))
    new = stored(new)
    kept = new.where("k % 13 <> 0").withColumn("hash", F.when(F.col("k") % 17 == 0, "old").otherwise(F.col("hash")))
    gone = new.where("k % 11 = 0").withColumns({"path": F.concat(F.lit("gone/"), "path"), "ctx_id": F.when(F.col("k") % 2 == 0, "lost/x").otherwise(F.col("ctx_id"))})
    old = stored(kept.unionByName(gone))
    manifest = old.select("repo", "path", "hash", F.lit(None).cast("string").alias("parse_error"), F.lit("E").alias("engine_hash"), F.lit(True).alias("cached"))
    classes = stored(changes.classify_changes(new, manifest, "E"))
    contexts, build = stored(index.contexts_of(old, "python")), lambda rows: index.contexts_of(rows, "python")
    modules = stored(_module_sums(contexts))
    keys = ("repo", "ctx_id", "module")
    touched = stored(changes.touched_groups(classes, old, new, *keys))
    contexts = stored(changes.rolled_up(contexts, new, touched, keys, build))
    modules = changes.rolled_up(modules, contexts, touched.select("repo", "module").distinct(), ("repo", "module"), _module_sums)
    below = contexts.select("repo", "module", "ctx_id", "files", "src_hash")
    return below.unionByName(modules.select("repo", "module", F.lit(None).cast("string").alias("ctx_id"), "files", F.col("contexts").cast("string").alias("src_hash")))


def _packs(spark, d):
    """Packs of the generated Python contexts, of which every source is eligible."""
    _, contexts, routes, units = _tables("python", spark, d)
    facts = wq.python_facts(spark, d).select("repo", "ctx_id", "path")
    files = view(spark, d, "pysrc_v").join(facts, ["repo", "path"]).select("repo", "ctx_id", "path", "content", F.col("k").alias("place"))
    return fn.evidence_packs(contexts, routes, units, fn.evidence_sources(files))


def _eligible(spark, d):
    """The files of each language that are evidence, some of the front ends' under telling names."""
    out = None
    for lang, source in (("java", "javasrc_v"), ("python", "pysrc_v"), ("node", "nodesrc_v"), ("angular", "ngsrc_v"), ("react", "reactsrc_v")):
        facts = FACTS[lang](spark, d)
        files = facts.select("repo", "ctx_id", "path").join(view(spark, d, source).select("repo", "path", "content"), ["repo", "path"])
        number = F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long")
        if lang not in ("java", "python"):
            telling = F.when(number % 5 == 0, ".service.ts").when(number % 5 == 1, "-routing.js").when(number % 5 == 2, ".pipes.ts").otherwise(F.regexp_extract("path", r"\.[a-z]+$", 0))
            files = files.withColumn("path", F.concat(F.regexp_replace("path", r"\.[a-z]+$", ""), telling))
        types = java.types_of(facts) if lang == "java" else None
        part = fn.eligible_files(files, lang, types).select(F.lit(lang).alias("lang"), "repo", "ctx_id", "path", F.col("place.nth").alias("nth"))
        out = part if out is None else out.unionByName(part)
    return out


def _telling_sql(lang, source):
    named = "CASE k % 5 WHEN 0 THEN '.service.ts' WHEN 1 THEN '-routing.js' ELSE '' END"
    return f"SELECT '{lang}' AS lang, repo, ctx_id, regexp_replace(file, '\\.[a-z]+$', '') || {named} AS path, 0 AS nth FROM {source} WHERE k % 5 < 2"


def _structure(spark, d):
    """The whole rows of Java contexts, their structs as lines."""
    facts, contexts, routes, units = _tables("java", spark, d)
    types = java.types_of(facts)
    beans = java.java_beans(types)
    rows = index.java_details(contexts, routes, units, _layer(contexts, routes), types, beans, java.java_entities(types))
    lines = lambda column, line: F.coalesce(F.array_join(F.array_sort(F.transform(column, line)), "; "), F.lit("")).alias(column)
    return rows.select(
        "repo", "ctx_id", "purpose", "rules",
        lines("dense_types", lambda t: F.concat_ws(" ", t["name"], F.size(t["methods"]).cast("string"), t["accessors_omitted"].cast("string"))),
        lines("beans", lambda b: F.concat_ws(" ", b["name"], b["stereotype"], F.array_join(b["deps"], ","))),
        lines("entities", lambda e: F.concat_ws(" ", e["name"], e["table"], e["relations"], e["repository"])),
    )


PACKS_SQL = f"""
    {_with("python")},
    src AS (SELECT v.repo, p.ctx_id, v.path, v.k AS place, content AS source FROM {sql_for("pysrc_v")} v JOIN {wq.PY} p ON p.k = v.k),
    running AS (SELECT *, coalesce(sum(length(source)) OVER (PARTITION BY repo, ctx_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM src),
    packs AS (SELECT c.repo, c.ctx_id,
        (SELECT string_agg(flow, chr(10) ORDER BY flow) FROM r WHERE r.repo = c.repo AND r.ctx_id = c.ctx_id) AS routes,
        (SELECT string_agg(grp || ' ' || name, chr(10) ORDER BY grp || ' ' || name) FROM u WHERE u.repo = c.repo AND u.ctx_id = c.ctx_id) AS units,
        (SELECT string_agg(path || chr(10) || source, chr(10) ORDER BY place) FROM running q WHERE q.repo = c.repo AND q.ctx_id = c.ctx_id AND before < 16000) AS sources,
        (SELECT max(before) FROM running q WHERE q.repo = c.repo AND q.ctx_id = c.ctx_id) >= 16000 AS truncated FROM c)"""
EVIDENCE_SQL = HASH_SQL.format("concat_ws(chr(10), ctx_id, routes, units, sources)")


def _stale_packs(spark, d):
    """After a reset of the inferred layer every context is stale, with the hash of its pack."""
    hashes = fn.evidence_hash(_packs(spark, d))
    return fn.stale_contexts(hashes, fn.reset_functional(hashes), 5)


# --- answers from the cache or the index, and payloads in full ------------------------------------------------------------


def _ask_tables(spark, d):
    _, contexts, routes, units = _tables("java", spark, d)
    words = units.where("grp = 'types' AND name LIKE 'C%'").groupBy("repo", "ctx_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("words"))
    hay = contexts.join(words, ["repo", "ctx_id"], "left").select("repo", F.col("ctx_id").alias("id"), F.concat_ws(" ", "ctx_id", "words").alias("hay"))
    return contexts, routes, units, hay


def _payload(spark, d):
    contexts, routes, units, hay = _ask_tables(spark, d)
    layer = _layer(contexts, routes)
    cards = index.context_cards(contexts, routes, units, layer, "java")
    cards = cards.select("repo", F.col("ctx_id").alias("id"), F.concat_ws(" | ", "name", "purpose", "types").alias("text"))
    rules = layer.select("repo", F.col("ctx_id").alias("id"), F.explode("business_rules").alias("text"))
    calls, flows = (routes.select("repo", F.col("ctx_id").alias("id"), F.col(c).alias("text")) for c in ("label", "flow"))
    hits = retrieval.adaptive_top(retrieval.ask(view(spark, d, "queries_v"), hay))
    return retrieval.ask_payload(stored(hits), calls, rules, cards, flows)


def _cached_ask(spark, d):
    """The ledger answers first; only questions without a fresh answer are put to the index."""
    found = stored(cache.answer_lookup(view(spark, d, "queries_v"), ledger(spark, d), current_hashes(spark, d), "new"))
    rest = view(spark, d, "queries_v").join(found.where("verdict = 'fresh'"), ["repo", "query_id"], "left_anti")
    hits = retrieval.adaptive_top(retrieval.ask(rest, _ask_tables(spark, d)[3]))
    return cache.cached_or(found, ledger(spark, d), hits)


HITS_SQL = f"""{_with("java")},
    ctx AS (SELECT c.repo, c.ctx_id AS id, concat_ws(' ', c.ctx_id, (SELECT string_agg(DISTINCT name, ' ' ORDER BY name) FROM u WHERE u.repo = c.repo AND u.ctx_id = c.ctx_id AND grp = 'types' AND name LIKE 'C%')) AS hay FROM c),
    words AS (SELECT repo, query_id, unnest(string_split_regex(lower(q), '\\s+')) AS word FROM {sql_for("queries_v")}),
    scored AS (SELECT w.repo, query_id, id, CAST(count(*) AS DOUBLE) AS score FROM words w JOIN ctx ON w.repo = ctx.repo AND contains(lower(hay), word) WHERE word <> '' GROUP BY ALL),
    {RANKED_SQL}"""

QUERIES = {"symbol_defs_web": partial(_web_symbols, index.symbol_table, "name", ("repo", "name", "kind", "signature", "path", "line")),
           "symbol_refs_web": partial(_web_symbols, index.reference_words, "word", ("repo", "word", "owner")),
           "referenced_symbols_web": _referenced,
           "incremental_rollup": _rollup, "evidence_eligible": _eligible, "java_details_full": _structure,
           "evidence_packs": lambda s, d: _packs(s, d).select("repo", "ctx_id", "routes", "units", F.length("sources").alias("n_chars"), "truncated"),
           "evidence_hashes": lambda s, d: fn.evidence_hash(_packs(s, d)),
           "reset_stale": _stale_packs, "ask_payload_full": _payload, "cached_ask": _cached_ask}
ORACLE = {
    "symbol_defs_web": f"WITH {SYMBOLS_SQL} SELECT lang, repo, name, kind, signature, path, line FROM syms WHERE {KEY10}",
    "symbol_refs_web": f"WITH {WEB_REFS_SQL} SELECT lang, repo, word, owner FROM refs WHERE {KEY10}",
    "referenced_symbols_web": f"SELECT 'node' AS lang, repo, 'S' || k || 'Service' AS name, 'class' AS kind, file AS path FROM {wq.ND} WHERE k % 3 = 0",
    "incremental_rollup": f"""WITH h AS (SELECT p.repo, p.ctx_id, split_part(p.ctx_id, '/', 1) AS module, {HASH_SQL.format("content")} AS h FROM {wq.PY} p JOIN {sql_for("pysrc_v")} v ON v.k = p.k),
        c AS (SELECT repo, module, ctx_id, count(*) AS files, {HASH_SQL.format("string_agg(h, '|' ORDER BY h)")} AS src_hash FROM h GROUP BY ALL)
        SELECT * FROM c UNION ALL SELECT repo, module, NULL, CAST(sum(files) AS BIGINT), CAST(count(*) AS VARCHAR) FROM c GROUP BY repo, module""",
    "evidence_eligible": f"""WITH {jq.FILES_SQL.strip()} SELECT 'java' AS lang, repo, ctx_id, path, 0 AS nth FROM files
        UNION ALL SELECT 'python', repo, ctx_id, file, 0 FROM {wq.PY}
        UNION ALL {_telling_sql("node", wq.ND)} UNION ALL {_telling_sql("angular", fq.NG)} UNION ALL {_telling_sql("react", fq.RE)}""",
    "java_details_full": f"""{_with("java")},
        dense AS (SELECT repo, ctx_id, controller || ' ' || (1 + count(*)) || ' 1' AS line FROM ep GROUP BY repo, ctx_id, controller
            UNION ALL SELECT repo, ctx_id, name || CASE WHEN name LIKE 'N%' THEN ' 1' ELSE ' 0' END || ' 0' FROM files WHERE name NOT LIKE '%Controller' UNION ALL SELECT repo, ctx_id, 'Kind 0 0' FROM entities)
        SELECT c.repo, c.ctx_id, purpose, CASE WHEN ruled THEN 'rule a of ' || c.ctx_id || '; rule b of ' || c.ctx_id END AS rules,
            coalesce((SELECT string_agg(line, '; ' ORDER BY line) FROM dense x WHERE x.repo = c.repo AND x.ctx_id = c.ctx_id), '') AS dense_types,
            coalesce((SELECT string_agg(line, '; ' ORDER BY line) FROM (SELECT name || ' ' || stereotype || ' ' || deps AS line FROM beans x WHERE x.repo = c.repo AND x.ctx_id = c.ctx_id)), '') AS beans,
            coalesce((SELECT string_agg(line, '; ' ORDER BY line) FROM (SELECT concat_ws(' ', name, "table", relations, repository) AS line FROM entities x WHERE x.repo = c.repo AND x.ctx_id = c.ctx_id)), '') AS entities
        FROM c JOIN f ON f.repo = c.repo AND f.ctx_id = c.ctx_id""",
    "evidence_packs": f"{PACKS_SQL} SELECT repo, ctx_id, routes, units, length(sources) AS n_chars, truncated FROM packs",
    "evidence_hashes": f"{PACKS_SQL} SELECT repo, ctx_id, {EVIDENCE_SQL} AS evidence_hash FROM packs",
    "reset_stale": f"""{PACKS_SQL} SELECT repo, ctx_id, 'missing' AS reason, evidence_hash, total_stale FROM (SELECT repo, ctx_id, {EVIDENCE_SQL} AS evidence_hash,
        count(*) OVER (PARTITION BY repo) AS total_stale, row_number() OVER (PARTITION BY repo ORDER BY ctx_id) AS n FROM packs) WHERE n <= 5""",
    "ask_payload_full": f"""{HITS_SQL},
        cards AS (SELECT c.repo, c.ctx_id AS id, concat_ws(' | ', name, purpose, (SELECT string_agg(name, ',' ORDER BY name) FROM u WHERE u.repo = c.repo AND u.ctx_id = c.ctx_id AND grp = 'types')) AS text FROM c JOIN f ON f.repo = c.repo AND f.ctx_id = c.ctx_id)
        SELECT h.repo, query_id, h.id, rank, 'endpoint' AS kind, label AS text FROM hits h JOIN r ON r.repo = h.repo AND r.ctx_id = h.id
        UNION ALL SELECT h.repo, query_id, h.id, rank, 'card', text FROM hits h JOIN cards ON cards.repo = h.repo AND cards.id = h.id
        UNION ALL SELECT h.repo, query_id, h.id, rank, 'flow', flow FROM hits h JOIN r ON r.repo = h.repo AND r.ctx_id = h.id WHERE rank = 1
        UNION ALL SELECT h.repo, query_id, h.id, rank, 'rule', 'rule ' || l || ' of ' || h.id FROM hits h JOIN f ON f.repo = h.repo AND f.ctx_id = h.id, (VALUES ('a'), ('b')) v(l) WHERE rank = 1 AND ruled""",
    "cached_ask": f"""{HITS_SQL}, {LEDGER_SQL}
        SELECT repo, query_id, 'cache' AS origin, a AS answer, NULL AS id, NULL AS score, NULL AS rank FROM verdicts WHERE verdict = 'fresh'
        UNION ALL SELECT repo, query_id, 'index', NULL, id, score, rank FROM hits WHERE (repo, query_id) NOT IN (SELECT (repo, query_id) FROM verdicts WHERE verdict = 'fresh')""",
}
for _lang in LANGS:
    for _name, _query, _sql in (
        ("overview", _overview, _overview_sql), ("cards", _cards, _cards_sql), ("details", _details, _details_sql), ("module_index", _module_index, _index_sql),
        ("brief", _brief, _brief_sql),
    ):
        QUERIES[f"{_lang}_{_name}"] = partial(_query, _lang)
        ORACLE[f"{_lang}_{_name}"] = _sql(_lang)
    QUERIES[f"{_lang}_lines"] = partial(_lines, _lang)
    ORACLE[f"{_lang}_lines"] = f"{_with(_lang)} SELECT repo, ctx_id, line FROM r"
