"""Index tables over the contexts of any language: cards, details, lines, overviews, briefs, symbols. Keys are per repo.

Every language gives the same three tables. `contexts`: repo, ctx_id, module, name, framework, files, src_hash. `routes`:
repo, ctx_id, key (by which the inferred layer names an intent), title, label, line, brief, flow. `units`: repo, ctx_id,
grp, name. The inferred layer, `functional`, has repo, ctx_id, purpose, capabilities, business_rules, intents and src_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.operators import java, web
from corpusindex.operators.digests import group_digest
from corpusindex.operators.functional import module_keywords

# What a context of each language lists, and how a repo without a framework is described.
GROUPS = {
    "java": ("types", "beans", "entities"),
    "angular": ("components", "services"),
    "node": ("controllers", "services"),
    "react": ("components", "services"),
    "python": ("models", "classes"),
}
PLAIN = {"node": "plain Node.js", "react": "React", "python": "plain Python"}
MANY_ROUTES, MOST_RULES = 50, 8


# --- the three tables ---------------------------------------------------------------------------------------------------


def contexts_of(facts: DataFrame, lang: str, frameworks: DataFrame | None = None) -> DataFrame:
    """The contexts of facts with module and ctx_id; `frameworks` (repo, ctx_id, framework) where the language has some."""
    local = F.substring(F.col("ctx_id"), F.length("module") + 2, F.length("ctx_id"))
    name = F.substring_index("ctx_id", ".", -1) if lang == "java" else F.substring_index(local, ".", -1) if lang == "python" else local
    out = group_digest(facts, ["repo", "ctx_id", "module"], F.col("hash"), "|")
    out = out.select("repo", "ctx_id", "module", F.col("n").alias("files"), F.col("digest").alias("src_hash"))
    out = out.withColumn("name", name)
    if frameworks is None:
        return out.withColumn("framework", F.lit(None).cast("string"))
    return out.join(frameworks.select("repo", "ctx_id", "framework"), ["repo", "ctx_id"], "left")


def route_table(routes: DataFrame, lang: str) -> DataFrame:
    """`routes` from the language's flows (Java: endpoints with flow)."""
    path = F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path"))
    ctx = F.concat(F.lit("  ("), "ctx_id", F.lit(")"))
    verbal = F.concat_ws(" ", "verb", path) if "verb" in routes.columns else path
    if lang == "java":
        tail = F.concat_ws(" ", "req", F.concat(F.lit("-> "), "resp"))
        line = F.concat(F.rtrim(F.concat(verbal, F.lit("  "), "fn", F.lit("  "), tail)), ctx)
        key, title, label = F.col("fn"), F.col("fn"), verbal
        brief = F.concat(verbal, F.lit("  ("), "controller", F.lit(")"))
    elif lang == "python":
        key, title, label = F.col("path"), F.col("fn"), verbal
        brief, line = F.concat(verbal, F.lit("  ("), "fn", F.lit(")")), F.concat(verbal, F.lit("  "), "fn", ctx)
    else:
        label = brief = F.concat(verbal, F.lit(" → "), F.coalesce("target", "kind"))
        key, title = F.col("path"), F.coalesce("target", "path")
        if lang == "angular":
            guards = F.when(F.col("guards") != "", F.concat(F.lit("  guards: "), "guards")).otherwise("")
            line = F.concat(path, F.lit(" → "), F.coalesce("target", F.lit("-")), F.lit("  "), "kind", guards, ctx)
        elif lang == "react":
            line = F.concat(F.rtrim(F.concat(path, F.lit(" → "), F.coalesce("target", F.lit("")))), F.lit("  "), "kind", ctx)
        else:
            line = F.concat(verbal, F.lit("  "), F.coalesce("target", "kind"), ctx)
    columns = {"key": key, "title": title, "label": label, "line": line, "brief": brief, "flow": F.col("flow")}
    return routes.select("repo", "ctx_id", *[c.alias(n) for n, c in columns.items()])


def unit_table(lang: str, **tables: DataFrame) -> DataFrame:
    """`units` from tables with repo, ctx_id and name, one for each group of the language."""
    parts = [tables[g].select("repo", "ctx_id", F.lit(g).alias("grp"), "name") for g in GROUPS[lang]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- rollups ------------------------------------------------------------------------------------------------------------


def _per_context(contexts: DataFrame, routes: DataFrame, units: DataFrame, lang: str, names: bool) -> DataFrame:
    """`contexts` with the number of routes and, for each group, the number of its units or their names."""
    n_routes = routes.groupBy("repo", "ctx_id").agg(F.count("*").alias("routes"))

    def held(group: str) -> Column:
        name = F.when(F.col("grp") == group, F.col("name"))
        return F.array_join(F.array_sort(F.collect_list(name)), ",").alias(group) if names else F.count(name).alias(group)

    grouped = units.groupBy("repo", "ctx_id").agg(*[held(g) for g in GROUPS[lang]])
    out = contexts.join(n_routes, ["repo", "ctx_id"], "left").join(grouped, ["repo", "ctx_id"], "left")
    empty = F.lit("") if names else F.lit(0)
    return out.withColumns({"routes": F.coalesce("routes", F.lit(0))} | {g: F.coalesce(g, empty) for g in GROUPS[lang]})


def overview(contexts: DataFrame, routes: DataFrame, units: DataFrame, lang: str) -> DataFrame:
    """(repo, ctx_id, files, routes, one count for each group of the language)."""
    return _per_context(contexts, routes, units, lang, False).select("repo", "ctx_id", "files", "routes", *GROUPS[lang])


def context_cards(contexts: DataFrame, routes: DataFrame, units: DataFrame, functional: DataFrame, lang: str) -> DataFrame:
    """(repo, ctx_id, name, framework, purpose, capabilities, names of each group, labels) of each context."""
    labels = routes.groupBy("repo", "ctx_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("labels"))
    inferred = functional.select("repo", "ctx_id", "purpose", F.array_join("capabilities", "; ").alias("capabilities"))
    out = _per_context(contexts, routes, units, lang, True)
    out = out.join(labels, ["repo", "ctx_id"], "left").join(inferred, ["repo", "ctx_id"], "left")
    return out.select("repo", "ctx_id", "name", "framework", "purpose", "capabilities", *GROUPS[lang], F.coalesce("labels", F.lit("")).alias("labels"))


def context_details(contexts: DataFrame, routes: DataFrame, units: DataFrame, functional: DataFrame, lang: str) -> DataFrame:
    """context_cards with module, rules, use cases (flows named by intent, else title), intents of routes, and whether the
    inferred layer is older than the sources."""
    layer = functional.select("repo", "ctx_id", "business_rules", "intents", F.col("src_hash").alias("stored"))
    intent = F.try_element_at("intents", F.col("key"))
    named = routes.join(functional.select("repo", "ctx_id", "intents"), ["repo", "ctx_id"], "left").withColumn("intent", intent)
    cases = F.collect_list(F.when(F.col("flow").isNotNull(), F.concat(F.coalesce("intent", "title"), F.lit(": "), "flow")))
    with_intent = F.collect_list(F.concat(F.col("label"), F.lit(" = "), F.col("intent")))
    named = named.groupBy("repo", "ctx_id").agg(
        F.array_join(F.array_sort(cases), "; ").alias("use_cases"), F.array_join(F.array_sort(with_intent), "; ").alias("intended")
    )
    cards = context_cards(contexts, routes, units, functional, lang).join(contexts.select("repo", "ctx_id", "module", "src_hash"), ["repo", "ctx_id"])
    out = cards.join(layer, ["repo", "ctx_id"], "left").join(named, ["repo", "ctx_id"], "left")
    stale = F.coalesce(F.col("stored") != F.col("src_hash"), F.lit(False))
    return out.select(
        "repo", "ctx_id", "module", "name", "framework", "purpose", stale.alias("functional_stale"), "capabilities", F.array_join("business_rules", "; ").alias("rules"),
        *GROUPS[lang], "labels", F.coalesce("use_cases", F.lit("")).alias("use_cases"), F.coalesce("intended", F.lit("")).alias("intended"),
    )


def java_structure(types: DataFrame, beans: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, ctx_id, dense_types, beans, entities) of Java contexts as arrays of structs, in the order of files and types.

    A type comes with its kind, annotations, the signatures of its methods but accessors and the like, and how many of those
    are left out; a bean with its stereotype and dependencies; an entity with its table, relations and repository.
    """
    dense = java.dense_types(types)
    methods = F.transform("methods", lambda m: F.concat(m["name"], F.coalesce(m["sig"], F.lit(""))))
    own = F.struct("path", "place", "name", "kind", F.col("ann").alias("annotations"), methods.alias("methods"), "accessors_omitted")
    plain = lambda rows, *names: F.transform(F.array_sort(rows), lambda t: F.struct(*[t[n].alias(n) for n in names]))
    held = dense.groupBy("repo", "ctx_id").agg(plain(F.collect_list(own), "name", "kind", "annotations", "methods", "accessors_omitted").alias("dense_types"))
    wired = beans.groupBy("repo", "ctx_id").agg(plain(F.collect_list(F.struct("path", "place", "name", "stereotype", "deps")), "name", "stereotype", "deps").alias("beans"))
    kept = entities.groupBy("repo", "ctx_id").agg(F.array_sort(F.collect_list(F.struct("name", "table", "relations", "repository"))).alias("entities"))
    return held.join(wired, ["repo", "ctx_id"], "full_outer").join(kept, ["repo", "ctx_id"], "full_outer")


def java_details(contexts: DataFrame, routes: DataFrame, units: DataFrame, functional: DataFrame, types: DataFrame, beans: DataFrame, entities: DataFrame) -> DataFrame:
    """context_details() with java_structure() in the place of names: the whole row of a Java context."""
    rows = context_details(contexts, routes, units, functional, "java").drop("types", "beans", "entities")
    return rows.join(java_structure(types, beans, entities), ["repo", "ctx_id"], "left")


def module_index(contexts: DataFrame, routes: DataFrame, functional: DataFrame, themes: DataFrame) -> DataFrame:
    """(repo, module, theme, keywords, contexts, routes, files) per module, and per repo with a null module.

    `themes` has repo, module, theme, keywords; keywords that it lacks are the most frequent words of the inferred layer.
    """
    n = routes.groupBy("repo", "ctx_id").agg(F.count("*").alias("n"))
    joined = contexts.join(n, ["repo", "ctx_id"], "left")
    r, m = F.col("repo"), F.col("module")
    sums = joined.groupingSets([[r, m], [r]], r, m).agg(
        F.count("*").alias("contexts"), F.sum(F.coalesce("n", F.lit(0))).alias("routes"), F.sum("files").alias("files")
    )
    placed = functional.join(contexts.select("repo", "ctx_id", "module"), ["repo", "ctx_id"])
    words = module_keywords(placed).groupBy("repo", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), ",").alias("found"))
    out = sums.join(themes, ["repo", "module"], "left").join(words, ["repo", "module"], "left")
    return out.select("repo", "module", "theme", F.coalesce("keywords", "found").alias("keywords"), "contexts", "routes", "files")


def architecture_style(contexts: DataFrame, lang: str, standalone: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """(repo, style) of each repo: package words in Java, standalone components (repo) against modules (repo) in Angular,
    else the frameworks of its contexts."""
    if lang == "java":
        return java.arch_style(contexts.withColumn("package", F.substring_index("ctx_id", "/", -1)))
    if lang == "angular":
        counted = standalone.select("repo", F.lit(1).alias("s"), F.lit(0).alias("m")).unionByName(modules.select("repo", F.lit(0).alias("s"), F.lit(1).alias("m")))
        counted = contexts.select("repo", F.lit(0).alias("s"), F.lit(0).alias("m")).unionByName(counted).groupBy("repo").agg(F.max("s").alias("s"), F.max("m").alias("m"))
        style = F.when(F.col("s") > F.col("m"), "standalone components + provideRouter (modern)").when(F.col("m") > F.col("s"), "NgModule-based")
        return counted.select("repo", style.otherwise("mixed (standalone + NgModule)").alias("style"))
    own = F.when(F.col("framework") != lang, F.col("framework"))
    seen = contexts.groupBy("repo", own.alias("f")).agg(F.min("ctx_id").alias("first")).groupBy("repo")
    order = F.struct("first", "f") if lang == "python" else F.struct("f", "first")
    seen = seen.agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), order))), lambda x: x["f"]).alias("fs"))
    joined = F.array_join("fs", " + ")
    if lang == "python":
        joined = F.when(F.size("fs") > 1, F.concat(joined, F.lit(" (mixed)"))).otherwise(joined)
    return seen.select("repo", F.when(F.size("fs") == 0, PLAIN[lang]).otherwise(joined).alias("style"))


def project_brief(contexts: DataFrame, routes: DataFrame, functional: DataFrame, themes: DataFrame, styles: DataFrame) -> DataFrame:
    """(repo, kind, place, name, text, contexts, routes): one repo's brief in rows.

    Kinds: `arch`; `module` with its role (theme, else the first purpose by context id) and counts; `rule`, the first
    MOST_RULES in the order of contexts; `route` lines where a repo has at most MANY_ROUTES, else `routes`, their number.
    """
    none, null = F.lit(None).cast("string"), F.lit(None).cast("long")

    def rows(df: DataFrame, kind: str, place=None, name=None, text=none, contexts=null, routes=null) -> DataFrame:
        first = F.lit(None).cast("int") if place is None else place
        return df.select(
            "repo", F.lit(kind).alias("kind"), first.alias("place"), (none if name is None else name).alias("name"), text.alias("text"),
            contexts.alias("contexts"), routes.alias("routes"),
        )

    n = routes.groupBy("repo", "ctx_id").agg(F.count("*").alias("n"))
    inferred = functional.select("repo", "ctx_id", "purpose", "business_rules")
    joined = contexts.select("repo", "ctx_id", "module").join(inferred, ["repo", "ctx_id"], "left").join(n, ["repo", "ctx_id"], "left")
    modules = joined.groupBy("repo", "module").agg(
        F.min_by("purpose", F.when(F.col("purpose").isNotNull(), F.col("ctx_id"))).alias("purpose"), F.count("*").alias("n_contexts"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n_routes"),
    )
    modules = modules.join(themes.select("repo", "module", "theme"), ["repo", "module"], "left")
    order = Window.partitionBy("repo").orderBy("ctx_id", "pos")
    rules = joined.select("repo", "ctx_id", F.posexplode("business_rules").alias("pos", "rule")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_RULES)
    total = routes.groupBy("repo").agg(F.count("*").alias("total"))
    few = routes.join(total.where(F.col("total") <= MANY_ROUTES), "repo", "left_semi")
    return (
        rows(styles, "arch", text=F.col("style"))
        .unionByName(rows(modules, "module", name=F.col("module"), text=F.coalesce("theme", "purpose"), contexts=F.col("n_contexts"), routes=F.col("n_routes")))
        .unionByName(rows(rules, "rule", place=F.col("place"), text=F.col("rule")))
        .unionByName(rows(few, "route", text=F.col("brief")))
        .unionByName(rows(total.where(F.col("total") > MANY_ROUTES), "routes", routes=F.col("total")))
    )


# --- symbols ------------------------------------------------------------------------------------------------------------


def _typed(facts: DataFrame, lang: str) -> DataFrame:
    kind = F.col("t.kind") if lang == "node" else F.lit("class")
    rows = facts.select("repo", "path", F.explode("types").alias("t"))
    return rows.select("repo", "path", F.col("t.name").alias("name"), kind.alias("kind"), F.col("t.line").alias("line"), "t")


def symbol_table(facts: DataFrame, lang: str) -> DataFrame:
    """(repo, name, kind, signature, path, line): classes and methods, Python's functions, functional symbols of the front ends."""
    parts = []
    if lang != "react":
        types = _typed(facts, lang)
        parts.append(types.select("repo", "name", "kind", F.col("name").alias("signature"), "path", "line"))
        methods = types.select("repo", "path", F.col("name").alias("owner"), F.explode("t.methods").alias("m"))
        parts.append(methods.select("repo", "m.name", F.lit("method").alias("kind"), F.concat("owner", F.lit("."), "m.name", "m.sig").alias("signature"), "path", "m.line"))
    if lang == "python":
        rows = facts.select("repo", "path", F.explode("functions").alias("f"))
        parts.append(rows.select("repo", "f.name", F.lit("def").alias("kind"), F.concat("f.name", "f.sig").alias("signature"), "path", "f.line"))
    if lang in ("angular", "react"):
        rows = facts.select("repo", "path", F.explode("functionals").alias("f"))
        parts.append(rows.select("repo", "f.name", "f.kind", F.col("f.name").alias("signature"), "path", "f.line"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reference_words(facts: DataFrame, lang: str) -> DataFrame:
    """(repo, word, owner, path, line): distinct words of what a symbol's declaration names, its own name left out."""
    texts = []
    if lang != "react":
        types = _typed(facts, lang)
        said = [F.col("t.bases"), F.transform("t.methods", lambda m: m["sig"])]
        if lang != "python":
            said += [F.col("t.ctorDeps"), F.transform("t.props", lambda p: p["type"])]
        if lang == "angular":
            said.append(F.col("t.uses"))
        texts.append(types.select("repo", F.col("name").alias("owner"), "path", "line", F.array_join(F.concat(*said), " ").alias("said")))
    if lang != "node":
        column = "functions" if lang == "python" else "functionals"
        rows = facts.select("repo", "path", F.explode(column).alias("f"))
        said = F.array_join("f.deps", " ") if lang != "python" else F.concat_ws(" ", "f.sig", F.array_join("f.deps", " "))
        texts.append(rows.select("repo", F.col("f.name").alias("owner"), "path", F.col("f.line").alias("line"), said.alias("said")))
    out = texts[0]
    for text in texts[1:]:
        out = out.unionByName(text)
    words = out.select("repo", "owner", "path", "line", F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit(r"(\w+)")))).alias("word"))
    return words.where("word <> owner")


def by_name(table: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Rows of symbols (`name`) or references (`word`) that `names` (repo, name) asks for, by equality."""
    return table.join(names.select("repo", F.col("name").alias(column)).distinct(), ["repo", column], "left_semi")


# --- each language's tables ---------------------------------------------------------------------------------------------


def java_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    types = java.types_of(facts)
    beans = java.java_beans(types)
    flows = java.java_flows(java.java_endpoints(types), beans, java.java_contexts(facts))
    units = unit_table("java", types=types, beans=beans.select("repo", "ctx_id", "name").distinct(), entities=java.java_entities(types))
    return contexts_of(facts, "java"), route_table(flows, "java"), units


def python_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    routes, models = web.python_routes(facts), web.python_models(facts)
    contexts = contexts_of(facts, "python", web.context_framework(web.python_signals(facts, routes), "python"))
    flows = web.python_flows(routes, web.python_di(facts))
    units = unit_table("python", models=models.where("kind <> 'class'"), classes=models.where("kind = 'class'"))
    return contexts, route_table(flows, "python"), units


def node_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = web.node_units(facts)
    contexts = contexts_of(facts, "node", web.context_framework(web.node_signals(facts), "node"))
    flows = web.node_flows(web.node_routes(facts), units)
    listed = unit_table("node", controllers=units.where("kind IN ('controller', 'class')"), services=units.where("kind = 'service'"))
    return contexts, route_table(flows, "node"), listed


def angular_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = web.angular_units(facts)
    shown = units.where("kind IN ('component', 'directive')")
    flows = web.front_flows(web.front_routes(facts), shown)
    return contexts_of(facts, "angular"), route_table(flows, "angular"), unit_table("angular", components=shown, services=units.where("kind = 'service'"))


def react_tables(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = web.react_units(facts)
    shown = units.where("kind <> 'hook'")
    flows = web.front_flows(web.front_routes(facts), shown)
    return contexts_of(facts, "react"), route_table(flows, "react"), unit_table("react", components=shown, services=units.where("kind = 'hook'"))


TABLES = {"java": java_tables, "python": python_tables, "node": node_tables, "angular": angular_tables, "react": react_tables}
