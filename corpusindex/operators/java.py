"""From Java facts to endpoints, beans, entities, flows and contexts. All keys are per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.operators.digests import group_digest

# Annotations that make a bean, and the mapping annotations' verbs.
STEREOTYPES = {
    "RestController": "controller",
    "Controller": "controller",
    "Service": "service",
    "Repository": "repository",
    "Component": "component",
    "Configuration": "config",
}
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
RELATIONS = ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany")
VALUE_TYPES = (
    "String Long Integer int long boolean Boolean double Double float Float BigDecimal List Set Map Optional Object void UUID "
    "LocalDate LocalDateTime"
).split()
REPOSITORY_BASE = r"(?<!\w)(?:JpaRepository|CrudRepository|PagingAndSortingRepository|MongoRepository|Repository)\s*<\s*(?:[\w.]*\.)?(\w+)"


def assign_java(facts: DataFrame, projects: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """`facts` with module (the longest project directory above the file, else the repo's name), package and ctx_id.

    Each file's directories are joined on equality with the projects'; an empty directory is the root. `paths` (repo, path)
    are those of `facts`, where another table gives them without reading the facts.
    """
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = (facts if paths is None else paths).select("repo", "path", F.explode(F.array_distinct(dirs)).alias("dir"))
    best = above.join(projects.select("repo", "dir", "name"), ["repo", "dir"]).groupBy("repo", "path")
    best = best.agg(F.max_by("name", F.length("dir")).alias("module"))
    out = facts.join(best, ["repo", "path"], "left").withColumn("module", F.coalesce("module", "repo"))
    out = out.withColumn("package", F.coalesce("pkg", F.lit("(default)")))
    return out.withColumn("ctx_id", F.concat_ws("/", "module", "package"))


def annotation_name(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^@(?:[\w.]*\.)?(\w+)", 1)


def first_string(raw: Column) -> Column:
    return F.regexp_extract(raw, r'"([^"]*)"', 1)


def named(annotations: Column, *names: str) -> Column:
    """The first annotation with one of the names, or null."""
    return F.get(F.filter(annotations, lambda a: annotation_name(a).isin(*names)), F.lit(0))


def types_of(facts: DataFrame) -> DataFrame:
    """One row per type: ctx_id, path, place within the file and the type's fields."""
    return facts.select("repo", "module", "ctx_id", "path", F.posexplode("types").alias("place", "t")).select(
        "repo", "module", "ctx_id", "path", "place", "t.*"
    )


def _joined_path(base: Column, sub: Column) -> Column:
    def part(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(side, "^/|/$", "")))

    path = F.regexp_replace(F.concat(part(base), part(sub)), "/+", "/")
    return F.when(path == "", "/").otherwise(path)


def strip_generic(kind: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(kind, "<.*>", ""), r"\[\]", ""))


def java_endpoints(types: DataFrame) -> DataFrame:
    """(repo, ctx_id, verb, path, controller, fn, line, req, resp): mapped methods of controllers."""
    stereotype = F.get(F.filter(F.transform("ann", annotation_name), lambda n: n.isin(*STEREOTYPES)), F.lit(0))
    controllers = types.where(stereotype.isin("RestController", "Controller"))
    base = first_string(named(F.col("ann"), "RequestMapping"))
    methods = controllers.select("repo", "module", "ctx_id", F.col("name").alias("controller"), base.alias("base"), F.explode("methods").alias("m"))
    mapping = named(F.col("m.ann"), *VERBS, "RequestMapping")
    methods = methods.withColumn("mapping", mapping).where("mapping IS NOT NULL")
    fixed = F.coalesce(*[F.when(annotation_name(F.col("mapping")) == k, v) for k, v in VERBS.items()])
    listed = F.regexp_extract("mapping", r"RequestMethod\.(\w+)", 1)
    resp = F.trim(F.regexp_extract("m.sig", r"(?s)\):(.*)$", 1))
    return methods.select(
        "repo", "module", "ctx_id", F.coalesce(fixed, F.when(listed != "", listed), F.lit("ANY")).alias("verb"),
        _joined_path(F.col("base"), first_string(F.col("mapping"))).alias("path"), "controller",
        F.concat_ws(".", "controller", "m.name").alias("fn"), F.col("m.line").alias("line"), F.col("m.reqBody").alias("req"),
        F.when(resp != "", resp).alias("resp"),
    )


def java_beans(types: DataFrame) -> DataFrame:
    """(repo, module, ctx_id, name, stereotype, path, place, deps): constructor types, then injected fields, value types left out.

    Parameters are parted outside brackets, so Map<K, V> is one type.
    """
    stereotype = F.get(F.filter(F.transform("ann", annotation_name), lambda n: n.isin(*STEREOTYPES)), F.lit(0))
    sig = F.regexp_extract(F.get(F.filter("methods", lambda m: m["isCtor"]), F.lit(0))["sig"], r"(?s)^\((.*)\)$", 1)
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(sig, F.lit("")), "<[^<>]*>", ""), "<[^<>]*>", "")
    ctor = F.transform(F.split(F.regexp_replace(flat, "<[^<>]*>", ""), ","), strip_generic)
    fields = F.transform(
        F.filter("fields", lambda f: F.exists(f["ann"], lambda a: annotation_name(a) == "Autowired")), lambda f: strip_generic(f["type"])
    )
    deps = F.filter(F.array_distinct(F.concat(ctor, fields)), lambda d: (d != "") & ~d.isin(*VALUE_TYPES))
    found = types.withColumn("stereotype", stereotype).where("stereotype IS NOT NULL")
    return found.select("repo", "module", "ctx_id", "name", F.concat(F.lit("@"), "stereotype").alias("stereotype"), "path", "place", deps.alias("deps"))


def java_entities(types: DataFrame) -> DataFrame:
    """(repo, ctx_id, name, table, relations, repository): `relations` as Kind:Target in field order, comma-joined."""
    repository = F.regexp_extract(F.coalesce("ext", F.lit("")), REPOSITORY_BASE, 1)
    serving = types.withColumn("entity", repository).where("entity <> ''").groupBy("repo", "entity")
    serving = serving.agg(F.max_by("name", F.struct("path", "place")).alias("repository"))
    table = first_string(named(F.col("ann"), "Table"))
    inner = lambda kind: F.regexp_extract(kind, r"<\s*(?:[\w.]*\.)?(\w+)", 1)

    def related(f: Column) -> Column:
        target = F.when(inner(f["type"]) != "", inner(f["type"])).otherwise(strip_generic(f["type"]))
        kinds = F.array(*[F.when(_has(f["ann"], r), F.lit(r)) for r in RELATIONS])
        return F.transform(F.array_compact(kinds), lambda k: F.concat_ws(":", k, target))

    entities = types.where(F.exists("ann", lambda a: annotation_name(a) == "Entity"))
    entities = entities.select(
        "repo", "module", "ctx_id", "name", F.when(table != "", table).otherwise(F.lower("name")).alias("table"),
        F.array_join(F.flatten(F.transform("fields", related)), ",").alias("relations"),
    )
    joined = entities.join(serving, (entities.repo == serving.repo) & (entities.name == serving.entity), "left")
    return joined.select(entities.repo, "module", "ctx_id", "name", "table", "relations", "repository")


def _has(annotations: Column, name: str) -> Column:
    return F.exists(annotations, lambda a: annotation_name(a) == name)


def last_beans(beans: DataFrame, contexts: DataFrame) -> DataFrame:
    """One bean per repo and name: that of the context seen last, files in the order of their paths."""
    order = F.struct("seen", "path", "place")
    joined = beans.join(contexts.select("repo", "ctx_id", "seen"), ["repo", "ctx_id"])
    return joined.groupBy("repo", "name").agg(F.max_by("ctx_id", order).alias("owner_ctx"), F.max_by("deps", order).alias("deps"))


def java_contexts(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, module, package, name, file_count, src_hash, seen): `seen` is the first path of the context."""
    keys = ["repo", "ctx_id", "module", "package"]
    found = group_digest(facts, keys, F.col("hash"), "|")
    seen = facts.groupBy(*keys).agg(F.min("path").alias("seen"))
    joined = found.alias("d").join(seen.alias("s"), [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    return joined.select(
        *[f"d.{k}" for k in keys], F.substring_index("d.package", ".", -1).alias("name"), F.col("n").alias("file_count"), F.col("digest").alias("src_hash"), "seen"
    )


def java_flows(endpoints: DataFrame, beans: DataFrame, contexts: DataFrame) -> DataFrame:
    """`endpoints` with flow: endpoint, controller method, its service, the service's repository."""
    owners = last_beans(beans, contexts).select("repo", "name", "deps")

    def first(deps: Column, *endings: str) -> Column:
        return F.coalesce(*[F.get(F.filter(deps, lambda d: d.endswith(e)), F.lit(0)) for e in endings])

    service = F.coalesce(first(F.col("deps"), "Service"), F.get("deps", F.lit(0)))
    services = owners.select("repo", F.col("name").alias("controller"), service.alias("service"))
    repositories = owners.select("repo", F.col("name").alias("service"), first(F.col("deps"), "Repository", "Repo").alias("repository"))
    joined = endpoints.join(services, ["repo", "controller"], "left").join(repositories, ["repo", "service"], "left")
    return joined.withColumn("flow", F.concat_ws(" → ", F.concat_ws(" ", "verb", "path"), "fn", "service", "repository")).drop("service", "repository")


# --- index tables -------------------------------------------------------------------------------------------------------


def endpoint_lines(endpoints: DataFrame) -> DataFrame:
    tail = F.concat(
        F.when(F.col("req").isNotNull(), F.concat("req", F.lit(" "))).otherwise(""),
        F.when(F.col("resp").isNotNull(), F.concat(F.lit("-> "), "resp")).otherwise(""),
    )
    line = F.rtrim(F.concat("verb", F.lit(" "), "path", F.lit("  "), "fn", F.lit("  "), tail))
    return endpoints.select("repo", "ctx_id", "fn", F.concat(line, F.lit("  ("), "ctx_id", F.lit(")")).alias("line"))


def overview(contexts: DataFrame, endpoints: DataFrame, beans: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, ctx_id, files, endpoints, beans, entities) counts of each context."""
    out = contexts.select("repo", "ctx_id", F.col("file_count").alias("files"))
    for name, table in (("endpoints", endpoints), ("beans", beans.select("repo", "ctx_id", "name").distinct()), ("entities", entities)):
        counts = table.groupBy("repo", "ctx_id").agg(F.count("*").alias(name))
        out = out.join(counts, ["repo", "ctx_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def module_index(contexts: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(repo, module, contexts, endpoints, files) per module, and per repo with a null module."""
    n = endpoints.groupBy("repo", "ctx_id").agg(F.count("*").alias("n"))
    joined = contexts.join(n, ["repo", "ctx_id"], "left")
    r, m = F.col("repo"), F.col("module")
    grouped = joined.groupingSets([[r, m], [r]], r, m)
    return grouped.agg(F.count("*").alias("contexts"), F.sum(F.coalesce("n", F.lit(0))).alias("endpoints"), F.sum("file_count").alias("files"))


def arch_style(contexts: DataFrame) -> DataFrame:
    """(repo, style): hexagonal where a package has a word of that style."""
    word = r"(?<![A-Za-z0-9_])(domain|application|infrastructure|adapters?|ports?)(?![A-Za-z0-9_])"
    style = F.when(F.bool_or(F.lower("package").rlike(word)), "hexagonal/clean (domain/application/infrastructure packages detected)")
    return contexts.groupBy("repo").agg(style.otherwise("layered (controller/service/repository)").alias("style"))


def context_cards(contexts: DataFrame, types: DataFrame, endpoints: DataFrame, beans: DataFrame, entities: DataFrame) -> DataFrame:
    """(repo, ctx_id, name, types, endpoints, beans, entities): names and `VERB path` lists joined in order, and counts."""
    names = types.groupBy("repo", "ctx_id").agg(F.array_sort(F.collect_list(F.struct("path", "place", "name"))).alias("ts"))
    names = names.select("repo", "ctx_id", F.array_join(F.transform("ts", lambda t: t["name"]), ",").alias("types"))
    calls = F.array_sort(F.collect_list(F.concat_ws(" ", "verb", "path")))
    calls = endpoints.groupBy("repo", "ctx_id").agg(F.array_join(calls, ",").alias("calls"))
    counts = overview(contexts, endpoints, beans, entities).select("repo", "ctx_id", "beans", "entities")
    out = contexts.select("repo", "ctx_id", "name").join(names, ["repo", "ctx_id"], "left").join(calls, ["repo", "ctx_id"], "left")
    out = out.join(counts, ["repo", "ctx_id"])
    return out.select("repo", "ctx_id", "name", F.coalesce("types", F.lit("")).alias("types"), F.coalesce("calls", F.lit("")).alias("endpoints"), "beans", "entities")


def dense_types(types: DataFrame) -> DataFrame:
    """`types` without trivial methods, with `accessors_omitted`."""
    trivial = lambda m: m["name"].rlike("^(get|set|is)[A-Z0-9]") | m["name"].isin("equals", "hashCode", "toString")
    kept = types.withColumn("dense", F.filter("methods", lambda m: ~trivial(m)))
    return kept.withColumn("accessors_omitted", F.size("methods") - F.size("dense")).withColumn("methods", F.col("dense")).drop("dense")


def config_properties(types: DataFrame) -> DataFrame:
    """(repo, kind, value, owner, path): configuration classes by prefix, and fields with a value expression."""
    prefix = named(F.col("ann"), "ConfigurationProperties")
    classes = types.where(prefix.isNotNull()).select("repo", F.lit("@ConfigurationProperties").alias("kind"), first_string(prefix).alias("value"), F.col("name").alias("owner"), "path")
    fields = types.select("repo", "path", "name", F.explode("fields").alias("f"))
    value = named(F.col("f.ann"), "Value")
    fields = fields.where(value.isNotNull()).select(
        "repo", F.lit("@Value").alias("kind"), F.trim(F.regexp_replace(value, r"^@[\w.]+", "")).alias("value"), F.concat_ws(".", "name", "f.name").alias("owner"), "path"
    )
    return classes.unionByName(fields)


# --- analyses -----------------------------------------------------------------------------------------------------------


def mutating_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.where(F.col("verb").isin("POST", "PUT", "DELETE", "PATCH"))


def entity_leaks(endpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints whose return type without generics is an entity of the repo."""
    returned = F.regexp_replace(F.regexp_replace(F.coalesce("resp", F.lit("")), "<.*>", ""), r"[^A-Za-z0-9_]", "")
    names = entities.select("repo", F.col("name").alias("entity")).distinct()
    return endpoints.withColumn("entity", returned).join(names, ["repo", "entity"], "left_semi")


def cross_context_deps(beans: DataFrame, contexts: DataFrame) -> DataFrame:
    """(repo, ctx_id, owner, dep, owner_ctx): dependencies on a bean of another context."""
    owners = last_beans(beans, contexts).select("repo", F.col("name").alias("dep"), "owner_ctx")
    deps = beans.select("repo", "ctx_id", F.col("name").alias("owner"), F.explode("deps").alias("dep"))
    return deps.join(owners, ["repo", "dep"]).where("ctx_id <> owner_ctx").select("repo", "ctx_id", "owner", "dep", "owner_ctx")


def symbol_table(types: DataFrame) -> DataFrame:
    """(repo, name, kind, signature, path, line) of types and methods."""
    own = types.select("repo", "name", "kind", F.col("name").alias("signature"), "path", "line")
    methods = types.select("repo", "path", F.col("name").alias("owner"), F.explode("methods").alias("m"))
    methods = methods.select("repo", "m.name", F.lit("method").alias("kind"), F.concat("owner", F.lit("."), "m.name", "m.sig").alias("signature"), "path", "m.line")
    return own.unionByName(methods)


def symbol_defs(types: DataFrame, names: DataFrame) -> DataFrame:
    return symbol_table(types).join(names, ["repo", "name"], "left_semi")


def reference_words(types: DataFrame) -> DataFrame:
    """(repo, word, owner, path, line): distinct words of a type's signatures, field types and base types, its name left out."""
    text = F.concat_ws(
        " ", "ext", F.array_join(F.transform("methods", lambda m: m["sig"]), " "), F.array_join(F.transform("fields", lambda f: f["type"]), " ")
    )
    words = types.select("repo", F.col("name").alias("owner"), "path", "line", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\w+)")))).alias("word"))
    return words.where("word <> owner")


def symbol_refs(types: DataFrame, names: DataFrame) -> DataFrame:
    wanted = names.select("repo", F.col("name").alias("word")).distinct()
    return reference_words(types).join(wanted, ["repo", "word"], "left_semi")


def referenced_symbols(types: DataFrame) -> DataFrame:
    """Symbols with a reference at least."""
    words = reference_words(types).select("repo", F.col("word").alias("name")).distinct()
    return symbol_table(types).join(words, ["repo", "name"], "left_semi")
