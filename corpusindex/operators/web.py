"""From Python and Node facts to routes, units, flows and frameworks. All keys are per repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs, model bases, directories that hold a feature each, order of frameworks.
PYTHON_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
MODEL_BASES = "^(BaseModel|Model|Schema|Base|DeclarativeBase)$"
CONTAINERS = {
    "angular": "features pages modules domains libs".split(),
    "node": "features modules domains routes controllers api services apps packages libs".split(),
    "react": "features pages components views containers routes modules screens hooks apps packages".split(),
}
FRAMEWORKS = {"python": ("fastapi", "flask", "django"), "node": ("nestjs", "express", "fastify")}
STEREOTYPES = {"Controller": "controller", "Injectable": "service", "Module": "module"}


# --- assignment ---------------------------------------------------------------------------------------------------------


def feature_of(sub: Column, containers: list[str]) -> Column:
    """The feature of a path under the source root: `app` at the root, `container.segment` within a container."""
    parts = F.split(sub, "/")
    first = F.get(parts, F.lit(0))
    return (
        F.when(F.size(parts) <= 1, "app")
        .when((F.size(parts) > 2) & first.isin(*containers), F.concat_ws(".", first, F.get(parts, F.lit(1))))
        .otherwise(first)
    )


def assign_feature(facts: DataFrame, projects: DataFrame, lang: str, paths: DataFrame | None = None) -> DataFrame:
    """`facts` with module, feature and ctx_id; `projects` (repo, name, root) has one or more source roots per repo.

    A file belongs to the project with the longest root above it, else to that with the shortest root of its repo, else to
    the repo itself. Roots are met by equality with each file's directories. In Angular an `app` folder below the root is
    passed over. `paths` (repo, path) are those of `facts`, where another table gives them without reading the facts.
    """
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    known = projects.select("repo", F.coalesce(F.regexp_replace("root", "/+$", ""), F.lit("")).alias("root"), F.col("name").alias("module"))
    known = known.withColumn("place", F.struct(F.length("root").alias("n"), "module", "root"))
    each = (facts if paths is None else paths).select("repo", "path", F.explode(above).alias("root"))
    # an outer join, so that Spark can send the projects to all tasks but never the directories, whose number it can't tell
    best = each.join(known, ["repo", "root"], "left").groupBy("repo", "path").agg(F.max("place").alias("best"))
    short = known.groupBy("repo").agg(F.min("place").alias("short"))
    joined = facts.join(best, ["repo", "path"], "left").join(short, "repo", "left")
    joined = joined.withColumn("module", F.coalesce("best.module", "short.module", "repo"))
    root = F.coalesce("best.root", "short.root", F.lit(""))
    prefix = F.when(root == "", "").otherwise(F.concat(root, F.lit("/")))
    sub = F.when(F.startswith("path", prefix), F.substring(F.col("path"), F.length(prefix) + 1, F.length("path")))
    if lang == "angular":
        sub = F.regexp_replace(sub, "^app/", "")
    feature = F.when(sub.isNull(), "app").otherwise(feature_of(sub, CONTAINERS[lang]))
    return joined.withColumn("feature", feature).withColumn("ctx_id", F.concat_ws("/", "module", "feature")).drop("best", "short")


def assign_python(facts: DataFrame) -> DataFrame:
    """`facts` with module (the head of the dotted directory path without src/) and ctx_id; root files belong to the repo."""
    folder = F.regexp_replace(F.regexp_replace("path", "^src/", ""), "/?[^/]*$", "")
    package = F.when(folder == "", F.col("repo")).otherwise(F.replace(folder, F.lit("/"), F.lit(".")))
    out = facts.withColumn("package", package).withColumn("module", F.substring_index("package", ".", 1))
    return out.withColumn("ctx_id", F.concat_ws("/", "module", "package"))


def context_framework(signals: DataFrame, lang: str) -> DataFrame:
    """(repo, ctx_id, framework) by precedence from (repo, ctx_id, signal), null signals allowed."""
    seen = signals.groupBy("repo", "ctx_id").agg(F.collect_set("signal").alias("seen"))
    first = F.coalesce(*[F.when(F.array_contains("seen", f), F.lit(f)) for f in FRAMEWORKS[lang]], F.lit(lang))
    return seen.select("repo", "ctx_id", first.alias("framework"))


def framework_counts(frameworks: DataFrame) -> DataFrame:
    return frameworks.groupBy("framework").agg(F.count("*").alias("contexts"))


# --- Python -------------------------------------------------------------------------------------------------------------


def _handlers(facts: DataFrame) -> DataFrame:
    functions = facts.select("repo", "ctx_id", "path", F.lit(None).cast("string").alias("owner"), F.explode("functions").alias("f"))
    methods = facts.select("repo", "ctx_id", "path", F.explode("types").alias("t")).select("repo", "ctx_id", "path", F.col("t.name").alias("owner"), F.explode("t.methods").alias("f"))
    both = functions.unionByName(methods)
    return both.select("repo", "ctx_id", "path", F.concat_ws(".", "owner", "f.name").alias("fn"), "owner", F.col("f.decorators").alias("decorators"), F.col("f.deps").alias("deps"), F.col("f.sig").alias("sig"), F.col("f.line").alias("line"))


def _decorated(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, path_file, fn, deps, last, arg, methods): one row per decorator of a handler."""
    each = _handlers(facts).select("*", F.explode("decorators").alias("d"))
    name = F.regexp_extract("d", r"^@([\w.]+)", 1)
    return each.select(
        "repo", "ctx_id", F.col("path").alias("file"), "fn", "deps", "line", F.substring_index(name, ".", -1).alias("last"),
        F.regexp_extract("d", r"\(\s*r?['\"]([^'\"]*)['\"]", 1).alias("arg"), F.regexp_extract("d", r"methods\s*=\s*[\[(]([^\])]*)[\])]", 1).alias("methods"),
    )


def python_routes(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, verb, path, fn, file): verb decorators, route decorators (GET unless methods say else), url patterns."""
    decorated = _decorated(facts)
    verbs = F.when(F.col("last").isin(*PYTHON_VERBS), F.array(F.upper("last"))).when(
        F.col("last") == "route",
        F.when(F.col("methods") == "", F.array(F.lit("GET"))).otherwise(
            F.filter(F.transform(F.split("methods", ","), lambda v: F.upper(F.regexp_replace(v, r"['\"\s]", ""))), lambda v: v != "")
        ),
    )
    plain = decorated.select("repo", "ctx_id", F.explode(verbs).alias("verb"), F.col("arg").alias("path"), "fn", "file")
    patterns = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("assigns").alias("a")).where("a.name = 'urlpatterns'")
    call = r"(?<![A-Za-z0-9_])(?:path|re_path|url)\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*([\w.]+)"
    found = F.arrays_zip(F.regexp_extract_all("a.value", F.lit(call), F.lit(1)).alias("p"), F.regexp_extract_all("a.value", F.lit(call), F.lit(2)).alias("f"))
    listed = patterns.select("repo", "ctx_id", "file", F.explode(found).alias("r"))
    listed = listed.select(
        "repo", "ctx_id", F.lit("ANY").alias("verb"), F.concat(F.lit("/"), F.regexp_replace("r.p", "^/", "")).alias("path"), F.regexp_replace("r.f", r"\.as_view$", "").alias("fn"), "file"
    )
    return plain.unionByName(listed)


def python_functions(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, file, name, sig, line) of the module-level functions that serve no route."""
    served = F.exists("f.decorators", lambda d: F.substring_index(F.regexp_extract(d, r"^@([\w.]+)", 1), ".", -1).isin(*PYTHON_VERBS, "route"))
    rows = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("functions").alias("f")).where(~served)
    return rows.select("repo", "ctx_id", "file", "f.name", "f.sig", "f.line")


def python_di(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, fn, deps) of handlers with dependencies."""
    return _handlers(facts).where(F.size("deps") > 0).select("repo", "ctx_id", "path", "line", "fn", "deps")


def python_flows(routes: DataFrame, di: DataFrame) -> DataFrame:
    """`routes` with flow; of handlers of one name the last by file and line gives the dependencies."""
    last = di.groupBy("repo", "fn").agg(F.max_by("deps", F.struct("path", "line")).alias("deps"))
    joined = routes.join(last, ["repo", "fn"], "left")
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    return joined.withColumn("flow", F.concat_ws(" → ", F.concat_ws(" ", "verb", path), "fn", "deps")).drop("deps")


def python_models(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, name, kind, fields) of every class: a model's kind, or `class`."""
    types = facts.select("repo", "ctx_id", F.explode("types").alias("t"))
    bases = F.col("t.bases")
    data = F.exists("t.decorators", lambda d: d.rlike(r"^@(dataclass|attr\.s|attrs|define)(?![A-Za-z0-9_])"))
    model = F.exists(bases, lambda b: F.substring_index(b, ".", -1).rlike(MODEL_BASES)) | data
    kind = (
        F.when(~model, "class").when(F.array_contains(bases, "BaseModel"), "pydantic").when(F.exists(bases, lambda b: b.endswith("Model")), "django")
        .when(F.exists(bases, lambda b: b.isin("Base", "DeclarativeBase")), "sqlalchemy")
        .when(F.exists("t.decorators", lambda d: F.contains(d, F.lit("dataclass"))), "dataclass").otherwise("model")
    )
    fields = F.array_join(F.transform("t.fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ",")
    return types.select("repo", "ctx_id", F.col("t.name").alias("name"), kind.alias("kind"), fields.alias("fields"))


def python_signals(facts: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo, ctx_id, signal); every context gives a row."""
    decorated = _decorated(facts).where(F.col("last").isin(*PYTHON_VERBS, "route"))
    signals = decorated.select("repo", "ctx_id", F.when(F.col("last") == "route", "flask").otherwise("fastapi").alias("signal"))
    assigns = facts.select("repo", "ctx_id", F.explode("assigns").alias("a"))
    for test, signal in (("a.name = 'urlpatterns'", "django"), ("a.value RLIKE 'APIRouter|FastAPI'", "fastapi"), ("a.value RLIKE 'Blueprint|Flask[(]'", "flask")):
        signals = signals.unionByName(assigns.where(test).select("repo", "ctx_id", F.lit(signal).alias("signal")))
    django = python_models(facts).where("kind = 'django'").select("repo", "ctx_id", F.lit("django").alias("signal"))
    return signals.unionByName(django).unionByName(facts.select("repo", "ctx_id", F.lit(None).cast("string").alias("signal")))


def routes_without_di(routes: DataFrame, di: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Routes of FastAPI contexts whose handler, by full name or last part, has no dependency in its context."""
    fast = routes.join(frameworks.where("framework = 'fastapi'").select("repo", "ctx_id"), ["repo", "ctx_id"], "left_semi")
    keyed = fast.withColumn("key", F.explode(F.array_distinct(F.array(F.col("fn"), F.substring_index("fn", ".", -1)))))
    served = keyed.join(di.select("repo", "ctx_id", F.col("fn").alias("key")).distinct(), ["repo", "ctx_id", "key"], "left_semi")
    return fast.join(served.select("repo", "ctx_id", "fn").distinct(), ["repo", "ctx_id", "fn"], "left_anti")


# --- Node ---------------------------------------------------------------------------------------------------------------


def node_routes(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("routes").alias("r")).select("repo", "ctx_id", "file", "r.*")


def node_units(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, name, kind, scope, base_path, deps, endpoints, arrays, file): services, modules, controllers and classes.

    Endpoints are counted per file; `arrays` joins a module's four lists.
    """
    types = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("types").alias("t"))
    names = F.transform("t.decorators", lambda d: F.regexp_extract(d, r"^@(?:[\w.]*\.)?(\w+)", 1))
    stereotype = F.get(F.filter(names, lambda n: n.isin(*STEREOTYPES)), F.lit(0))
    kind = F.coalesce(*[F.when(stereotype == k, v) for k, v in STEREOTYPES.items()], F.lit("class"))
    marked = F.get(F.filter("t.decorators", lambda d: d.rlike(r"^@(Injectable|Module)(?![A-Za-z0-9_])")), F.lit(0))
    scope = F.regexp_extract(F.coalesce(marked, F.lit("")), r"^@Injectable\(\s*['\"`]([^'\"`]*)['\"`]", 1)

    def listed(key: str) -> Column:
        inner = F.regexp_extract(F.coalesce(marked, F.lit("")), rf"{key}\s*:\s*\[([^\]]*)\]", 1)
        return F.array_join(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")

    arrays = F.concat_ws("|", *[listed(k) for k in ("controllers", "providers", "imports", "exports")])
    counts = node_routes(facts).withColumn("owner", F.substring_index("target", ".", 1)).where("target LIKE '%.%'").groupBy("repo", "file", "owner").agg(F.count("*").alias("endpoints"))
    out = types.select(
        "repo", "ctx_id", F.col("t.name").alias("name"), kind.alias("kind"), F.when(scope != "", scope).alias("scope"), F.col("t.basePath").alias("base_path"),
        F.array_join("t.ctorDeps", ",").alias("deps"), F.when(kind == "module", arrays).alias("arrays"), "file",
    )
    joined = out.join(counts.withColumnRenamed("owner", "name"), ["repo", "file", "name"], "left")
    shown = F.when(F.col("kind").isin("controller", "class"), F.coalesce("endpoints", F.lit(0))).otherwise(0)
    return joined.withColumn("endpoints", shown)


def node_flows(routes: DataFrame, units: DataFrame) -> DataFrame:
    """`routes` with flow: verb and path, handler, the dependencies of the handler's class, the last of its name."""
    owners = units.where(F.col("kind").isin("controller", "class")).groupBy("repo", F.col("name").alias("head")).agg(F.max_by("deps", "file").alias("deps"))
    joined = routes.withColumn("head", F.substring_index("target", ".", 1)).join(owners, ["repo", "head"], "left")
    deps = F.when(F.col("deps") != "", F.replace("deps", F.lit(","), F.lit(" → ")))
    return joined.withColumn("flow", F.concat_ws(" → ", F.concat_ws(" ", "verb", "path"), "target", deps)).drop("deps", "head")


def node_signals(facts: DataFrame) -> DataFrame:
    return facts.select("repo", "ctx_id", F.explode_outer("fw").alias("signal"))


# --- Angular and React --------------------------------------------------------------------------------------------------

ANGULAR_KINDS = {"Component": "component", "Injectable": "service", "NgModule": "module", "Directive": "directive", "Pipe": "pipe"}


def front_routes(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, file, path, target, kind, line, guards) of Angular or React facts; guards comma-joined."""
    rows = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("routes").alias("r"))
    return rows.select("repo", "ctx_id", "file", "r.path", "r.target", "r.kind", "r.line", F.array_join("r.guards", ", ").alias("guards"))


def angular_units(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, file, name, kind, selector, standalone, provided_in, inputs, outputs, arrays, deps) of stereotyped classes and functional guards."""
    types = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("types").alias("t"))
    name = lambda d: F.regexp_extract(d, r"^@(?:[\w.]*\.)?(\w+)", 1)
    marked = F.get(F.filter("t.decorators", lambda d: name(d).isin(*ANGULAR_KINDS)), F.lit(0))
    types = types.withColumn("d", marked).where("d IS NOT NULL")
    kind = F.coalesce(*[F.when(name(F.col("d")) == k, v) for k, v in ANGULAR_KINDS.items()])

    def text(key: str) -> Column:
        value = F.regexp_extract("d", key + r"\s*:\s*['\"]([^'\"]*)", 1)
        return F.when(value != "", value)

    def listed(key: str) -> Column:
        inner = F.regexp_extract("d", key + r"\s*:\s*\[([^\]]*)\]", 1)
        return F.array_join(F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != ""), ",")

    classes = types.select(
        "repo", "ctx_id", "file", F.col("t.name").alias("name"), kind.alias("kind"), text("selector").alias("selector"),
        F.col("d").rlike(r"standalone\s*:\s*true").alias("standalone"), text("providedIn").alias("provided_in"), F.array_join("t.inputs", ",").alias("inputs"),
        F.array_join("t.outputs", ",").alias("outputs"),
        F.when(kind == "module", F.concat_ws("|", *[listed(k) for k in ("declarations", "imports", "providers", "exports")])).alias("arrays"),
        F.array_join("t.ctorDeps", ",").alias("deps"),
    )
    none = F.lit(None).cast("string")
    functional = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("functionals").alias("f"))
    functional = functional.select(
        "repo", "ctx_id", "file", "f.name", "f.kind", none.alias("selector"), F.lit(False).alias("standalone"), none.alias("provided_in"), F.lit("").alias("inputs"),
        F.lit("").alias("outputs"), none.alias("arrays"), F.array_join("f.deps", ",").alias("deps"),
    )
    return classes.unionByName(functional)


def angular_http(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, owner, place, verb, url) of the calls of each class."""
    types = facts.select("repo", "ctx_id", F.explode("types").alias("t")).select("repo", "ctx_id", F.col("t.name").alias("owner"), F.posexplode("t.http").alias("place", "h"))
    return types.select("repo", "ctx_id", "owner", "place", "h.verb", "h.url")


def front_flows(routes: DataFrame, owners: DataFrame) -> DataFrame:
    """`routes` with flow; `owners` (repo, name, file, deps) are the components, of a name the last by file counts."""
    last = owners.groupBy("repo", F.col("name").alias("target")).agg(F.max_by("deps", "file").alias("deps"))
    joined = routes.join(last, ["repo", "target"], "left")
    head = F.concat(F.lit("route '"), F.when(F.col("path") == "", "/").otherwise(F.col("path")), F.lit("'"))
    deps = F.when((F.col("deps") != "") & F.col("kind").isin("component", "route"), F.replace("deps", F.lit(","), F.lit(" → ")))
    target = F.when(F.col("kind") == "redirect", F.concat(F.lit("↪ "), "target")).otherwise(F.col("target"))
    flow = F.when(F.col("target").isNotNull(), F.concat_ws(" → ", head, target, deps))
    guards = F.when(F.col("guards") != "", F.concat(F.lit("  (guards: "), "guards", F.lit(")"))).otherwise("")
    return joined.withColumn("flow", F.concat(flow, guards)).drop("deps")


def react_units(facts: DataFrame) -> DataFrame:
    """(repo, ctx_id, file, name, kind, hooks, deps, props): hooks, and components as function or class."""
    rows = facts.select("repo", "ctx_id", F.col("path").alias("file"), F.explode("functionals").alias("f"))
    kind = F.when(F.col("f.kind") == "hook", "hook").when(F.col("f.class"), "class").otherwise("function")
    joined = [F.array_join(F.coalesce(f"f.{c}", F.array()), ",").alias(c) for c in ("hooks", "deps", "props")]
    return rows.select("repo", "ctx_id", "file", F.col("f.name").alias("name"), kind.alias("kind"), *joined)
