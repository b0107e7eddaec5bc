"""Sources and sinks: source trees, build projects, caches, decision files, inferred layers, index tables."""

from __future__ import annotations

import json
import os
import re
import uuid

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.sources.store import stored

# What is scanned for each language, and the folders that are skipped.
SCAN = {
    "java": (r"\.java$", None, "target build out bin .git node_modules .idea .claude .gradle generated"),
    "angular": (r"\.ts$", r"\.(d|spec)\.ts$", "node_modules dist .angular coverage .git .idea .vscode .claude out-tsc tmp"),
    "node": (r"\.(ts|js|mjs|cjs)$", r"\.d\.ts$|\.(spec|test)\.", "node_modules dist build .next coverage .git .idea .vscode .claude out tmp"),
    "react": (r"\.(ts|js|mjs|cjs|tsx|jsx)$", r"\.d\.ts$|\.(spec|test)\.", "node_modules dist build .next coverage .git .idea .vscode .claude out tmp"),
    "python": (
        r"\.pyi?$", r"(_test\.pyi?|(^|/)test_[^/]*)$",
        "__pycache__ .venv venv env .env node_modules .git .idea .vscode .claude .mypy_cache .pytest_cache .tox build dist .eggs site-packages migrations",
    ),
}
LARGEST = 2 * 1024 * 1024


#: Folders that a task lists, and bytes that it reads, before what is left goes to others or on.
FOLDERS_LISTED, BYTES_READ = 2000, 16 << 20
LISTED = "path string, folder boolean, size long"


def _opened(root: str):
    """The file system and folder of an address or local path."""
    return pa_fs.FileSystem.from_uri(root if re.match(r"[a-z0-9]+:", root) else f"file://{root}")


def _walk(root: str, skipped: frozenset[str], most: int):
    """Lists folders below `root`, those within them too, until `most` are listed; gives the files, and the folders not listed."""

    def walk(frames):
        system, base = _opened(root)
        for frame in frames:
            waiting, listed, out = list(frame["path"]), 0, []
            while waiting and listed < max(most, len(frame)):
                folder = waiting.pop(0)
                listed += 1
                for info in system.get_file_info(pa_fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
                    path = f"{folder}/{info.base_name}".lstrip("/")
                    if isinstance(system, pa_fs.LocalFileSystem) and os.path.islink(info.path):
                        continue
                    if info.type == pa_fs.FileType.Directory:
                        if info.base_name not in skipped or "/" not in path:  # a repo may be called anything
                            waiting.append(path)
                    elif info.type == pa_fs.FileType.File:
                        out.append((path, False, info.size))
            out += [(path, True, None) for path in waiting]
            yield pd.DataFrame(out, columns=["path", "folder", "size"]).astype({"folder": bool, "size": "Int64"})

    return walk


def list_files(spark: SparkSession, root: str, skipped: frozenset[str] = frozenset(), folders: int = FOLDERS_LISTED) -> DataFrame:
    """(path, size) of the files below `root`, without ever listing a folder of a skipped name below the first level.

    The first level is listed alone, then every task lists what lies below its folders, `folders` of them at most, and hands
    on the rest, which the next round deals out again. Symbolic links of a local tree are not followed.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting, found, most = spark.createDataFrame([("",)], "path string"), None, 1
    while True:
        listed = stored(waiting.mapInPandas(_walk(root, skipped, most), LISTED))
        files = listed.where("NOT folder").select("path", "size")
        found = files if found is None else found.unionByName(files)
        waiting, most = listed.where("folder").select("path"), folders
        if waiting.isEmpty():
            return found
        waiting = waiting.repartition(parts, "path")


def _read(root: str):
    """(path, content, size) of files: those with a NUL in their first 4096 bytes are left out."""

    def read(frames):
        system, base = _opened(root)
        for frame in frames:
            out, held = [], 0
            for path in frame["path"]:
                with system.open_input_stream(f"{base}/{path}") as stream:
                    data = stream.read()
                if b"\0" not in data[:4096]:
                    out.append((path, data.decode("utf-8", "replace"), len(data)))
                    held += len(data)
                if held > BYTES_READ:
                    yield pd.DataFrame(out, columns=["path", "content", "size"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["path", "content", "size"])

    return read


def scan_source_files(spark: SparkSession, root: str, lang: str) -> DataFrame:
    """(repo, path, content, size) of the language's files below `root`; the first folder of a path is its repo.

    The language's skipped folders are never listed, and only files of wanted names and at most 2 MiB are opened. Files with
    a NUL in their first 4096 bytes are left out, as are empty ones; bytes that are no UTF-8 are replaced.
    """
    wanted, unwanted, skipped = SCAN[lang]
    files = list_files(spark, root, frozenset(skipped.split()))
    keep = F.col("path").rlike(wanted) & F.col("size").between(1, LARGEST) & F.contains("path", F.lit("/"))
    if unwanted:
        keep = keep & ~F.col("path").rlike(unwanted)
    files = files.where(keep).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    read = files.select("path").mapInPandas(_read(root), "path string, content string, size long")
    return read.select(F.substring_index("path", "/", 1).alias("repo"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "content", "size")


def read_projects(files: DataFrame, lang: str) -> DataFrame:
    """(repo, dir, name, root) of build files (repo, path, content): Maven artifacts, package names, Angular projects.

    An Angular project's sources lie in its sourceRoot, else in `src` below its root; a repo without projects is one, in
    `src`. A package's lie in `src` where `files` has some there, else in its own folder.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    last = F.when(folder == "", F.col("repo")).otherwise(F.substring_index(folder, "/", -1))
    if lang == "java":
        own = F.regexp_extract(F.regexp_replace("content", r"(?s)<parent>.*?</parent>", ""), r"<artifactId>\s*([^<\s]+)", 1)
        name = F.when(own != "", own).otherwise(last)
        return files.where(F.col("path").rlike("(^|/)pom\\.xml$")).select("repo", folder.alias("dir"), name.alias("name"), folder.alias("root"))
    within = lambda root: F.array_join(F.filter(F.array(F.col("dir"), F.regexp_replace(root, "/+$", "")), lambda p: p != ""), "/")
    if lang == "angular":
        listed = F.from_json("content", "projects map<string, struct<sourceRoot: string, root: string>>")["projects"]
        rows = files.where(F.col("path").rlike("(^|/)angular\\.json$")).select("repo", folder.alias("dir"), F.explode(listed).alias("name", "p"))
        nested = F.when(F.coalesce("p.root", F.lit("")) != "", F.concat("p.root", F.lit("/src"))).otherwise("src")
        found = rows.select("repo", "dir", "name", within(F.coalesce(F.when(F.col("p.sourceRoot") != "", F.col("p.sourceRoot")), nested)).alias("root"))
        lost = files.select("repo").distinct().join(found, "repo", "left_anti")
        return found.unionByName(lost.select("repo", F.lit("").alias("dir"), F.col("repo").alias("name"), F.lit("src").alias("root")))
    name = F.regexp_replace(F.from_json("content", "name string")["name"], "^@[^/]+/", "")
    rows = files.where(F.col("path").rlike("(^|/)package\\.json$")).select("repo", folder.alias("dir"), F.coalesce(name, last).alias("name"))
    source = F.when(F.startswith("path", F.lit("src/")), "").otherwise(F.regexp_extract("path", "^(.*?)/src/", 1))
    sourced = files.where(F.col("path").rlike("(^|/)src/")).select("repo", source.alias("dir"), F.lit("src").alias("src")).distinct()
    return rows.join(sourced, ["repo", "dir"], "left").select("repo", "dir", "name", F.when(F.col("src").isNotNull(), within(F.col("src"))).otherwise(F.col("dir")).alias("root"))


def write_fact_cache(facts: DataFrame, path: str) -> None:
    facts.write.mode("append").json(path)


def read_fact_cache(spark: SparkSession, path: str, schema: str, order: str = "written") -> DataFrame:
    """Facts of one-line JSON records; malformed lines are dropped, the record with the largest `order` per file stays."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    last = Window.partitionBy("repo", "path").orderBy(F.col(order).desc())
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


# --- decisions ----------------------------------------------------------------------------------------------------------

SCALARS = ("id", "title", "type", "status", "scope", "domain", "date", "context", "decision", "rationale", "supersedes", "confidence")
LISTS = ("authors", "consequences", "tags", "conflicts_with", "evidence")
DECISION = (
    "repo string, " + ", ".join(f"{c} string" for c in SCALARS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS)
    + ", alternatives array<struct<choice:string,rejected_because:string>>, evidence_hashes map<string,string>, error string"
)
PLAIN = r"^[A-Za-z0-9_./][A-Za-z0-9_./ -]*[A-Za-z0-9_./]$|^[A-Za-z_/]$"
RESERVED = r"(?i)^(true|false|null|yes|no|on|off|~)$|^[-+.0-9]"


def _quoted(value: Column) -> Column:
    """The scalar itself where it is safe, else a JSON string."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.rlike(PLAIN) & ~value.rlike(RESERVED), value).otherwise(quoted)


def decision_text(decisions: DataFrame) -> DataFrame:
    """(repo, domain, value): each decision as text, fields in fixed order, absent ones left out."""
    have = set(decisions.columns)
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}: "), _quoted(F.col(c)))) for c in SCALARS if c in have]
    for c in LISTS:
        if c in have:
            items = F.array_join(F.transform(c, lambda x: F.concat(F.lit("\n  - "), _quoted(x))), "")
            parts.append(F.when(F.size(F.coalesce(c, F.array())) > 0, F.concat(F.lit(f"{c}:"), items)))
    if "alternatives" in have:
        pair = lambda x: F.concat(F.lit("\n  - {choice: "), _quoted(x["choice"]), F.lit(", rejected_because: "), _quoted(x["rejected_because"]), F.lit("}"))
        parts.append(F.when(F.size(F.coalesce("alternatives", F.array())) > 0, F.concat(F.lit("alternatives:"), F.array_join(F.transform("alternatives", pair), ""))))
    if "evidence_hashes" in have:
        pairs = F.array_sort(F.map_entries("evidence_hashes"))
        lines = F.array_join(F.transform(pairs, lambda e: F.concat(F.lit("\n  "), _quoted(e["key"]), F.lit(": "), _quoted(e["value"]))), "")
        parts.append(F.when(F.size(pairs) > 0, F.concat(F.lit("evidence_hashes:"), lines)))
    return decisions.select("repo", "domain", F.concat_ws("\n", *parts).alias("value"))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decision texts in folders by repo and domain, parted by lines of three dashes."""
    texts = decision_text(decisions).withColumn("value", F.concat("value", F.lit("\n---")))
    texts.write.mode("overwrite").partitionBy("repo", "domain").text(path)


def _scalar(raw: str) -> str:
    raw = raw.strip()
    if raw.startswith('"'):
        return json.JSONDecoder().raw_decode(raw)[0]
    if raw.startswith("'"):
        return raw[1 : raw.rindex("'")].replace("''", "'")
    return raw.split(" #")[0].strip()


def _flow(raw: str) -> list[str]:
    """Top-level parts of a bracketed flow collection."""
    return [m.group().strip() for m in re.finditer(r'(?:"(?:\\.|[^"\\])*"|\'[^\']*\'|[^,"\'])+', raw.strip()[1:-1]) if m.group().strip()]


def _pair(raw: str) -> tuple[str, str]:
    m = re.match(r'("(?:\\.|[^"\\])*"|\'[^\']*\'|[^:]+?):\s*(.*)$', raw, re.S)
    if not m:
        raise ValueError(f"no key: {raw[:60]}")
    return _scalar(m.group(1)), m.group(2)


def parse_decision(text: str) -> dict:
    """A decision text: scalars, block scalars, lists in blocks or brackets, small maps, comments."""
    out: dict = {}
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, rest = _pair(line)
        block = []
        while at < len(lines) and (lines[at].startswith((" ", "\t")) or not lines[at].strip()):
            block.append(lines[at])
            at += 1
        rest = rest if rest.startswith(('"', "'")) else rest.split(" #")[0].strip()
        if rest in (">", "|", ">-", "|-"):
            body = [b.strip() for b in block]
            out[key] = (" " if rest[0] == ">" else "\n").join(body).strip()
        elif rest.startswith("[") and key in (*LISTS, "alternatives"):
            out[key] = [_scalar(x) for x in _flow(rest)]
        elif rest:
            out[key] = _scalar(rest)
        elif key in LISTS:
            out[key] = [_scalar(b.strip()[2:]) for b in block if b.strip().startswith("- ")]
        elif key == "alternatives":
            out[key] = [dict((k, _scalar(v)) for k, v in map(_pair, _flow(b.strip()[2:]))) for b in block if b.strip().startswith("- {")]
        elif key == "evidence_hashes":
            out[key] = [(k, _scalar(v)) for k, v in (_pair(b.strip()) for b in block if b.strip())]
    return out


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of text files, one or more to a file; a text that can't be read keeps its row with `error`.

    Where a text has no id, the path without extension is; where it has no domain, the id's first part.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"(?m)^---\s*$")).alias("n", "value")).where("trim(value) <> ''")
    base = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/")

    def parse(frames):
        for frame in frames:
            out = []
            for file, value in zip(frame["file"], frame["value"]):
                rel = re.sub(r"^[a-z0-9]+:/*", "/", file).removeprefix(base).strip("/")
                repo = re.search(r"repo=([^/]+)/", rel)
                try:
                    found, error = parse_decision(value.strip("\n")), None
                except ValueError as e:
                    found, error = {}, str(e)
                row = {c: found.get(c) for c in (*SCALARS, *LISTS)} | {"repo": repo.group(1) if repo else None, "error": error}
                row["id"] = row["id"] or re.sub(r"\.ya?ml$", "", rel)
                row["domain"] = row["domain"] or row["id"].split("/")[0]
                row["alternatives"] = [{"choice": a.get("choice"), "rejected_because": a.get("rejected_because")} for a in found.get("alternatives", [])] or None
                row["evidence_hashes"] = dict(found["evidence_hashes"]) if found.get("evidence_hashes") else None
                out.append(row)
            yield pd.DataFrame(out)

    return rows.select("file", "value").mapInPandas(parse, DECISION)


# --- JSON layers and index tables ---------------------------------------------------------------------------------------

CONTEXT_FIELDS = "name string, purpose string, capabilities array<string>, business_rules array<string>, intents map<string,string>, evidence_hash string, src_hash string"


def read_functional(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The context and module tables of JSON texts (repo, content); text that can't be read gives no rows."""
    parsed = files.select("repo", F.explode(F.from_json("content", "map<string,string>")).alias("key", "value"))
    fields = parsed.where("key <> '__modules__'").select("repo", F.col("key").alias("ctx_id"), F.from_json("value", CONTEXT_FIELDS).alias("f"))
    modules = parsed.where("key = '__modules__'").select("repo", F.explode(F.from_json("value", "map<string,struct<theme:string,keywords:array<string>,context_hash:string>>")).alias("module", "m"))
    return fields.select("repo", "ctx_id", "f.*"), modules.select("repo", "module", "m.*")


def _json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def functional_json(functional: DataFrame, modules: DataFrame | None = None, per_text: int = 1000) -> DataFrame:
    """(repo, content): each repo's contexts, and under `__modules__` its modules, as JSON objects by id.

    A repo of more than about `per_text` contexts or modules gives several texts, so that none has to fit a task whole;
    read_functional reads them all.
    """

    def texts(table: DataFrame, key: str) -> DataFrame:
        row = F.struct(*[c for c in table.columns if c not in ("repo", key)])
        parts = table.groupBy("repo").agg(F.ceil(F.count("*") / per_text).alias("parts"))
        rows = table.select("repo", F.concat(_json_string(F.col(key)), F.lit(":"), F.to_json(row)).alias("entry"), F.xxhash64(key).alias("h")).join(parts, "repo")
        body = F.array_join(F.array_sort(F.collect_list("entry")), ",")
        return rows.groupBy("repo", F.pmod("h", F.col("parts")).alias("part")).agg(F.concat(F.lit("{"), body, F.lit("}")).alias("content")).drop("part")

    out = texts(functional, "ctx_id")
    if modules is None:
        return out
    listed = texts(modules, "module").withColumn("content", F.concat(F.lit('{"__modules__":'), "content", F.lit("}")))
    return out.unionByName(listed)


def read_inference_batch(texts: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON arrays or single objects in `content`, within a fence of three backticks or not."""
    bare = F.trim(F.regexp_replace("content", r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", ""))
    listed = F.when(F.startswith(bare, F.lit("[")), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return texts.select(F.inline(F.from_json(listed, f"array<struct<{schema}>>")))


def _files_of(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def index_generation(spark: SparkSession, path: str) -> int:
    """The last committed generation of the index at `path`; 0 where there is none."""
    system, at = _files_of(spark, path)
    if not system.exists(at(f"{path}/manifest")):
        return 0
    return max([int(f.getPath().getName()) for f in system.listStatus(at(f"{path}/manifest"))], default=0)


def index_manifest(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """(key, content_hash, part): the keys of a generation, and the folder that holds each one's rows."""
    return spark.read.schema("key string, content_hash string, part string").parquet(f"{path}/manifest/{generation}")


def read_index(spark: SparkSession, path: str, key: str, schema: str, generation: int | None = None) -> DataFrame:
    """The rows of a generation, the last by default; a reader keeps its generation while others are written.

    `schema` has the table's columns but `key`, which comes as a string.
    """
    generation = generation or index_generation(spark, path)
    if not generation:
        return spark.createDataFrame([], f"{key} string, {schema}")
    manifest = index_manifest(spark, path, generation)
    parts = [r.part for r in manifest.select("part").distinct().collect()]  # one a generation that still has rows
    if not parts:
        return spark.createDataFrame([], f"{key} string, {schema}")
    rows = spark.read.schema(f"index_key string, {schema}").parquet(*[f"{path}/data/{p}" for p in parts])
    part = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1)
    held = manifest.select(F.col("key").alias("index_key"), "part")
    return rows.withColumn("part", part).join(held, ["index_key", "part"], "left_semi").drop("part").withColumnRenamed("index_key", key)


def write_index(spark: SparkSession, table: DataFrame, path: str, key: str) -> DataFrame:
    """(key, content_hash, change) of `table` against the last generation at `path`: added, changed, same or removed.

    Only rows of added and changed keys are written, to a folder of their own, gathered to files of the session's target size and sorted by key.
    A manifest then names the folder of every key; renaming it to its number commits the generation. A write that ends
    before leaves the generation before as it was, and of two writers at once only one can commit. A key's content is the
    number and order-free sums of the hashes of its rows. Keys are strings and not null.
    """
    row = F.to_json(F.struct(*[c for c in table.columns if c != key]))
    hashed = table.select(F.col(key).alias("key"), F.xxhash64(row).alias("h"), F.xxhash64(F.lit(7), row).alias("g"))
    sums = F.concat_ws("-", F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("g"))
    now = hashed.groupBy("key").agg(F.sha1(sums.cast("binary")).alias("now"))
    last = index_generation(spark, path)
    old = index_manifest(spark, path, last) if last else spark.createDataFrame([], "key string, content_hash string, part string")
    joined = now.join(old.withColumnRenamed("content_hash", "old"), "key", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old") != F.col("now"), "changed").otherwise("same")
    changes = stored(joined.select("key", F.col("now").alias("content_hash"), change.alias("change"), "part"))
    folder = f"{last + 1}-{uuid.uuid4().hex}"
    todo = table.withColumnRenamed(key, "index_key")
    todo = todo.join(changes.where("change IN ('added', 'changed')").select(F.col("key").alias("index_key")), "index_key", "left_semi")
    todo.hint("rebalance", "index_key").sortWithinPartitions("index_key").write.parquet(f"{path}/data/{folder}")
    part = F.when(F.col("change") == "same", F.col("part")).otherwise(folder).alias("part")
    changes.where("change <> 'removed'").select("key", "content_hash", part).write.parquet(f"{path}/pending/{folder}")
    system, at = _files_of(spark, path)
    system.mkdirs(at(f"{path}/manifest"))
    target = at(f"{path}/manifest/{last + 1}")
    if system.exists(target) or not system.rename(at(f"{path}/pending/{folder}"), target):
        raise RuntimeError(f"generation {last + 1} of {path} was written by another")
    return changes.select(F.col("key").alias(key), "content_hash", "change")


def clean_index(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the manifests but the last `keep`, and the folders that none of those names; the folders' names.

    Folders of a write that goes on are named by no manifest yet: clean only while nothing writes.
    """
    system, at = _files_of(spark, path)
    last = index_generation(spark, path)
    kept = [g for g in range(max(1, last - keep + 1), last + 1)]
    named = {r.part for g in kept for r in index_manifest(spark, path, g).select("part").distinct().collect()}
    gone = [f.getPath().getName() for f in system.listStatus(at(f"{path}/data")) if f.getPath().getName() not in named]
    for number in {int(f.getPath().getName()) for f in system.listStatus(at(f"{path}/manifest"))} - set(kept):
        system.delete(at(f"{path}/manifest/{number}"), True)
    for name in gone:
        system.delete(at(f"{path}/data/{name}"), True)
    return sorted(gone)


def write_tree(files: DataFrame, root: str) -> None:
    """Each row (repo, path, content) as the file `root`/repo/path, written by the tasks; a file written twice is the same."""

    def write(frames):
        system, base = _opened(root)
        for frame in frames:
            for repo, path, content in zip(frame["repo"], frame["path"], frame["content"]):
                target = f"{base}/{repo}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pd.DataFrame({"n": [len(frame)]})

    files.select("repo", "path", "content").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def write_postings(index: DataFrame, path: str) -> None:
    """One row per term with its sorted ids, files sorted by term."""
    rows = index.groupBy("repo", "term").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rows.repartition("repo", "term").sortWithinPartitions("repo", "term").write.mode("overwrite").parquet(path)
