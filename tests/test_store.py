"""What is written and read again, plans that read sources once, and blanked templates."""

from pyspark.sql import functions as F

from corpusindex.facts.blank import blanked
from corpusindex.jobs import java_queries, web_queries
from corpusindex.operators import changes, retrieval
from corpusindex.sources import files as io
from corpusindex.sources import store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_reader_stands_in_a_plan_twice(spark):
    flows = java_queries.QUERIES["java_flows"](spark, SF)
    assert plan(flows).count("MapInPandas") == 0  # the facts are read from the table that was written
    assert plan(web_queries.QUERIES["python_flows"](spark, SF)).count("MapInPandas") == 0


def test_index_generations_come_and_go(spark, tmp_path):
    path = str(tmp_path / "index")
    table = lambda *rows: spark.createDataFrame(rows, "ctx string, v int")
    reported = lambda df: {r["ctx"]: r["change"] for r in df.collect()}
    held = lambda g=None: sorted(tuple(r) for r in io.read_index(spark, path, "ctx", "v int", g).select("ctx", "v").collect())
    assert io.index_generation(spark, path) == 0 and held() == []
    assert reported(io.write_index(spark, table(("a/1", 1), ("a/1", 2), ("b", 3), ("c", 4)), path, "ctx")) == {"a/1": "added", "b": "added", "c": "added"}
    assert reported(io.write_index(spark, table(("a/1", 2), ("a/1", 1), ("b", 5)), path, "ctx")) == {"a/1": "same", "b": "changed", "c": "removed"}
    assert held() == [("a/1", 1), ("a/1", 2), ("b", 5)]
    assert reported(io.write_index(spark, table(("a/1", 1), ("a/1", 2), ("b", 5)), path, "ctx")) == {"a/1": "same", "b": "same"}  # c is not there to be removed again
    assert reported(io.write_index(spark, table(("b", 5), ("c", 4)), path, "ctx")) == {"a/1": "removed", "b": "same", "c": "added"}
    assert held() == [("b", 5), ("c", 4)] and held(1) == [("a/1", 1), ("a/1", 2), ("b", 3), ("c", 4)]  # a reader keeps its generation
    gone = io.clean_index(spark, path, keep=1)
    assert len(gone) == 2 and held() == [("b", 5), ("c", 4)]


def test_a_write_killed_half_way_leaves_the_index_readable(spark, tmp_path, monkeypatch):
    import pytest

    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "ctx string, v int")
    io.write_index(spark, rows, path, "ctx")
    whole = io._files_of

    def killed(*_):
        raise KeyboardInterrupt

    def before_commit(session, at):
        system, make = whole(session, at)
        return system, killed if (tmp_path / "index" / "pending").exists() and any((tmp_path / "index" / "pending").iterdir()) else make

    monkeypatch.setattr(io, "_files_of", before_commit)
    with pytest.raises(KeyboardInterrupt):
        io.write_index(spark, rows.withColumn("v", F.col("v") + 1), path, "ctx")
    monkeypatch.setattr(io, "_files_of", whole)
    assert io.index_generation(spark, path) == 1
    assert sorted(r["v"] for r in io.read_index(spark, path, "ctx", "v int").collect()) == [1, 2]
    assert {r["change"] for r in io.write_index(spark, rows.withColumn("v", F.col("v") + 1), path, "ctx").collect()} == {"changed"}
    assert sorted(r["v"] for r in io.read_index(spark, path, "ctx", "v int").collect()) == [2, 3]


def test_a_job_removes_what_it_stored(spark):
    import os

    with store.job(spark):
        df = store.stored(spark.range(5))
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert store.stored(spark.range(2)).count() == 2


def test_a_rollup_of_changes_is_a_rebuild_and_leaves_the_rest_in_place(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(rows, "repo string, path string, ctx_id string, module string, hash string")
    old = files(("r", "a", "m/x", "m", "1"), ("r", "b", "m/x", "m", "2"), ("r", "c", "m/y", "m", "3"), ("r", "d", "n/z", "n", "4"), ("r", "e", "o/w", "o", "5"))
    new = files(("r", "a", "m/x", "m", "1"), ("r", "b", "m/x", "m", "9"), ("r", "d", "n/z", "n", "4"), ("r", "f", "n/v", "n", "6"), ("r", "e", "o/w", "o", "5"))
    manifest = old.select("repo", "path", "hash", F.lit(None).cast("string").alias("parse_error"), F.lit("E").alias("engine_hash"), F.lit(True).alias("cached"))
    classes = changes.classify_changes(new, manifest, "E")
    touched = changes.touched_groups(classes, old, new, "repo", "ctx_id")
    assert {r["ctx_id"] for r in touched.collect()} == {"m/x", "m/y", "n/v"}
    before = changes.context_fingerprint(old)
    after = changes.rolled_up(before, new, touched, ("repo", "ctx_id"), changes.context_fingerprint)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, changes.context_fingerprint(new).collect()))
    path = str(tmp_path / "index")
    io.write_index(spark, before, path, "ctx_id")
    parts = lambda g: {r["key"]: r["part"] for r in io.index_manifest(spark, path, g).collect()}
    reported = {r["ctx_id"]: r["change"] for r in io.write_index(spark, after, path, "ctx_id").collect()}
    assert reported == {"m/x": "changed", "m/y": "removed", "n/v": "added", "n/z": "same", "o/w": "same"}
    assert all(parts(1)[k] == parts(2)[k] for k in ("n/z", "o/w"))


def test_tree_round_trip(spark, tmp_path):
    rows = [("r1", "a/b.py", "x = 1\né"), ("r2", "c.py", ""), ("r2", "d.py", " "), ("r2", "e.py", None)]
    io.write_tree(spark.createDataFrame(rows, "repo string, path string, content string"), str(tmp_path))
    got = {(r["repo"], r["path"]): r["content"] for r in io.scan_source_files(spark, str(tmp_path), "python").collect()}
    assert got == {("r1", "a/b.py"): "x = 1\né", ("r2", "d.py"): " "}  # empty files are left out


def test_skipped_folders_are_not_listed(spark, tmp_path, monkeypatch):
    rows = [("r1", "src/a.js", "a"), ("r1", "node_modules/x/deep/b.js", "b"), ("r1", "src/.git/c.js", "c"), ("r1", "s/t/u/v/w/d.js", "d"), ("dist", "e.js", "e"), ("r2", "f.txt", "f")]
    io.write_tree(spark.createDataFrame(rows, "repo string, path string, content string"), str(tmp_path))
    (tmp_path / "r2" / "loop").symlink_to(tmp_path)
    (tmp_path / "r2" / "bad.js").write_bytes(b"x\xff")
    walked = []
    real = io.pa_fs.FileSelector
    monkeypatch.setattr(io.pa_fs, "FileSelector", lambda path, **options: walked.append(path) or real(path, **options))
    import pandas as pd

    waiting = [""]
    while waiting:  # the tasks' own function, one folder at a time
        frame = next(io._walk(str(tmp_path), frozenset(io.SCAN["node"][2].split()), 1)(iter([pd.DataFrame({"path": waiting[:1]})])))
        waiting = waiting[1:] + list(frame["path"][frame["folder"]])
    below = {p.removeprefix(str(tmp_path)) for p in walked}
    assert "/s/t/u/v/w" in {p.removeprefix("/r1") for p in below} and not any("node_modules" in p or ".git" in p or "loop" in p for p in below)
    monkeypatch.undo()
    for most in (1, 2000):
        listed = io.list_files(spark, str(tmp_path), frozenset(["node_modules", ".git"]), most)
        assert sorted(r["path"] for r in listed.collect()) == ["dist/e.js", "r1/s/t/u/v/w/d.js", "r1/src/a.js", "r2/bad.js", "r2/f.txt"]
    got = {(r["repo"], r["path"], r["content"], r["size"]) for r in io.scan_source_files(spark, f"file://{tmp_path}", "node").collect()}
    assert got == {("r1", "src/a.js", "a", 1), ("r1", "s/t/u/v/w/d.js", "d", 1), ("dist", "e.js", "e", 1), ("r2", "bad.js", "x\ufffd", 2)}


def test_templates_within_templates():
    code = 'a = `x ${ f({k: `in ${"}"} ner` }) } class Fake {`; class Real { m() { return `${`${1}`}`; } }'
    got = blanked(code, "typescript")
    assert len(got) == len(code) and "Fake" not in got and "class Real { m() { return" in got and got.endswith("; } }")
    assert blanked("`open ${ `x", "typescript").strip() == "" and blanked("`a\n${b}\nc`;", "typescript") == "  \n    \n  ;"


def test_recall_of_rows_without_terms(spark):
    docs = spark.createDataFrame([("r", "1", ["cache"]), ("r", "2", []), ("r", "3", ["cache", "retry"])], "repo string, id string, terms array<string>")
    queries = spark.createDataFrame([("r", "q", ["cache", "unseen"]), ("r", "none", [])], "repo string, query_id string, terms array<string>")
    index = retrieval.build_index(docs, F.col("id") != "3")
    assert index.sizes.first()["n"] == 3
    got = retrieval.overlap_scores(queries, index).collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [("q", "1", 1.0)]
