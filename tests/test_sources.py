"""Sources and sinks on small folders."""

from corpusindex.sources import files as io

BLOCKS = '''id: auth/x
title: "Use RLS, \\"quotes\\" & colon: yes" # note
status: active # still
context: >
  folded
  lines
rationale: |
  kept
  lines
tags: [a, "b, c", d]
consequences:
  - "one, two: three"
  - plain
alternatives:
  - {choice: "app filter", rejected_because: "easy, to: forget"}
evidence:
  - src/x.ts:12
  - "PR #245"
evidence_hashes:
  src/x.ts:12: aaaa
'''


def test_decision_text_forms():
    got = io.parse_decision(BLOCKS)
    assert got["title"] == 'Use RLS, "quotes" & colon: yes' and got["status"] == "active"
    assert got["context"] == "folded lines" and got["rationale"] == "kept\nlines"
    assert got["tags"] == ["a", "b, c", "d"] and got["consequences"] == ["one, two: three", "plain"]
    assert got["alternatives"] == [{"choice": "app filter", "rejected_because": "easy, to: forget"}]
    assert got["evidence"] == ["src/x.ts:12", "PR #245"]


def test_decision_files(spark, tmp_path):
    (tmp_path / "auth").mkdir()
    (tmp_path / "auth" / "one.yaml").write_text("title: One\ndecision: yes")
    (tmp_path / "auth" / "two.yaml").write_text("no colon here")
    got = {r["id"]: r for r in io.read_decisions(spark, str(tmp_path)).collect()}
    assert got["auth/one"]["domain"] == "auth" and got["auth/one"]["decision"] == "yes" and got["auth/one"]["error"] is None
    assert got["auth/two"]["error"].startswith("no key")


def test_decision_roundtrip(spark, tmp_path):
    given = [("r", "a/1", "null", "x: y", ["- odd", "#x", "1.5", "é"], [("c, {d}", "r: e")], {"f.py:1-2": "0123"})]
    schema = "repo string, id string, title string, decision string, tags array<string>, alternatives array<struct<choice:string,rejected_because:string>>, evidence_hashes map<string,string>"
    table = spark.createDataFrame(given, schema).selectExpr("*", "'a' AS domain")
    io.write_decisions(table, str(tmp_path / "out"))
    row = io.read_decisions(spark, str(tmp_path / "out")).first()
    assert (row["repo"], row["id"], row["title"], row["decision"], row["tags"]) == given[0][:5]
    assert [tuple(a) for a in row["alternatives"]] == given[0][5] and row["evidence_hashes"] == given[0][6] and row["error"] is None


def test_scan_and_projects(spark, tmp_path):
    tree = {
        "shop/pom.xml": "<project><parent><artifactId>up</artifactId></parent><artifactId>shop</artifactId></project>",
        "shop/user/pom.xml": "<project><parent><artifactId>up</artifactId></parent></project>",
        "shop/user/src/A.java": "class A {}",
        "shop/target/B.java": "class B {}",
        "shop/user/src/Nul.java": "a\0b",
        "web/package.json": '{"name": "@org/web"}',
        "web/src/x.spec.ts": "", "web/src/y.ts": "let y", "web/src/y.d.ts": "", "web/node_modules/z.js": "",
        "py/test_a.py": "", "py/a.py": "x = 1", "py/.venv/b.py": "",
    }
    for name, text in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = lambda lang: sorted((r["repo"], r["path"]) for r in io.scan_source_files(spark, str(tmp_path), lang).collect())
    assert found("java") == [("shop", "user/src/A.java")]
    assert found("node") == [("web", "src/y.ts")]
    assert found("python") == [("py", "a.py")]
    files = spark.createDataFrame([(k.split("/")[0], k.split("/", 1)[1], v) for k, v in tree.items()], "repo string, path string, content string")
    assert sorted(tuple(r)[:3] for r in io.read_projects(files, "java").collect()) == [("shop", "", "shop"), ("shop", "user", "user")]
    assert [r["name"] for r in io.read_projects(files, "node").collect()] == ["web"]
