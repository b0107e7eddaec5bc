"""Column functions, change detection, logs and decisions on small hand-made tables."""

import datetime
import random
import re

from pyspark.sql import functions as F

from corpusindex.facts.blank import blanked
from corpusindex.facts.java import extract_java_facts, parse_java
from corpusindex.functions import text
from corpusindex.operators import changes, decisions, functional, java, ledger, logs, retrieval
from corpusindex.streaming import streams


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_terms(spark):
    got = column(spark, ["How does the Chat feature's classes, stories & buses work?", None, "glass gas"], text.normalize_terms)
    assert got == [["chat", "feature", "class", "story", "bus", "work"], [], ["glass", "gas"]]


def test_slug_and_tokens(spark):
    assert column(spark, ["Hello,  World!", "", "--é--", "x" * 80 + "-"], text.slugify) == ["hello-world", "decision", "decision", "x" * 60]
    assert column(spark, ["abcdef", "é", None], text.tokens) == [2, 1, 0]
    assert column(spark, ["abc"], text.content_hash) == ["a9993e36"]


def entry(spark, **change):
    rows = [("r", 0, "how does the chat feature work", "feature", "ENG1", "it does")]
    table = spark.createDataFrame(rows, "repo string, entry int, q string, scope string, engine string, a string")
    return ledger.with_deps(table, F.lit("shop/features.chat"), F.lit("AAAA"))


def test_ledger_verdicts(spark):
    ask = spark.createDataFrame([("r", "1", "explain the chat feature work please", "feature")], "repo string, query_id string, q string, scope string")
    now = lambda h: spark.createDataFrame([("r", "shop/features.chat", h)], "repo string, ctx string, h string")
    verdict = lambda h, e, q=ask: [r["verdict"] for r in ledger.answer_lookup(q, entry(spark), now(h), e).collect()]
    assert verdict("AAAA", "ENG1") == ["fresh"] and verdict("BBBB", "ENG1") == ["stale"] and verdict("AAAA", "ENG2") == ["engine"]
    assert verdict("AAAA", "ENG1", ask.withColumn("scope", F.lit("routes"))) == []
    assert [r["kept"] for r in ledger.ledger_gc(entry(spark), "ENG2").collect()] == [False]


def plain_prune(lines, head, tail, context, most):
    if len(lines) <= head + tail + 10:
        return list(range(len(lines)))
    keep = {i for i in range(len(lines)) if i < head or i >= len(lines) - tail}
    for i, line in enumerate(lines):
        if re.search(r"\berror\b", line):
            keep |= set(range(max(0, i - context), min(len(lines), i + context + 1)))
            if len(keep) > most:
                break
    return sorted(keep)


def test_prune_against_a_loop(spark):
    draw = random.Random(8)
    cases, rows = {}, []
    for log in range(25):
        lines = ["error x" if draw.random() < draw.choice([0.02, 0.3]) else "ok" for _ in range(draw.choice([3, 30, 31, 80, 200]))]
        cases[str(log)] = lines
        rows += [(str(log), i, t) for i, t in enumerate(lines)]
    table = spark.createDataFrame(rows, "log_id string, line_no int, text string")
    for options in ({"head": 5, "tail": 5, "context": 1, "max_keep": 30}, {"head": 10, "tail": 10, "context": 2, "max_keep": 15}):
        got = {}
        for r in logs.prune_logs(table, **options).collect():
            got.setdefault(r["log_id"], {})[r["line_no"]] = r
        for log, lines in cases.items():
            kept = plain_prune(lines, *options.values())
            assert sorted(got[log]) == kept
            before, last = [b - a - 1 for a, b in zip([-1, *kept], kept)], len(lines) - 1 - kept[-1]
            assert [got[log][i]["elided_before"] for i in kept] == before and got[log][kept[-1]]["elided_after"] == last


def test_even_sample(spark):
    for n, size in ((3, 10), (7, 7), (5, 4), (4, 9)):
        table = spark.createDataFrame([("g", i) for i in range(size)], "g string, i int")
        got = sorted(r["i"] for r in logs.even_sample(table, n, "g", "i").collect())
        assert got == sorted({i * size // n for i in range(n)} if size > n else range(size))


def test_change_classes(spark):
    now = spark.createDataFrame([("r", p, h) for p, h in (("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"))], "repo string, path string, hash string")
    old = [("a", "1", None, True), ("b", "x", None, True), ("c", "3", "bad", True), ("d", "4", None, False), ("z", "9", None, True)]
    manifest = spark.createDataFrame([("r", p, h, e, "E", c) for p, h, e, c in old], "repo string, path string, hash string, parse_error string, engine_hash string, cached boolean")
    got = lambda *a: {r["path"]: r["status"] for r in changes.classify_changes(now, manifest, *a).collect()}
    assert got("E") == {"a": "reused", "b": "parsed", "c": "parsed", "d": "parsed", "e": "parsed", "z": "gone"}
    assert set(got("F").values()) == {"parsed", "gone"} and set(got("E", True).values()) == {"parsed", "gone"}


def test_evidence_references(spark):
    refs = ["src/x.ts:12", "v2.0", "RFC 7807.1", "PR #245", "https://a.b/c", "policy.sql:3", "#12", "readme.md"]
    assert column(spark, refs, decisions.is_file_ref) == [True, False, False, False, False, True, False, True]
    table = spark.createDataFrame([("1\n2\n3\n4", "f.sql:2-3"), ("1\n2", "f.sql:2"), ("1\n2", "f.sql"), ("1", "f.sql:9")], "c string, r string")
    assert [r[0] for r in table.select(decisions.cited(F.col("c"), F.col("r"))).collect()] == ["2\n3", "2", "1\n2", ""]


def test_cues(spark):
    texts = ["From now on we should always use RLS", "tu devrais toujours valider les entrées", "le build est toujours cassé sur ma machine", "the ruler is", None]
    table = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, msg_id string, text string")
    assert sorted(r["msg_id"] for r in decisions.cue_messages(table).collect()) == ["0", "1"]


def test_generated_decisions_are_found(spark):
    made = decisions.generate_decisions(spark, 500).select(F.lit("r").alias("repo"), "*").withColumn("tags", F.array("domain"))
    made = made.withColumn("context", F.lit(None).cast("string")).withColumn("consequences", F.array().cast("array<string>"))
    ask = spark.createDataFrame([("r", "q", "retry policy kafka")], "repo string, query_id string, q string")
    hits = retrieval.recall(ask, made).orderBy("rank").collect()
    assert hits and hits[0]["rank"] == 1 and hits[0]["shown"] in (1, 3)
    top = made.where(F.col("id") == hits[0]["id"]).first()
    assert "retry" in top["title"] and top["status"] != "superseded"


def test_evidence_is_bounded(spark):
    files = spark.createDataFrame([("r", "c", f"f{i}", i, "x" * 5000) for i in range(6)], "repo string, ctx_id string, path string, place int, content string")
    got = functional.evidence_sources(files).orderBy("place").collect()
    assert [r["place"] for r in got] == [0, 1, 2, 3] and all(r["truncated"] for r in got)
    assert got[0]["source"] == "x" * 4000 + functional.CUT_MARK


JAVA = '''
package com.demo.user;
import x.Y;
/** class Ghost { } */
@org.springframework.web.bind.annotation.RestController
@RequestMapping("/users")
public class UserController {
  private static final String TEXT = """
    class Phantom { void no() { } }
  """;
  private final UserService service;
  public UserController(UserService service) { this.service = service; }
  @PostMapping(
      value = "/",
      consumes = "x")
  public <T> Map<String, Integer> create(@RequestBody @Valid TagRequest dto, final List<Map<String, Order>> rest) { if (a) { while (b) { } } return null; }
  @GetMapping("/{id}") public User get(String id);
  static class Inner { int[] xs = {1, 2}; }
}
interface Two extends A<B>, C { default void run() { } }
'''


def test_java_facts():
    facts = parse_java(JAVA)
    assert facts["pkg"] == "com.demo.user"
    types = {t["name"]: t for t in facts["types"]}
    assert set(types) == {"UserController", "Inner", "Two"}
    user = types["UserController"]
    assert [(m["name"], m["sig"], m["isCtor"], m["reqBody"]) for m in user["methods"]] == [
        ("UserController", "(UserService)", True, None),
        ("create", "(TagRequest, List<Map<String, Order>>):Map<String, Integer>", False, "TagRequest"),
        ("get", "(String):User", False, None),
    ]
    assert [(f["name"], f["type"]) for f in user["fields"]] == [("TEXT", "String"), ("service", "UserService")]
    assert types["Two"]["ext"] == "A<B>, C" and types["Inner"]["fields"][0]["type"] == "int[]"
    assert user["line"] == 7 and user["methods"][1]["ann"][0].startswith("@PostMapping(")


def test_blanked_keeps_length_and_lines():
    for lang, source in (("java", JAVA), ("python", "x = 'a#b' # c\n'''d\ne'''\nf"), ("typescript", "a(`x ${b('}')} y`) // z\n/* q\n */")):
        code = blanked(source, lang)
        assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
    assert blanked("x = 'a#b' # c", "python").split() == ["x", "="]


def test_java_model(spark):
    sources = {
        "user/src/UserController.java": "package com.demo.user; @RestController @RequestMapping(\"/users\") class UserController { UserController(UserService s) {} @PostMapping User create(@RequestBody UserDto d) {} @GetMapping(\"/{id}\") User get(String id) {} }",
        "user/src/UserService.java": "package com.demo.user; @Service class UserService { UserService(UserRepository r, Map<String, Integer> m) {} }",
        "user/src/UserRepository.java": "package com.demo.user; interface UserRepository extends JpaRepository<User, Long> {}",
        "user/src/User.java": "package com.demo.user; @Entity @Table(name = \"users\") class User { @OneToMany List<Order> orders; }",
        "broken.java": None,
    }
    files = changes.with_hash(spark.createDataFrame([("r", p, c) for p, c in sources.items()], "repo string, path string, content string"))
    facts = java.assign_java(extract_java_facts(files), spark.createDataFrame([("r", "user", "user"), ("r", "us", "no")], "repo string, dir string, name string"))
    types, contexts = java.types_of(facts), java.java_contexts(facts)
    flows = {r["flow"]: r for r in java.java_flows(java.java_endpoints(types), java.java_beans(types), contexts).collect()}
    assert set(flows) == {f"{e} → UserService → UserRepository" for e in ("POST /users → UserController.create", "GET /users/{id} → UserController.get")}
    assert [tuple(r)[3:] for r in java.java_entities(types).collect()] == [("User", "users", "OneToMany:Order", "UserRepository")]
    assert {r["ctx_id"] for r in contexts.collect()} == {"user/com.demo.user", "r/(default)"}
    assert {r["fn"] for r in java.entity_leaks(java.java_endpoints(types), java.java_entities(types)).collect()} == {"UserController.create", "UserController.get"}


def test_touch_queue(spark, tmp_path):
    rows = [("r", "a.java", datetime.datetime(2024, 1, 1)), ("r", "a.java", datetime.datetime(2024, 1, 2)), ("r", "b.txt", datetime.datetime(2024, 1, 3))]
    schema = "repo string, file string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    drained = []
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.touch_queue(stream, "java", lambda batch, n: drained.extend(batch.collect()), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in drained] == [("r", "a.java")]
