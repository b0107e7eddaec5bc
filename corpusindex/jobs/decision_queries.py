"""Decision log, answer cache, change detection and log accounts over the test views, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.functions.text import content_hash, make_id, slugify, tokens
from corpusindex.jobs.retrieval_queries import ACTIVE, DECISIONS_SQL, HAYSTACK, RANKED_SQL, decisions, kept_index, scores_sql, terms_sql
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import changes, logs
from corpusindex.operators import decisions as log
from corpusindex.operators import ledger as cache
from corpusindex.operators import postings
from corpusindex.sources.store import stored

SCOPE_SQL = "coalesce(nullif(scope, ''), CASE WHEN type IN ('architecture', 'convention') THEN 'global' ELSE 'domain' END)"


# --- decisions ----------------------------------------------------------------------------------------------------------


def flawed(spark, d):
    """Decisions of which some lack or misspell fields."""
    n = F.col("doc_id")
    return decisions(spark, d).select(
        "repo", "id", "doc_id",
        F.when(n % 8 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(n % 10 == 0, "styling").otherwise(F.col("type")).alias("type"),
        F.when(n % 12 == 0, "open").otherwise(F.col("status")).alias("status"),
        F.when(n % 14 == 0, "planet").otherwise(F.col("scope")).alias("scope"),
        F.when(n % 9 == 0, None).otherwise(F.col("domain")).alias("domain"),
        F.when(n % 15 == 0, "2024/01/02").otherwise(F.col("date")).alias("date"),
        F.when(n % 16 == 0, "sure").when(n % 3 == 0, "high").alias("confidence"),
        "context", "decision", "rationale",
    )


FLAWED_SQL = f"""
    SELECT repo, id, doc_id, CASE WHEN doc_id % 8 = 0 THEN '' ELSE title END AS title,
           CASE WHEN doc_id % 10 = 0 THEN 'styling' ELSE type END AS type, CASE WHEN doc_id % 12 = 0 THEN 'open' ELSE status END AS status,
           CASE WHEN doc_id % 14 = 0 THEN 'planet' ELSE scope END AS scope, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE domain END AS domain,
           CASE WHEN doc_id % 15 = 0 THEN '2024/01/02' ELSE date END AS date,
           CASE WHEN doc_id % 16 = 0 THEN 'sure' WHEN doc_id % 3 = 0 THEN 'high' END AS confidence, context, decision, rationale
    FROM {sql_for("decisions_v")}"""

FRENCH_SQL = "(?i)[àâäçéèêëîïôöùûü]|(^|[^A-Za-z0-9_])(le|la|les|une|des|nous|pour|avec|sans|être|décision|fonctionnel)([^A-Za-z0-9_]|$)"


def _errors(spark, d):
    checked = log.validate(flawed(spark, d))
    return checked.select("repo", "id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


ERRORS_SQL = f"""
    SELECT repo, id, concat_ws('; ',
        CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing required field: title' END,
        CASE WHEN trim(coalesce(domain, '')) = '' THEN 'missing required field: domain' END,
        CASE WHEN trim(coalesce(decision, '')) = '' THEN 'missing required field: decision' END,
        CASE WHEN type = 'styling' THEN 'invalid type: styling (expected architecture|technical|functional|convention)' END,
        CASE WHEN status = 'open' THEN 'invalid status: open (expected proposed|active|superseded|deprecated)' END,
        CASE WHEN scope = 'planet' THEN 'invalid scope: planet (expected global|domain|local)' END,
        CASE WHEN confidence = 'sure' THEN 'invalid confidence: sure' END,
        CASE WHEN date = '2024/01/02' THEN 'invalid date (want YYYY-MM-DD): 2024/01/02' END) AS errors,
      coalesce('field "' || CASE WHEN regexp_matches(title, '{FRENCH_SQL}') THEN 'title' WHEN regexp_matches(context, '{FRENCH_SQL}') THEN 'context'
            WHEN regexp_matches(decision, '{FRENCH_SQL}') THEN 'decision' WHEN regexp_matches(rationale, '{FRENCH_SQL}') THEN 'rationale' END
            || '" looks non-English — the index must be English', '') AS warnings
    FROM ({FLAWED_SQL})"""


def _scope(spark, d):
    return decisions(spark, d).select("repo", "id", log.effective_scope(F.col("scope"), F.col("type")).alias("scope"))


SLUG_SQL = """coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', ''), ''), 'decision')"""


def _ids(spark, d):
    docs = decisions(spark, d)
    return docs.select("repo", "id", slugify(F.col("decision")).alias("slug"), make_id(F.col("domain"), F.col("date"), F.col("decision")).alias("made"))


def candidates(spark, d):
    """Candidate decisions: the benchmark's texts, each again under another title and once more cut to its first half, and
    copies of decisions on file, each of them twice."""
    queries = view(spark, d, "queries_v")
    none = lambda name: F.lit(None).cast("string").alias(name)

    def asked(mark: str, title: str, text) -> list:
        return [
            "repo", F.concat(F.lit(mark), "query_id").alias("query_id"), F.concat(F.lit(title), "query_id").alias("title"), F.lit("technical").alias("type"),
            none("status"), F.when(F.lit(mark == "h"), "halves").alias("domain"), none("date"), text.alias("decision"), none("supersedes"), F.array(F.lit("asked")).alias("tags"),
        ]

    half = F.substring("q", F.lit(1), (F.length("q") / 2).cast("int"))
    base = queries.select(asked("", "Adopt ", F.col("q"))).unionByName(queries.select(asked("g", "Adopt again ", F.col("q")))).unionByName(queries.select(asked("h", "Adopt half ", half)))
    for mark in "cd":
        copies = decisions(spark, d).where("doc_id % 37 = 0").select(
            "repo", F.concat(F.lit(mark), "doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("title")).alias("title"), "type",
            F.lit("active").alias("status"), "domain", none("date"), "decision", "supersedes", "tags",
        )
        base = base.unionByName(copies)
    return base


CANDIDATES_SQL = " UNION ALL ".join(
    [
        f"""SELECT repo, '{mark}' || query_id AS query_id, '{title}' || query_id AS title, 'technical' AS type, NULL AS status, {domain} AS domain, {text} AS decision, NULL AS supersedes, 'asked' AS tags
    FROM {sql_for("queries_v")}"""
        for mark, title, domain, text in (("", "Adopt ", "NULL", "q"), ("g", "Adopt again ", "NULL", "q"), ("h", "Adopt half ", "'halves'", "substr(q, 1, CAST(floor(length(q) / 2) AS INTEGER))"))
    ]
    + [
        f"""SELECT repo, '{mark}' || doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE title END, type, 'active', domain, decision, supersedes, lang || ' ' || source
    FROM {sql_for("decisions_v")} WHERE doc_id % 37 = 0"""
        for mark in "cd"
    ]
)


def overlap_sql(source: str, text: str, key: str = "query_id") -> str:
    """CTEs up to `top`: the best active decision of each row of the CTE `asked`."""
    return f"""
    dec AS ({DECISIONS_SQL}), dt AS ({terms_sql("dec", "repo, id, status, domain", HAYSTACK)}),
    qt AS ({terms_sql(source, f"repo, {key}", text)}),
    n AS (SELECT repo, count(*) AS n FROM dec GROUP BY repo),
    w AS (SELECT dt.repo, term, pow(ln(1 + any_value(n.n) / (count(*) + 0.5)), 2) AS w2 FROM dt JOIN n USING (repo) GROUP BY dt.repo, term),
    qw AS (SELECT qt.repo, {key}, term, coalesce(w2, pow(ln(1 + n.n / 0.5), 2)) AS w2 FROM qt JOIN n USING (repo) LEFT JOIN w USING (repo, term)),
    qself AS (SELECT repo, {key}, sum(w2) AS q_self FROM qw GROUP BY ALL),
    dself AS (SELECT dt.repo, id, sum(w2) AS d_self FROM dt JOIN w USING (repo, term) GROUP BY ALL),
    dots AS (SELECT qw.repo, {key}, id, sum(qw.w2) AS dot FROM qw JOIN dt USING (repo, term) WHERE {ACTIVE} GROUP BY ALL),
    scored AS (SELECT dots.repo, dots.{key}, dots.id, round(dot / least(q_self, d_self), 6) AS score
               FROM dots JOIN qself USING (repo, {key}) JOIN dself USING (repo, id)),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, {key} ORDER BY score DESC, id) AS rank FROM scored) WHERE rank = 1)"""


GATE_SQL = f"""
    asked AS ({CANDIDATES_SQL}), {overlap_sql("asked", "concat_ws(' ', title, decision, tags)")},
    gate AS (SELECT t.repo, t.query_id, t.id AS match, floor(t.score * 100 + 0.5) / 100 AS score,
                    floor(t.score * 100 + 0.5) / 100 >= 0.5 AND m.domain = coalesce(a.domain, 'general') AND coalesce(a.supersedes, '') = '' AS refused
             FROM top t JOIN dec m ON t.repo = m.repo AND t.id = m.id JOIN asked a ON a.repo = t.repo AND a.query_id = t.query_id)"""


def _gate(spark, d):
    ready = log.default_fields(candidates(spark, d), "2026-01-31")
    return log.dedup_gate(ready, decisions(spark, d))


def _record(spark, d):
    return log.record_decisions(candidates(spark, d), decisions(spark, d), "2026-01-31").select("repo", "query_id", "id", "status", "domain", "outcome", "match")


def _log_after(spark, d):
    """The log with the recorded candidates appended."""
    on_file = decisions(spark, d)
    judged = log.record_decisions(candidates(spark, d), on_file, "2026-01-31")
    return log.appended(on_file, judged).select("repo", "id", "title", "status")


def _defaults(spark, d):
    filled = log.default_fields(candidates(spark, d), "2026-01-31", "someone")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return filled.select("repo", "query_id", "id", "status", "domain", "date", joined("authors"), joined("tags"), joined("evidence"), F.size("alternatives").alias("alternatives"))


MADE_SQL = f"{SLUG_SQL.format('coalesce(domain, ' + chr(39) + 'general' + chr(39) + ')')} || '/2026-01-31-' || {SLUG_SQL.format('title')}"


#: Candidates one after the other: `kept` are the places of those recorded so far, which with the log (place 0) can be met.
RECORD_SQL = f"""
    WITH RECURSIVE {GATE_SQL},
    ready AS (SELECT *, coalesce(domain, 'general') AS dom, coalesce(status, 'active') AS stat, {MADE_SQL} AS id, title = '' OR trim(decision) = '' AS bad,
              row_number() OVER (PARTITION BY repo ORDER BY query_id) AS place FROM asked),
    ct AS ({terms_sql("ready", "repo, place", "concat_ws(' ', title, dom, type, tags, decision)")}),
    cw AS (SELECT ct.repo, place, term, coalesce(w2, pow(ln(1 + n.n / 0.5), 2)) AS w2 FROM ct JOIN n USING (repo) LEFT JOIN w USING (repo, term)),
    cself AS (SELECT repo, place, sum(w2) AS d_self FROM cw GROUP BY ALL),
    pairs AS (SELECT a.repo, a.place, b.place AS other, round(dot / least(q_self, d_self), 6) AS score FROM (
                SELECT q.repo, q.query_id, c.place AS other, sum(q.w2) AS dot FROM qw q JOIN cw c ON c.repo = q.repo AND c.term = q.term GROUP BY ALL) p
              JOIN ready a ON a.repo = p.repo AND a.query_id = p.query_id JOIN ready b ON b.repo = p.repo AND b.place = p.other AND b.place < a.place AND NOT b.bad
              JOIN qself s ON s.repo = p.repo AND s.query_id = p.query_id JOIN cself t ON t.repo = p.repo AND t.place = p.other),
    met AS (SELECT r.repo, r.place, 0 AS other, t.score, t.id, m.domain FROM ready r JOIN top t ON t.repo = r.repo AND t.query_id = r.query_id JOIN dec m ON m.repo = t.repo AND m.id = t.id
            UNION ALL SELECT p.repo, p.place, other, score, r.id, r.dom FROM pairs p JOIN ready r ON r.repo = p.repo AND r.place = p.other),
    edges AS (SELECT repo, place, list({{'other': other, 'score': score, 'id': id, 'domain': domain}} ORDER BY score DESC, id) AS edges FROM met GROUP BY ALL),
    c AS MATERIALIZED (SELECT r.repo, r.place, query_id, r.id, dom, stat, bad, coalesce(r.supersedes, '') <> '' AS replaces, coalesce(edges, []) AS edges, d.id IS NOT NULL AS there
          FROM ready r LEFT JOIN edges e ON e.repo = r.repo AND e.place = r.place LEFT JOIN dec d ON d.repo = r.repo AND d.id = r.id),
    steps AS (SELECT DISTINCT repo, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept, CAST([] AS VARCHAR[]) AS ids, '' AS query_id, '' AS outcome, '' AS match FROM ready
              UNION ALL
              SELECT repo, place, CASE WHEN outcome = 'recorded' THEN list_append(kept, place) ELSE kept END, CASE WHEN outcome = 'recorded' THEN list_append(ids, id) ELSE ids END, query_id, outcome, match
              FROM (SELECT *, CASE WHEN bad THEN NULL ELSE best.id END AS match, CASE WHEN bad THEN 'invalid'
                      WHEN NOT replaces AND coalesce(floor(best.score * 100 + 0.5) / 100 >= 0.5 AND best.domain = dom, FALSE) THEN 'duplicate'
                      WHEN there OR list_contains(ids, id) THEN 'exists' ELSE 'recorded' END AS outcome
                    FROM (SELECT c.*, s.kept, s.ids, list_filter(c.edges, lambda e: e.other = 0 OR list_contains(s.kept, e.other))[1] AS best
                          FROM steps s JOIN c ON c.repo = s.repo AND c.place = s.place + 1)))
    SELECT s.repo, s.query_id, c.id, c.stat AS status, c.dom AS domain, outcome, match FROM steps s JOIN c ON c.repo = s.repo AND c.place = s.place"""


def with_evidence(spark, d):
    """Decisions that cite a line of their own file, a gone file, a version and an issue; some hashes are wrong."""
    n = F.col("doc_id")
    ref = F.concat("path", F.lit(":2"))
    base = decisions(spark, d)
    line = content_hash(F.coalesce(F.get(F.split("decision", "\n", -1), F.lit(1)), F.lit("")))
    return base.select(
        "*",
        F.array_compact(F.array(ref, F.lit("v2.0"), F.lit("PR #245"), F.when(n % 25 == 0, "gone/away.ts:12"), F.when(n % 4 == 0, F.col("path")))).alias("evidence"),
        F.create_map(
            F.when(n % 3 == 0, F.col("path")).otherwise(ref),
            F.when(n % 10 == 0, "00000000").when(n % 3 == 0, content_hash(F.col("decision"))).otherwise(line),
        ).alias("evidence_hashes"),
    )


def _evidence(spark, d):
    return log.evidence_hashes(with_evidence(spark, d), view(spark, d, "files_v"))


def _conflicts(spark, d):
    return log.decision_conflicts(with_evidence(spark, d), view(spark, d, "files_v"))


LINE2_SQL = "coalesce(string_split(decision, chr(10))[2], '')"
HASH_SQL = "substr(sha1({0}), 1, 8)"
CONFLICTS_SQL = f"""
    WITH dec AS (SELECT * FROM {sql_for("decisions_v")}),
    refs AS (SELECT repo, id, supersedes AS ref, 'supersedes' AS field FROM dec WHERE {ACTIVE} AND supersedes IS NOT NULL
             UNION ALL SELECT repo, id, conflict, 'conflicts_with' FROM dec WHERE {ACTIVE} AND conflict IS NOT NULL),
    rel AS (SELECT r.repo, CASE WHEN t.id IS NULL THEN 'dangling' WHEN t.{ACTIVE} THEN
                   CASE field WHEN 'supersedes' THEN 'supersede-active' ELSE 'conflict' END END AS type, r.id, r.ref, field
            FROM refs r LEFT JOIN dec t ON r.repo = t.repo AND r.ref = t.id),
    rec AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN '00000000' WHEN doc_id % 3 = 0 THEN {HASH_SQL.format("decision")} ELSE {HASH_SQL.format(LINE2_SQL)} END AS h FROM dec),
    cites AS (SELECT *, path || ':2' AS ref, h AS recorded, CASE WHEN doc_id % 3 = 0 THEN {HASH_SQL.format("decision")} ELSE {HASH_SQL.format(LINE2_SQL)} END AS now FROM rec
              UNION ALL SELECT *, path AS ref, CASE WHEN doc_id % 3 = 0 THEN h END AS recorded, {HASH_SQL.format("decision")} AS now FROM rec WHERE doc_id % 4 = 0)
    SELECT repo, type, id, ref, CASE WHEN type = 'dangling' THEN field END AS field FROM rel WHERE type IS NOT NULL
    UNION ALL SELECT repo, 'evidence-missing', id, 'gone/away.ts', NULL FROM dec WHERE doc_id % 25 = 0
    UNION ALL SELECT repo, 'evidence-stale', id, ref, NULL FROM cites WHERE recorded <> now"""
EVIDENCE_SQL = f"""
    SELECT repo, id, path || ':2' AS ref, {HASH_SQL.format(LINE2_SQL)} AS hash FROM {sql_for("decisions_v")}
    UNION ALL SELECT repo, id, path, {HASH_SQL.format("decision")} FROM {sql_for("decisions_v")} WHERE doc_id % 4 = 0"""


def _generated(spark, d):
    return log.generated(view(spark, d, "orders").select(F.col("o_orderkey").alias("i")))


def _array_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


GENERATED_SQL = f"""
    WITH g AS (SELECT o_orderkey AS i, {_array_sql(log.GEN_DOMAINS)}[i % 10 + 1] AS domain, {_array_sql(log.TYPES)}[i % 4 + 1] AS type,
               {_array_sql(log.GEN_TOPICS)}[i % 17 + 1] AS topic, {_array_sql(log.GEN_TECH)}[i % 10 + 1] AS tech,
               (2024 + i % 3) || '-' || lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS date FROM orders),
    t AS (SELECT *, topic || ' for ' || domain || ' using ' || tech || ' #' || i AS title FROM g)
    SELECT {SLUG_SQL.format("domain")} || '/' || date || '-' || {SLUG_SQL.format("title")} AS id, title, type,
           CASE WHEN i % 11 = 0 THEN 'superseded' ELSE 'active' END AS status, domain, date,
           'Standardize ' || topic || ' on ' || tech || ' across ' || domain || '.' AS decision,
           'Consistency and operational simplicity for ' || topic || '.' AS rationale FROM t"""

CUE_SQL = "(?i)(^|[^A-Za-z0-9_])(from now on|by convention)([^A-Za-z0-9_]|$)"


def _harvest(spark, d):
    return log.harvest(view(spark, d, "messages_v"), decisions(spark, d))


LISTED_SQL = f"""SELECT *, {SCOPE_SQL} AS eff, CASE WHEN type IN ('architecture', 'convention') THEN 1 ELSE 0 END AS structuring
    FROM {sql_for("decisions_v")} WHERE {ACTIVE}"""

# --- ledger -------------------------------------------------------------------------------------------------------------


def ledger(spark, d):
    return cache.with_deps(view(spark, d, "ledger_v"), F.col("ctx"), F.col("h"))


def current_hashes(spark, d):
    """ctx0 to ctx7 of each repo; ctx8 is gone."""
    ctx = F.col("item_id") % 9
    rows = view(spark, d, "benchmark").select(F.concat(F.lit("r"), (F.col("item_id") % 3).cast("string")).alias("repo"), ctx.alias("n"))
    return rows.where("n < 8").distinct().select("repo", F.concat(F.lit("ctx"), "n").alias("ctx"), F.concat(F.lit("h"), "n").alias("h"))


LEDGER_SQL = f"""
    led AS (SELECT * FROM {sql_for("ledger_v")}), et AS ({terms_sql("led", "repo, entry, scope", "q")}),
    qs AS (SELECT * FROM {sql_for("queries_v")}), qt AS ({terms_sql("qs", "repo, query_id, scope", "q")}),
    ln AS (SELECT repo, count(*) AS n FROM led GROUP BY repo),
    df AS (SELECT repo, term, count(*) AS df FROM et GROUP BY ALL),
    ew AS (SELECT et.repo, entry, et.scope, term, pow(ln(1 + n / (df + 0.5)), 2) AS w2 FROM et JOIN df USING (repo, term) JOIN ln USING (repo)),
    lqw AS (SELECT qt.repo, query_id, qt.scope, term, pow(ln(1 + n / (coalesce(df, 0) + 0.5)), 2) AS w2 FROM qt JOIN ln USING (repo) LEFT JOIN df USING (repo, term)),
    lq AS (SELECT repo, query_id, sum(w2) AS q_self FROM lqw GROUP BY ALL), le AS (SELECT repo, entry, sum(w2) AS e_self FROM ew GROUP BY ALL),
    ld AS (SELECT lqw.repo, query_id, entry, sum(lqw.w2) AS dot FROM lqw JOIN ew USING (repo, term)
           WHERE lqw.scope IS NULL OR ew.scope IS NULL OR lqw.scope = ew.scope GROUP BY ALL),
    ls AS (SELECT ld.repo, ld.query_id, ld.entry, round(dot / least(q_self, e_self), 6) AS score FROM ld JOIN lq USING (repo, query_id) JOIN le USING (repo, entry)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, query_id ORDER BY score DESC, entry) AS place FROM ls) WHERE place = 1),
    verdicts AS (SELECT b.repo, query_id, b.entry, b.score, CASE WHEN b.score < 0.6 THEN 'weak' WHEN engine <> 'new' THEN 'engine'
                        WHEN ctx = 'ctx8' OR h = 'stale' THEN 'stale' ELSE 'fresh' END AS verdict, ctx, a
                 FROM best b JOIN led USING (repo, entry))"""


def _verdicts(spark, d):
    return cache.answer_lookup(view(spark, d, "queries_v"), ledger(spark, d), current_hashes(spark, d), "new")


def _append(spark, d):
    answers = view(spark, d, "ledger_v").select(
        "repo", "q", F.when(F.col("entry") % 6 == 0, " ").otherwise(F.col("a")).alias("a"), "scope", "engine",
        F.lit("2026-01-31T00:00:00Z").alias("ts"), F.array("ctx").alias("ctxs"),
    )
    out = cache.cache_answers(answers, current_hashes(spark, d))
    deps = F.array_join(F.transform("deps", lambda x: F.concat_ws("=", x["ctx"], x["h"])), ",")
    return out.select("repo", "q", "qn", "a", deps.alias("deps"), "scope", "engine", "hits", "outcome")


def _cached_recall(spark, d):
    """The ledger answers first; only queries without a fresh answer are recalled."""
    found = stored(_verdicts(spark, d))
    rest = view(spark, d, "queries_v").join(found.where("verdict = 'fresh'"), ["repo", "query_id"], "left_anti")
    return cache.cached_or(found, ledger(spark, d), postings.recall(rest, kept_index(spark, d)))


# --- changes ------------------------------------------------------------------------------------------------------------


def files(spark, d):
    return changes.with_hash(view(spark, d, "files_v"))


def manifest(spark, d):
    old = changes.with_hash(view(spark, d, "old_files_v"))
    return old.select("repo", "path", "hash", "parse_error", F.lit("E2").alias("engine_hash"), (F.substring("hash", 1, 1) != "0").alias("cached"))


MANIFEST_SQL = f"SELECT repo, path, {HASH_SQL.format('content')} AS hash, parse_error FROM {sql_for('old_files_v')}"
CLASSES_SQL = f"""
    now AS (SELECT repo, path, {HASH_SQL.format("content")} AS hash, content, ctx_id FROM {sql_for("files_v")}), old AS ({MANIFEST_SQL}),
    classes AS (SELECT coalesce(now.repo, old.repo) AS repo, coalesce(now.path, old.path) AS path, CASE WHEN now.hash IS NULL THEN 'gone'
                WHEN now.hash = old.hash AND parse_error IS NULL AND substr(old.hash, 1, 1) <> '0' THEN 'reused' ELSE 'parsed' END AS status
                FROM now FULL JOIN old ON now.repo = old.repo AND now.path = old.path)"""


def _classes(spark, d):
    return changes.classify_changes(files(spark, d), manifest(spark, d), "E2")


def _totals(spark, d):
    facts = view(spark, d, "old_files_v").select("repo", "path", "parse_error")
    return changes.change_totals(_classes(spark, d), facts)


def _incremental(spark, d):
    extract = lambda todo: todo.select("repo", "path", F.length("content").alias("n"), F.lit("new").alias("origin"))
    kept = view(spark, d, "old_files_v").select("repo", "path", F.length("content").alias("n"), F.lit("cache").alias("origin"))
    return changes.incremental_facts(files(spark, d), kept, _classes(spark, d), extract)


FINGERPRINT_SQL = f"""SELECT repo, ctx_id, count(*) AS file_count, {HASH_SQL.format("string_agg(h, '|' ORDER BY h)")} AS src_hash
    FROM (SELECT repo, ctx_id, {HASH_SQL.format("content")} AS h FROM {sql_for("files_v")}) GROUP BY ALL"""


def _drift(spark, d):
    now = changes.context_fingerprint(files(spark, d))
    old = changes.context_fingerprint(changes.with_hash(view(spark, d, "old_files_v").where("path NOT LIKE 'gone/%'")))
    return changes.functional_drift(now, old)


# --- logs and accounts --------------------------------------------------------------------------------------------------


def lines(spark, d):
    order = F.row_number().over(Window.partitionBy("log_id").orderBy("ts", "event_id")) - 1
    return view(spark, d, "log_v").select("log_id", order.alias("line_no"), "text")


PRUNE = {"head": 5, "tail": 5, "context": 1, "max_keep": 40}
PRUNE_SQL = f"""
    WITH l AS (SELECT log_id, text, row_number() OVER (PARTITION BY log_id ORDER BY ts, event_id) - 1 AS line_no FROM {sql_for("log_v")}),
    t AS (SELECT *, count(*) OVER (PARTITION BY log_id) AS total, text LIKE 'error %' AS diag FROM l),
    ends AS (SELECT log_id, line_no, total, diag, line_no < 5 OR line_no >= total - 5 AS ends FROM t),
    grp AS (SELECT DISTINCT d.log_id, d.line_no AS by_line, m.line_no, m.ends FROM ends d JOIN ends m ON d.log_id = m.log_id AND m.line_no BETWEEN d.line_no - 1 AND d.line_no + 1 WHERE d.diag),
    brought AS (SELECT log_id, line_no, min(by_line) AS by_line FROM grp WHERE NOT ends GROUP BY ALL),
    diags AS (SELECT DISTINCT log_id, by_line FROM grp),
    size AS (SELECT g.log_id, g.by_line, (SELECT count(*) FROM ends e WHERE e.log_id = g.log_id AND e.ends) + (SELECT count(*) FROM brought b WHERE b.log_id = g.log_id AND b.by_line <= g.by_line) AS n FROM diags g),
    stop AS (SELECT log_id, min(by_line) AS last FROM size WHERE n > 40 GROUP BY log_id),
    kept AS (SELECT e.log_id, e.line_no, e.total FROM ends e LEFT JOIN brought b ON e.log_id = b.log_id AND e.line_no = b.line_no LEFT JOIN stop s ON s.log_id = e.log_id
             WHERE total <= 20 OR ends OR (b.by_line IS NOT NULL AND (last IS NULL OR b.by_line <= last)))"""


def _prune(spark, d):
    return logs.prune_logs(lines(spark, d), **PRUNE)


def _tokens(spark, d):
    return view(spark, d, "files_v").select("repo", "path", tokens(F.col("content")).alias("tokens"))


def _raw_tokens(spark, d):
    wanted = view(spark, d, "old_files_v").select("repo", F.col("ctx_id").alias("key"), "path")
    return logs.raw_tokens(wanted, view(spark, d, "files_v"))


def _gains(spark, d):
    rows = view(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("time"), F.col("event_type").alias("op"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("plugin"),
        F.concat("event_type", F.lit("|"), "props", F.lit("|"), F.repeat("event_type", 12)).alias("detail"),
        F.floor("value").cast("long").alias("used"), (F.col("event_id") % 90).alias("baseline"),
    )
    return logs.gain_rows(rows)


GAINS_SQL = """
    WITH e AS (SELECT *, CAST(floor(value) AS BIGINT) AS used, event_id % 90 AS baseline FROM events)
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'p' || (user_id % 5) AS plugin, event_type AS op,
           substr(replace(event_type || '|' || props || '|' || repeat(event_type, 12), '|', '\\|'), 1, 80) AS detail, used, baseline, baseline - used AS saved,
           CASE WHEN baseline > 0 THEN CAST(floor((baseline - used) * 100 / baseline + 0.5) AS BIGINT) ELSE 0 END AS pct FROM e"""


def _recall_scale(spark, d):
    """Per repo: tokens of all decisions, mean tokens of a query's cards, and the factor between them."""
    docs = decisions(spark, d)
    corpus = docs.groupBy("repo").agg(F.count("*").alias("n"), F.sum(tokens(F.col("decision"))).alias("corpus"))
    hits = postings.recall(view(spark, d, "queries_v"), kept_index(spark, d))
    cards = hits.join(docs.select("repo", "id", tokens(F.col("decision")).alias("t")), ["repo", "id"])
    payload = cards.groupBy("repo", "query_id").agg(F.sum("t").alias("t")).groupBy("repo").agg(F.avg("t").alias("payload"))
    joined = corpus.join(payload, "repo")
    return joined.select("repo", "n", "corpus", F.round("payload", 4).alias("payload"), F.floor(F.col("corpus") / F.col("payload") + 0.5).alias("factor"))


TOKENS_SQL = "CAST(floor(octet_length(encode({0})) / 4 + 0.5) AS BIGINT)"

QUERIES = {
    "decision_errors": _errors,
    "decision_scope": _scope,
    "decision_ids": _ids,
    "decision_defaults": _defaults,
    "decision_dedup": _gate,
    "decision_record_outcomes": _record,
    "decision_log_after": _log_after,
    "evidence_hash_rows": _evidence,
    "decision_conflicts": _conflicts,
    "constitution": lambda s, d: log.constitution(decisions(s, d)),
    "domain_cards": lambda s, d: log.domain_cards(decisions(s, d), 5),
    "decision_catalog": lambda s, d: log.catalog(decisions(s, d)),
    "decision_counts": lambda s, d: log.decision_counts(decisions(s, d)),
    "generated_decisions": _generated,
    "cue_messages": lambda s, d: log.cue_messages(view(s, d, "messages_v")).select("repo", "msg_id"),
    "harvest_status": _harvest,
    "ledger_verdicts": _verdicts,
    "ledger_append": _append,
    "ledger_gc": lambda s, d: cache.ledger_gc(view(s, d, "ledger_v"), "new").select("repo", "entry", "kept"),
    "ledger_stats": lambda s, d: cache.ledger_stats(view(s, d, "ledger_v")),
    "cached_recall": _cached_recall,
    "content_hashes": lambda s, d: files(s, d).select("repo", "path", "hash"),
    "change_classes": _classes,
    "change_totals": _totals,
    "incremental_union": _incremental,
    "context_fingerprints": lambda s, d: changes.context_fingerprint(files(s, d)),
    "functional_drift": _drift,
    "prune_lines": _prune,
    "prune_totals": lambda s, d: logs.prune_totals(lines(s, d), **PRUNE),
    "tokens": _tokens,
    "raw_tokens": _raw_tokens,
    "gain_rows": _gains,
    "economy_report": lambda s, d: logs.economy_report(view(s, d, "costs_v")),
    "query_factors": lambda s, d: logs.query_factors(view(s, d, "costs_v")),
    "tier_report": lambda s, d: logs.tier_report(view(s, d, "costs_v")),
    "recall_scale": _recall_scale,
    "even_sample": lambda s, d: logs.even_sample(view(s, d, "costs_v"), 50, "route", "query"),
}

ORACLE = {
    "decision_errors": ERRORS_SQL,
    "decision_scope": f"SELECT repo, id, {SCOPE_SQL} AS scope FROM {sql_for('decisions_v')}",
    "decision_ids": f"""SELECT repo, id, {SLUG_SQL.format("decision")} AS slug, {SLUG_SQL.format("domain")} || '/' || date || '-' || {SLUG_SQL.format("decision")} AS made
        FROM {sql_for("decisions_v")}""",
    "decision_defaults": f"""SELECT repo, query_id, {MADE_SQL} AS id, coalesce(status, 'active') AS status, coalesce(domain, 'general') AS domain, '2026-01-31' AS date,
        'someone' AS authors, replace(tags, ' ', ',') AS tags, '' AS evidence, 0 AS alternatives FROM ({CANDIDATES_SQL})""",
    "decision_dedup": f"WITH {GATE_SQL} SELECT * FROM gate",
    "decision_record_outcomes": RECORD_SQL,
    "decision_log_after": f"""SELECT repo, id, title, status FROM {sql_for("decisions_v")}
        UNION ALL SELECT r.repo, r.id, title, r.status FROM ({RECORD_SQL}) r JOIN ({CANDIDATES_SQL}) c ON c.repo = r.repo AND c.query_id = r.query_id WHERE outcome = 'recorded'""",
    "evidence_hash_rows": EVIDENCE_SQL,
    "decision_conflicts": CONFLICTS_SQL,
    "constitution": f"""SELECT repo, place, id, type, title, greatest(n - 30, 0) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY structuring DESC, date DESC, id) AS place, count(*) OVER (PARTITION BY repo) AS n
        FROM ({LISTED_SQL}) WHERE eff = 'global') WHERE place <= 30""",
    "domain_cards": f"""SELECT repo, domain, place, id, type, eff AS scope, title, n AS active, total, greatest(n - 5, 0) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY repo, domain ORDER BY structuring DESC, date DESC, id) AS place, count(*) OVER (PARTITION BY repo, domain) AS n
        FROM ({LISTED_SQL})) JOIN (SELECT repo, domain, count(*) AS total FROM {sql_for("decisions_v")} GROUP BY ALL) USING (repo, domain) WHERE place <= 5""",
    "decision_catalog": f"SELECT repo, id, status || ' ' || type || ' ' || {SCOPE_SQL} || ' — ' || title AS line FROM {sql_for('decisions_v')}",
    "decision_counts": f"""SELECT repo, domain, type, status, count(*) AS count, count(*) FILTER ({ACTIVE}) AS active FROM {sql_for("decisions_v")}
        GROUP BY GROUPING SETS ((repo, domain), (repo, type), (repo, status))""",
    "generated_decisions": GENERATED_SQL,
    "cue_messages": f"SELECT repo, msg_id FROM {sql_for('messages_v')} WHERE regexp_matches(text, '{CUE_SQL}')",
    "harvest_status": f"""WITH asked AS (SELECT * FROM {sql_for("messages_v")} WHERE regexp_matches(text, '{CUE_SQL}')), {overlap_sql("asked", "text", "msg_id")}
        SELECT a.repo, a.msg_id, t.id AS match, t.score, CASE WHEN t.score >= 0.6 THEN 'covered' WHEN t.score >= 0.3 THEN 'supersedes-candidate' ELSE 'new' END AS status
        FROM asked a LEFT JOIN top t ON a.repo = t.repo AND a.msg_id = t.msg_id""",
    "ledger_verdicts": f"WITH {LEDGER_SQL} SELECT repo, query_id, entry, score, verdict, CASE WHEN verdict = 'stale' THEN ctx END AS stale_ctx FROM verdicts",
    "ledger_append": f"""WITH led AS (SELECT * FROM {sql_for("ledger_v")}), et AS ({terms_sql("led", "repo, entry", "q")}),
        qn AS (SELECT repo, entry, string_agg(term, ' ' ORDER BY term) AS qn FROM et GROUP BY ALL),
        cur AS (SELECT DISTINCT repo, ctx, replace(ctx, 'ctx', 'h') AS now FROM led WHERE ctx <> 'ctx8')
        SELECT repo, q, coalesce(qn, '') AS qn, CASE WHEN entry % 6 = 0 THEN ' ' ELSE a END AS a, concat_ws('=', ctx, now) AS deps, scope, engine, 0 AS hits,
               CASE WHEN entry % 6 = 0 THEN 'empty' WHEN now IS NULL THEN 'unknown-context' ELSE 'cached' END AS outcome
        FROM led LEFT JOIN qn USING (repo, entry) LEFT JOIN cur USING (repo, ctx)""",
    "ledger_gc": f"SELECT repo, entry, coalesce(engine = 'new', TRUE) AS kept FROM {sql_for('ledger_v')}",
    "ledger_stats": f"SELECT repo, count(*) AS entries, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits FROM {sql_for('ledger_v')} GROUP BY repo",
    "content_hashes": f"SELECT repo, path, {HASH_SQL.format('content')} AS hash FROM {sql_for('files_v')}",
    "change_classes": f"WITH {CLASSES_SQL} SELECT * FROM classes",
    "change_totals": f"""WITH {CLASSES_SQL} SELECT repo, count(*) FILTER (status <> 'gone') AS total, count(*) FILTER (status = 'parsed') AS parsed,
        count(*) FILTER (status = 'reused') AS reused, count(*) FILTER (status = 'gone') AS gone,
        (SELECT count(*) FROM old WHERE old.repo = classes.repo AND parse_error IS NOT NULL) AS errors FROM classes GROUP BY repo""",
    "incremental_union": f"""WITH {CLASSES_SQL} SELECT now.repo, now.path, length(content) AS n, CASE status WHEN 'parsed' THEN 'new' ELSE 'cache' END AS origin
        FROM now JOIN classes ON now.repo = classes.repo AND now.path = classes.path""",
    "context_fingerprints": FINGERPRINT_SQL,
    "functional_drift": f"""WITH now AS ({FINGERPRINT_SQL}), old AS ({FINGERPRINT_SQL.replace(sql_for("files_v"), f"(SELECT * FROM {sql_for('old_files_v')} WHERE path NOT LIKE 'gone/%')")})
        SELECT now.repo, now.ctx_id, now.file_count, now.src_hash, coalesce(old.src_hash <> now.src_hash, FALSE) AS functional_stale
        FROM now LEFT JOIN old USING (repo, ctx_id)""",
    "prune_lines": PRUNE_SQL + """ SELECT k.log_id, k.line_no, k.total, count(*) OVER (PARTITION BY k.log_id) AS kept,
        k.line_no - coalesce(lag(k.line_no) OVER (PARTITION BY k.log_id ORDER BY k.line_no), -1) - 1 AS elided_before,
        CASE WHEN lead(k.line_no) OVER (PARTITION BY k.log_id ORDER BY k.line_no) IS NULL THEN k.total - 1 - k.line_no ELSE 0 END AS elided_after, l.text
        FROM kept k JOIN l ON k.log_id = l.log_id AND k.line_no = l.line_no""",
    "prune_totals": PRUNE_SQL + " SELECT log_id, max(total) AS total, count(*) AS kept, max(total) - count(*) AS elided FROM kept GROUP BY log_id",
    "tokens": f"SELECT repo, path, {TOKENS_SQL.format('content')} AS tokens FROM {sql_for('files_v')}",
    "raw_tokens": f"""WITH wanted AS (SELECT DISTINCT repo, ctx_id AS key, path FROM {sql_for("old_files_v")})
        SELECT w.repo, key, CAST(floor(coalesce(sum(octet_length(encode(content))), 0) / 4 + 0.5) AS BIGINT) AS tokens
        FROM wanted w LEFT JOIN {sql_for("files_v")} f ON w.repo = f.repo AND w.path = f.path GROUP BY w.repo, key""",
    "gain_rows": GAINS_SQL,
    "economy_report": f"""WITH s AS (SELECT route, count(*) AS queries, count(*) FILTER (used <= raw) AS wins, CAST(sum(used) AS BIGINT) AS used, CAST(sum(raw) AS BIGINT) AS raw
            FROM {sql_for("costs_v")} GROUP BY route),
        p AS (SELECT *, CAST(floor(wins * 100 / queries + 0.5) AS BIGINT) AS win_pct, CASE WHEN raw > 0 THEN CAST(floor((1 - used / raw) * 100 + 0.5) AS BIGINT) ELSE 0 END AS saved_pct FROM s)
        SELECT *, win_pct >= 70 AND saved_pct >= 70 AS passed FROM p""",
    "query_factors": f"""SELECT query, route, used, raw, CASE WHEN used > 0 AND raw > 0 THEN CAST(CAST(floor(raw / used + 0.5) AS BIGINT) AS VARCHAR) ELSE '—' END AS factor,
        CASE WHEN used <= raw THEN 'index' ELSE 'raw' END AS winner FROM {sql_for("costs_v")}""",
    "tier_report": f"""WITH s AS (SELECT route, CAST(coalesce(sum(used) FILTER (structural), 0) AS BIGINT) AS used_structural, CAST(coalesce(sum(raw) FILTER (structural), 0) AS BIGINT) AS raw_structural,
            CAST(sum(used) AS BIGINT) AS used, CAST(sum(raw + 10600) AS BIGINT) AS agent FROM {sql_for("costs_v")} GROUP BY route)
        SELECT *, CAST(floor(used_structural * 100 / raw_structural + 0.5) AS BIGINT) AS inline_pct, CAST(floor(used * 100 / agent + 0.5) AS BIGINT) AS agent_pct FROM s""",
    "even_sample": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY query) - 1 AS place, count(*) OVER (PARTITION BY route) AS size FROM {sql_for("costs_v")}),
        wanted AS (SELECT DISTINCT route, CAST(floor(i * size / 50) AS BIGINT) AS place FROM (SELECT DISTINCT route, size FROM n), range(50) r(i))
        SELECT query, route, used, raw, structural, place FROM n WHERE size <= 50 OR (route, place) IN (SELECT (route, place) FROM wanted)""",
}

ORACLE["cached_recall"] = scores_sql(ACTIVE) + "," + RANKED_SQL + "," + LEDGER_SQL.replace(
    f"qs AS (SELECT * FROM {sql_for('queries_v')}), qt AS ({terms_sql('qs', 'repo, query_id, scope', 'q')}),",
    f"lqt AS ({terms_sql('qs', 'repo, query_id, scope', 'q')}),",
).replace("FROM qt JOIN ln", "FROM lqt AS qt JOIN ln") + """
    SELECT repo, query_id, 'cache' AS origin, a AS answer, NULL AS id, NULL AS score, NULL AS rank FROM verdicts WHERE verdict = 'fresh'
    UNION ALL SELECT repo, query_id, 'index', NULL, id, score, rank FROM hits WHERE (repo, query_id) NOT IN (SELECT (repo, query_id) FROM verdicts WHERE verdict = 'fresh')"""
ORACLE["recall_scale"] = scores_sql(ACTIVE) + "," + RANKED_SQL + f""",
    c AS (SELECT repo, count(*) AS n, CAST(sum({TOKENS_SQL.format("decision")}) AS BIGINT) AS corpus FROM dec GROUP BY repo),
    p AS (SELECT repo, avg(t) AS payload FROM (SELECT h.repo, query_id, sum({TOKENS_SQL.format("decision")}) AS t FROM hits h JOIN dec USING (repo, id) GROUP BY ALL) GROUP BY repo)
    SELECT repo, n, corpus, round(payload, 4) AS payload, CAST(floor(corpus / payload + 0.5) AS BIGINT) AS factor FROM c JOIN p USING (repo)"""
