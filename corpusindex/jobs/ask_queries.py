"""Answers from the code index: payloads, facts and details of the contexts that a question shows, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.jobs import java_queries as jq
from corpusindex.jobs.retrieval_queries import RANKED_SQL
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import java, retrieval


def _tables(spark, d):
    base = jq.facts(spark, d)
    endpoints = java.java_endpoints(java.types_of(base))
    words = endpoints.groupBy("repo", "ctx_id").agg(F.array_join(F.array_sort(F.collect_set("controller")), " ").alias("controllers"))
    contexts = java.java_contexts(base).join(words, ["repo", "ctx_id"], "left")
    contexts = contexts.select("repo", F.col("ctx_id").alias("id"), F.concat_ws(" ", "ctx_id", "controllers").alias("hay"))
    hits = retrieval.adaptive_top(retrieval.ask(view(spark, d, "queries_v"), contexts))
    return hits, endpoints


def _payload(spark, d):
    hits, endpoints = _tables(spark, d)
    calls = endpoints.select("repo", F.col("ctx_id").alias("id"), F.concat_ws(" ", "verb", "path").alias("text"))
    rules = endpoints.where("verb = 'PUT'").select("repo", F.col("ctx_id").alias("id"), F.concat(F.lit("only "), "controller", F.lit(" writes")).alias("text"))
    return retrieval.ask_payload(hits, calls, rules)


def _facts(spark, d):
    hits, endpoints = _tables(spark, d)
    return hits.select("repo", "query_id", "id").join(retrieval.signature_lines(endpoints), ["repo", "id"])


def _detail(spark, d):
    """Details of wanted contexts, every tenth of them unknown."""
    part = view(spark, d, "functional_v")
    number = F.regexp_extract("ctx_id", "/([0-9]+)$", 1).cast("long")
    wanted = part.select("repo", F.when(number % 10 == 3, F.concat("ctx_id", F.lit("?"))).otherwise(F.col("ctx_id")).alias("ctx_id"))
    return retrieval.lookup_detail(wanted, part.select("repo", "ctx_id", "purpose", "src_hash"), "repo", "ctx_id")


HITS_SQL = f"""{jq.WITH},
    ctx AS (SELECT c.repo, c.ctx_id AS id, concat_ws(' ', c.ctx_id, (SELECT string_agg(DISTINCT controller, ' ' ORDER BY controller) FROM ep WHERE ep.repo = c.repo AND ep.ctx_id = c.ctx_id)) AS hay FROM ctxs c),
    words AS (SELECT repo, query_id, unnest(string_split_regex(lower(q), '\\s+')) AS word FROM {sql_for("queries_v")}),
    scored AS (SELECT w.repo, query_id, id, CAST(count(*) AS DOUBLE) AS score FROM words w JOIN ctx c ON w.repo = c.repo AND contains(lower(hay), word) WHERE word <> '' GROUP BY ALL),
    {RANKED_SQL}"""

QUERIES = {"ask_payload_endpoints": _payload, "ask_facts": _facts, "detail_lookup": _detail}

ORACLE = {
    "ask_payload_endpoints": f"""{HITS_SQL}
        SELECT h.repo, query_id, id, rank, 'endpoint' AS kind, verb || ' ' || path AS text FROM hits h JOIN ep ON ep.repo = h.repo AND ep.ctx_id = h.id
        UNION ALL SELECT h.repo, query_id, id, rank, 'rule', 'only ' || controller || ' writes' FROM hits h JOIN ep ON ep.repo = h.repo AND ep.ctx_id = h.id WHERE rank = 1 AND verb = 'PUT'""",
    "ask_facts": f"""{HITS_SQL}
        SELECT h.repo, query_id, id, verb || ' ' || path || coalesce(' <- ' || req, '') || coalesce(' -> ' || resp, '') AS text FROM hits h JOIN ep ON ep.repo = h.repo AND ep.ctx_id = h.id""",
    "detail_lookup": f"""WITH f AS (SELECT *, CAST(regexp_extract(ctx_id, '/([0-9]+)$', 1) AS BIGINT) % 10 = 3 AS lost FROM {sql_for("functional_v")})
        SELECT repo, CASE WHEN lost THEN ctx_id || '?' ELSE ctx_id END AS ctx_id, CASE WHEN NOT lost THEN purpose END AS purpose, CASE WHEN NOT lost THEN src_hash END AS src_hash, NOT lost AS found FROM f""",
}
