"""Recall and ask over the test views, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.functions.text import STOP_WORDS, normalize_terms, normalized_query
from corpusindex.jobs.views import sql_for, view
from corpusindex.operators import postings, retrieval
from corpusindex.sources.store import shared_folder


def decisions(spark, d):
    """decisions_v with the optional fields as arrays."""
    base = view(spark, d, "decisions_v")
    return base.select(
        "*",
        F.array("lang", "source").alias("tags"),
        F.array(F.concat(F.lit("Applies to "), "lang")).alias("consequences"),
        F.when(F.col("conflict").isNotNull(), F.array("conflict")).alias("conflicts_with"),
    )


_FOLDERS: dict[tuple[str, str], str] = {}


def kept_index(spark, d):
    """The decisions' index in a folder of this application's; brought up to date, so that only changes are read again."""
    path = _FOLDERS.setdefault((spark.sparkContext.applicationId, d), shared_folder(spark))
    return postings.refresh_index(spark, decisions(spark, d), path)


DECISIONS_SQL = f"""SELECT *, lang || ' ' || source AS tags, 'Applies to ' || lang AS consequences FROM {sql_for("decisions_v")}"""
STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(source: str, keys: str, text: str) -> str:
    """(keys, term, place): DuckDB's distinct stemmed terms of `text`, numbered by first place."""
    return f"""
    SELECT {keys}, t AS term, min(place) AS place FROM (
      SELECT {keys}, place, CASE
          WHEN w LIKE '%ies' AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y'
          WHEN w LIKE '%ses' AND length(w) > 4 THEN substr(w, 1, length(w) - 2)
          WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) ELSE w END AS t
      FROM (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS place
            FROM (SELECT {keys}, string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') AS ws FROM {source}))
      WHERE length(w) > 1 AND w NOT IN ({STOP_SQL}))
    GROUP BY ALL"""


HAYSTACK = "concat_ws(' ', title, domain, type, tags, decision, rationale, context, consequences)"


def scores_sql(keep: str = "TRUE") -> str:
    """CTEs up to `scored` (repo, query_id, id, score)."""
    return f"""
    WITH dec AS ({DECISIONS_SQL}),
    dt AS ({terms_sql("dec", "repo, id, status, domain", HAYSTACK)}),
    qs AS (SELECT * FROM {sql_for("queries_v")}),
    qt AS ({terms_sql("qs", "repo, query_id", "q")}),
    n AS (SELECT repo, count(*) AS n FROM dec GROUP BY repo),
    w AS (SELECT dt.repo, term, pow(ln(1 + any_value(n.n) / (count(*) + 0.5)), 2) AS w2 FROM dt JOIN n USING (repo) GROUP BY dt.repo, term),
    qw AS (SELECT qt.repo, query_id, term, coalesce(w2, pow(ln(1 + n.n / 0.5), 2)) AS w2
           FROM qt JOIN n USING (repo) LEFT JOIN w USING (repo, term)),
    qself AS (SELECT repo, query_id, sum(w2) AS q_self FROM qw GROUP BY ALL),
    dself AS (SELECT dt.repo, id, sum(w2) AS d_self FROM dt JOIN w USING (repo, term) GROUP BY ALL),
    dots AS (SELECT qw.repo, query_id, id, sum(qw.w2) AS dot FROM qw JOIN dt USING (repo, term) WHERE {keep} GROUP BY ALL),
    scored AS (SELECT dots.repo, dots.query_id, dots.id, round(dot / least(q_self, d_self), 6) AS score
               FROM dots JOIN qself USING (repo, query_id) JOIN dself USING (repo, id))"""


RANKED_SQL = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, query_id ORDER BY score DESC, id) AS rank,
                      count(*) OVER (PARTITION BY repo, query_id) AS matched FROM scored),
    tops AS (SELECT repo, query_id, max(score) FILTER (rank = 1) AS s1, coalesce(max(score) FILTER (rank = 2), 0) AS s2 FROM ranked GROUP BY ALL),
    shown AS (SELECT r.repo, r.query_id, r.id, r.score, r.rank, r.matched, least(CASE WHEN s1 >= 2 * s2 THEN 1 ELSE 3 END, r.matched) AS shown
              FROM ranked r JOIN tops USING (repo, query_id)),
    hits AS (SELECT * FROM shown WHERE rank <= shown)"""

ACTIVE = "status IN ('active', 'proposed')"


def _recall(spark, d, **options):
    return postings.recall(view(spark, d, "queries_v"), kept_index(spark, d), **options)


def _candidates(spark, d):
    """How many decisions share a term with each question, and the places shown."""
    hits = _recall(spark, d)
    return hits.groupBy("repo", "query_id").agg(F.max("matched").alias("matched"), F.max("rank").alias("places"))


def _delta(spark, d):
    """Recall after a refresh by changed, gone and new decisions, and after compaction: rows of both."""
    base, path = decisions(spark, d), shared_folder(spark)
    before = base.where("doc_id % 5 <> 1").withColumn("decision", F.when(F.col("doc_id") % 4 == 0, F.concat("decision", F.lit(" earlier"))).otherwise(F.col("decision")))
    extra = base.where("doc_id % 9 = 2").withColumn("id", F.concat(F.lit("old/"), "id"))
    postings.refresh_index(spark, before.unionByName(extra), path)
    queries = view(spark, d, "queries_v")
    refreshed = postings.recall(queries, postings.refresh_index(spark, base, path))
    compacted = postings.recall(queries, postings.compact_index(spark, path))
    return refreshed.withColumn("after", F.lit("refresh")).unionByName(compacted.withColumn("after", F.lit("compaction")))


def _terms(spark, d):
    terms = normalize_terms(F.col("q"))
    return view(spark, d, "queries_v").select("repo", "query_id", F.array_join(terms, " ").alias("terms"), normalized_query(terms).alias("qn"))


def _idf(spark, d):
    table = retrieval.idf_table(retrieval.decision_terms(decisions(spark, d)).select("repo", "id", "terms"))
    return table.select("repo", "term", "df", F.round("idf", 6).alias("idf"))


def _df(spark, d):
    return retrieval.document_frequency(retrieval.postings(retrieval.decision_terms(decisions(spark, d))))


def _cards(spark, d):
    cards = retrieval.cards(_recall(spark, d), decisions(spark, d))
    return cards.withColumn("tags", F.array_join("tags", " ")).withColumn("consequences", F.array_join("consequences", " "))


def _unmatched(spark, d):
    queries = view(spark, d, "queries_v")
    hits = _recall(spark, d, domain="src7")
    return retrieval.unmatched(queries, hits).select("repo", "query_id", "q")


def contexts(spark, d):
    """functional_v as contexts with a haystack."""
    hay = F.concat_ws(" ", "ctx_id", "purpose", "cap1", "cap2")
    return view(spark, d, "functional_v").select("repo", F.col("ctx_id").alias("id"), "module", "purpose", hay.alias("hay"))


CONTEXTS_SQL = f"SELECT repo, ctx_id AS id, module, purpose, concat_ws(' ', ctx_id, purpose, cap1, cap2) AS hay FROM {sql_for('functional_v')}"
ASK_SQL = f"""
    WITH ctx AS ({CONTEXTS_SQL}),
    words AS (SELECT repo, query_id, unnest(string_split_regex(lower(q), '\\s+')) AS word FROM {sql_for("queries_v")}),
    scored AS (SELECT w.repo, query_id, id, CAST(count(*) AS DOUBLE) AS score FROM words w JOIN ctx c ON w.repo = c.repo AND contains(lower(hay), word)
               WHERE word <> '' GROUP BY ALL)"""


def _ask(spark, d):
    return retrieval.adaptive_top(retrieval.ask(view(spark, d, "queries_v"), contexts(spark, d)))


def _ask_fallback(spark, d):
    queries = view(spark, d, "queries_v")
    brief = F.lit("see the brief")
    shown = retrieval.adaptive_top(retrieval.ask(queries, contexts(spark, d))).select("repo", "query_id", "id")
    lost = retrieval.unmatched(queries, shown).select("repo", "query_id", brief.alias("id"))
    return shown.unionByName(lost)


QUERIES = {
    "normalize_terms": _terms,
    "postings_df": _df,
    "idf_table": _idf,
    "recall_top": lambda s, d: _recall(s, d),
    "recall_domain": lambda s, d: _recall(s, d, domain="src7"),
    "recall_all_statuses": lambda s, d: _recall(s, d, statuses=None),
    "recall_cards": _cards,
    "recall_after_delta": _delta,
    "recall_counts": _candidates,
    "recall_unmatched": _unmatched,
    "ask_scores": _ask,
    "ask_fallback": _ask_fallback,
}

ORACLE = {
    "normalize_terms": f"""
        WITH qs AS (SELECT * FROM {sql_for("queries_v")}), qt AS ({terms_sql("qs", "repo, query_id", "q")})
        SELECT qs.repo, qs.query_id, coalesce(string_agg(term, ' ' ORDER BY place), '') AS terms, coalesce(string_agg(term, ' ' ORDER BY term), '') AS qn
        FROM qs LEFT JOIN qt USING (repo, query_id) GROUP BY ALL""",
    "postings_df": f"""
        WITH dec AS ({DECISIONS_SQL}), dt AS ({terms_sql("dec", "repo, id", HAYSTACK)})
        SELECT repo, term, count(*) AS df FROM dt GROUP BY ALL""",
    "idf_table": f"""
        WITH dec AS ({DECISIONS_SQL}), dt AS ({terms_sql("dec", "repo, id", HAYSTACK)}),
        n AS (SELECT repo, count(*) AS n FROM dec GROUP BY repo)
        SELECT dt.repo, term, count(*) AS df, round(ln(1 + any_value(n) / (count(*) + 0.5)), 6) AS idf FROM dt JOIN n USING (repo) GROUP BY dt.repo, term""",
    "recall_top": scores_sql(ACTIVE) + "," + RANKED_SQL + " SELECT * FROM hits",
    "recall_domain": scores_sql(ACTIVE + " AND domain = 'src7'") + "," + RANKED_SQL + " SELECT * FROM hits",
    "recall_all_statuses": scores_sql() + "," + RANKED_SQL + " SELECT * FROM hits",
    "recall_after_delta": scores_sql(ACTIVE) + "," + RANKED_SQL + " SELECT hits.*, after FROM hits, (VALUES ('refresh'), ('compaction')) v(after)",
    "recall_counts": scores_sql(ACTIVE) + "," + RANKED_SQL + " SELECT repo, query_id, max(matched) AS matched, max(rank) AS places FROM hits GROUP BY ALL",
    "recall_cards": scores_sql(ACTIVE) + "," + RANKED_SQL + """
        SELECT h.repo, query_id, rank, matched, shown, h.id, floor(score * 100 + 0.5) / 100 AS score, type, status, domain, title, decision, tags,
               CASE WHEN rank = 1 THEN date END AS date, CASE WHEN rank = 1 THEN context END AS context,
               CASE WHEN rank = 1 THEN rationale END AS rationale, CASE WHEN rank = 1 THEN consequences END AS consequences,
               CASE WHEN rank = 1 THEN supersedes END AS supersedes
        FROM hits h JOIN dec USING (repo, id)""",
    "recall_unmatched": scores_sql(ACTIVE + " AND domain = 'src7'") + """
        SELECT repo, query_id, q FROM qs WHERE (repo, query_id) NOT IN (SELECT (repo, query_id) FROM scored)""",
    "ask_scores": ASK_SQL + "," + RANKED_SQL + " SELECT * FROM hits",
    "ask_fallback": ASK_SQL + "," + RANKED_SQL + f"""
        SELECT repo, query_id, id FROM hits UNION ALL
        SELECT repo, query_id, 'see the brief' FROM {sql_for("queries_v")} WHERE (repo, query_id) NOT IN (SELECT (repo, query_id) FROM scored)""",
}
