"""The best match of each question against the scores of all pairs, and that pairs are never written."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from corpusindex.operators import decisions as log
from corpusindex.operators import nearest, postings, retrieval

WORDS = [f"w{i}" for i in range(60)]


def made(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, weights=[60 / (k + 1) for k in range(60)], k=rng.randint(1, 12))
        rows.append((rng.choice(["a", "a", "a", "b"]), f"d{i}", " ".join(["all", *words]), rng.choice(["x", "y"]), rng.choice(["active", "proposed", "superseded"])))
    return spark.createDataFrame(rows, "repo string, id string, title string, domain string, status string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("type", "decision", "rationale", "context")], *[F.array().cast("array<string>").alias(c) for c in ("tags", "consequences")]
    )


@pytest.mark.parametrize("kept", [False, True])
def test_best_matches_are_those_of_all_pairs(spark, tmp_path, kept):
    held, asked = made(spark, 150, 1), made(spark, 80, 2)
    active = F.col("status").isin("active", "proposed")
    questions = asked.select("repo", F.col("id").alias("query_id"), log.question_terms(asked).alias("terms"))
    pairs = retrieval.overlap_scores(questions, retrieval.decision_index(held, active))
    best = pairs.groupBy("repo", "query_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "id")).alias("b")).select("repo", "query_id", "b.id", -F.col("b.low"))
    expected = sorted(map(tuple, best.collect()))
    texts = nearest.held_index(postings.refresh_index(spark, held, f"{tmp_path}/index", 2), held, active) if kept else nearest.held_decisions(held, active)
    listed = nearest.questions(retrieval.weighed_terms(questions, texts))
    for slice_terms in (100, 1 << 22):
        found = nearest.best_matches(listed, texts.texts.where("live"), texts.weights, slice_terms)
        assert sorted(map(tuple, found.select("repo", "query_id", "id", "score").collect())) == expected


def test_no_pair_is_written(spark, monkeypatch):
    held, asked = made(spark, 300, 3), made(spark, 200, 4).withColumnRenamed("id", "query_id").withColumn("date", F.lit("2026-01-01"))
    written = []
    for module in [m for n, m in sys.modules.items() if n.startswith("corpusindex.") and hasattr(m, "stored")]:

        def counted(df, own=module.stored):
            out = own(df)
            written.append(out.count())
            return out

        monkeypatch.setattr(module, "stored", counted)
    assert log.dedup_gate(asked, held).count() == 200
    assert max(written) < 5000  # terms of texts and questions; there are some 20 000 pairs
    written.clear()
    ready = log.validate(log.default_fields(asked.withColumn("decision", F.col("title")).withColumn("supersedes", F.lit("x")).withColumn("type", F.lit("technical")), "2026-01-01"))
    judged = log.admission(ready, held)
    assert judged.where("outcome = 'recorded'").count() > 150 and max(written) < 5000
    written.clear()
    messages = asked.select("repo", F.col("query_id").alias("msg_id"), F.concat(F.lit("from now on "), "title").alias("text"))
    assert log.harvest(messages, held).where("match IS NOT NULL").count() == 200 and max(written) < 5000
