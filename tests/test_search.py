"""Words within texts, however long the texts and many the words."""

import random
import time

from pyspark.sql import functions as F

from corpusindex.operators import retrieval


def tables(spark, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé日 ", k=rng.randint(1, 4)))
    texts = [(rng.choice(["r1", "r1", "r2", "r3"]), rng.choice(["", None, "".join(rng.choices("abcdé日 ", k=rng.randint(1, 300)))]), i % 50, "keep") for i in range(200)]
    words = [(rng.choice(["r1", "r2", "r4", None]), rng.choice([word(), word(), word(), "", None])) for _ in range(150)]
    frame = spark.createDataFrame(texts, "repo string, hay string, id int, word string")
    return texts, words, frame, spark.createDataFrame(words, "repo string, word string")


def test_words_sent_and_words_dealt_give_the_plain_rows(spark):
    texts, words, frame, asked = tables(spark)
    expected = sorted((r, i, w) for r, hay, i, _ in texts for w in {w for q, w in words if q == r} if w is not None and hay is not None and w in hay)
    frame = frame.drop("word")
    found = {
        "sent": retrieval.containing(frame, asked, "id"),
        "dealt": retrieval.containing(frame, asked, "id", sent=0),
        "cut": retrieval.containing(frame, asked, "id", sent=0, slice_words=7, block_bytes=2000),
    }
    for name, df in found.items():
        assert sorted(tuple(r) for r in df.collect()) == expected, name
    assert retrieval.containing(frame.where(F.lit(False)), asked, "id").count() == 0
    assert retrieval.containing(frame, asked.where(F.lit(False)), "id", sent=0).count() == 0


def test_texts_do_not_move_for_few_words_and_once_for_many(spark):
    _, _, frame, asked = tables(spark)
    frame = frame.drop("word")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(retrieval.containing(frame, asked, "id"))
    met = retrieval.containing(frame, asked, "id", sent=0)
    # before the words are looked for, one row a text and one a word and block: counted below the Python node
    moved = met._jdf.queryExecution().optimizedPlan().children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, moved).count()
    assert rows <= frame.count() + asked.distinct().count() * 1


def test_a_long_line_costs_one_pass(spark):
    rng = random.Random(2)
    line = "".join(rng.choices("abcdefghij ", k=100_000))
    texts = spark.createDataFrame([("r", line, 1)], "repo string, hay string, id int")
    words = spark.createDataFrame([("r", line[i : i + rng.randint(5, 9)]) for i in range(0, 60_000, 20)] + [("r", f"not{i}") for i in range(3000)], "repo string, word string")
    retrieval.containing(texts, words.limit(1), "id").count()
    began = time.time()
    assert retrieval.containing(texts, words, "id").count() == words.where("NOT startswith(word, 'not')").distinct().count()
    assert time.time() - began < 15
