"""Running digests of sorted groups against those of gathered ones."""

from pyspark.sql import functions as F

from corpusindex.functions.text import content_hash
from corpusindex.operators.digests import group_digest


def test_group_digest_is_that_of_the_gathered_lines(spark):
    rows = [(k, s, f"{(i * 7919) % 100}é" if i % 9 else None) for i, (k, s) in enumerate([("a", 1), ("a", 2), (None, 1), ("b", None)] * 30)] + [("one", 1, None)]
    frame = spark.createDataFrame(rows, "k string, s int, line string")
    gathered = frame.groupBy("k", "s").agg(F.count("*").alias("n"), content_hash(F.array_join(F.array_sort(F.collect_list(F.coalesce("line", F.lit("")))), "|")).alias("digest"))
    found = group_digest(frame.repartition(5), ["k", "s"], F.col("line"), "|")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, gathered.collect()), key=str)
    assert group_digest(frame.where("false"), ["k"], F.col("line"), "|").count() == 0
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_group_of_many_rows_fits_a_small_task(spark):
    import hashlib

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        rows = spark.range(200_000).select(F.lit("g").alias("g"), F.lpad(F.col("id").cast("string"), 8, "0").alias("line"))
        found = group_digest(rows.repartition(8), ["g"], F.col("line"), "\n").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert [tuple(r) for r in found] == [("g", 200_000, hashlib.sha1("\n".join(f"{i:08}" for i in range(200_000)).encode()).hexdigest()[:8])]
