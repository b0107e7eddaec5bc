"""Log pruning and token accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.functions.text import half_up, whole_word
from corpusindex.sources.store import stored

# Words that mark a diagnostic line.
DIAGNOSTIC = "(?i)" + whole_word("errors?|failed|failure|fail|failing|fails|exception|traceback|panic|fatal|assert|assertion|warn|warning")


def prune_logs(
    lines: DataFrame, head: int = 20, tail: int = 20, context: int = 1, max_keep: int = 4000, pattern: str = DIAGNOSTIC, range_lines: int = 100_000
) -> DataFrame:
    """(log_id, line_no, text, elided_before, elided_after, total, kept) of the lines kept; `line_no` counts from 0.

    A log of at most head + tail + 10 lines stays whole. Else the first `head` and last `tail` lines stay, and each
    diagnostic line with `context` lines around it, up to the first whose group makes more than `max_keep` lines stay.
    `elided_before` counts the lines left out right before a line, `elided_after` those after the log's last kept one.

    A log is no group of a task. Diagnostic lines bring in their neighbours by number; how many lines the diagnostics bring
    in is added up by ranges of `range_lines` lines, and line by line only in the range where `max_keep` is passed. What is
    kept of a log, some `max_keep` lines, is the most that is ordered together. Texts are joined to the lines kept.
    """
    sizes = stored(lines.groupBy("log_id").agg(F.count("*").alias("total")))
    marked = lines.where(F.col("text").rlike(pattern)).select("log_id", F.col("line_no").cast("long").alias("by_line"))
    marked = stored(marked.join(sizes, "log_id").where(F.col("total") > head + tail + 10))
    around = F.sequence(F.greatest(F.col("by_line") - context, F.lit(0)), F.least(F.col("by_line") + context, F.col("total") - 1))
    near = marked.select("log_id", "total", "by_line", F.explode(around).alias("line_no"))
    # the first diagnostic line that brings a line in: from it on, the line stays
    near = stored(near.groupBy("log_id", "line_no", "total").agg(F.min("by_line").alias("entered")))
    in_ends = (F.col("line_no") < head) | (F.col("line_no") >= F.col("total") - tail)
    room = F.lit(max_keep) - F.least(F.col("total"), F.lit(head + tail))  # beside the ends
    brought = near.where(~in_ends).groupBy("log_id", "total", "entered").agg(F.count("*").alias("n"))
    brought = brought.withColumn("range", F.call_function("div", F.col("entered"), F.lit(range_lines)))
    by_range = brought.groupBy("log_id", "total", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("log_id").orderBy("range"))
    passed = by_range.withColumn("before", upto - F.col("n")).where(F.col("before") + F.col("n") > room)
    passed = passed.groupBy("log_id").agg(F.min(F.struct("range", "before")).alias("at")).select("log_id", "at.*")
    within = F.sum("n").over(Window.partitionBy("log_id", "range").orderBy("entered"))
    over = brought.join(passed, ["log_id", "range"]).withColumn("so_far", F.col("before") + within).where(F.col("so_far") > room)
    over = over.groupBy("log_id").agg(F.min("entered").alias("over"))
    # with more than max_keep in the ends alone, the first diagnostic line is the last that is looked at
    last = marked.groupBy("log_id", "total").agg(F.min("by_line").alias("first")).join(over, "log_id", "left")
    last = last.select("log_id", F.when(room < 0, F.col("first")).otherwise(F.col("over")).alias("last"))
    shown = near.join(last, "log_id").where(F.col("last").isNull() | (F.col("entered") <= F.col("last"))).select("log_id", "line_no", "total")
    count = lambda start, stop: F.when(stop > start, F.sequence(start.cast("long"), (stop - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total, none = F.col("total"), F.lit(0)
    ends = F.concat(count(none, F.least(total, F.lit(head))), count(F.greatest(total - tail, none), total))
    ends = F.when(total <= head + tail + 10, count(none, total)).otherwise(ends)
    kept = shown.unionByName(sizes.select("log_id", F.explode(ends).alias("line_no"), "total")).distinct()
    order = Window.partitionBy("log_id").orderBy("line_no")
    kept = kept.select(
        "log_id", "line_no", "total", F.count("*").over(Window.partitionBy("log_id")).alias("kept"),
        (F.col("line_no") - F.coalesce(F.lag("line_no").over(order), F.lit(-1)) - 1).alias("elided_before"),
        F.when(F.lead("line_no").over(order).isNull(), F.col("total") - 1 - F.col("line_no")).otherwise(0).alias("elided_after"),
    )
    return kept.join(lines.select("log_id", F.col("line_no").cast("long").alias("line_no"), "text"), ["log_id", "line_no"])


def prune_totals(lines: DataFrame, **options) -> DataFrame:
    """(log_id, total, kept, elided)."""
    kept = prune_logs(lines, **options)
    out = kept.groupBy("log_id").agg(F.max("total").alias("total"), F.count("*").alias("kept"))
    return out.withColumn("elided", F.col("total") - F.col("kept"))


def split_lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, text) of whole logs; a closing line break gives an empty last line."""
    return logs.select("log_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def raw_tokens(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(key, tokens): a quarter of the bytes of the files behind each key; files that are missing count nothing."""
    sizes = files.select("repo", "path", F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes"))
    found = wanted.distinct().join(sizes, ["repo", "path"], "left")
    return found.groupBy("repo", "key").agg(half_up(F.coalesce(F.sum("bytes"), F.lit(0)) / 4).alias("tokens"))


def gain_rows(operations: DataFrame) -> DataFrame:
    """(time, plugin, op, detail, used, baseline, saved, pct) of operations with time as an ISO string."""
    saved = F.col("baseline") - F.col("used")
    pct = F.when(F.col("baseline") > 0, half_up(saved * 100 / F.col("baseline"))).otherwise(0).cast("long")
    detail = F.substring(F.replace(F.coalesce("detail", F.lit("")), F.lit("|"), F.lit("\\|")), 1, 80)
    time = F.substring(F.replace("time", F.lit("T"), F.lit(" ")), 1, 19)
    return operations.select(time.alias("time"), "plugin", "op", detail.alias("detail"), "used", "baseline", saved.alias("saved"), pct.alias("pct"))


def economy_report(costs: DataFrame, least: int = 70) -> DataFrame:
    """Per route: wins (a tie is one), their share, sums, the share saved, and whether both reach `least` percent."""
    win = F.col("used") <= F.col("raw")
    sums = costs.groupBy("route").agg(
        F.count("*").alias("queries"), F.count_if(win).alias("wins"), F.sum("used").alias("used"), F.sum("raw").alias("raw")
    )
    win_pct = half_up(F.col("wins") * 100 / F.col("queries"))
    saved_pct = F.when(F.col("raw") > 0, half_up((1 - F.col("used") / F.col("raw")) * 100)).otherwise(0).cast("long")
    out = sums.withColumn("win_pct", win_pct).withColumn("saved_pct", saved_pct)
    return out.withColumn("passed", (F.col("win_pct") >= least) & (F.col("saved_pct") >= least))


def query_factors(costs: DataFrame) -> DataFrame:
    """Each query's factor raw / used, a dash where either is 0, and the winner."""
    factor = F.when((F.col("used") > 0) & (F.col("raw") > 0), F.format_string("%d", half_up(F.col("raw") / F.col("used")))).otherwise("—")
    return costs.select("query", "route", "used", "raw", factor.alias("factor"), F.when(F.col("used") <= F.col("raw"), "index").otherwise("raw").alias("winner"))


def tier_report(costs: DataFrame, overhead: int = 10600) -> DataFrame:
    """Per route: used over raw on structural questions, and used over a sub-agent's tokens (raw and a fixed overhead)."""
    structural = F.col("structural")
    out = costs.groupBy("route").agg(
        F.sum(F.when(structural, F.col("used")).otherwise(0)).alias("used_structural"),
        F.sum(F.when(structural, F.col("raw")).otherwise(0)).alias("raw_structural"),
        F.sum("used").alias("used"),
        F.sum(F.col("raw") + overhead).alias("agent"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, half_up(F.col(a) * 100 / F.col(b))).otherwise(0).cast("long")
    return out.withColumn("inline_pct", share("used_structural", "raw_structural")).withColumn("agent_pct", share("used", "agent"))


def even_sample(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """`n` rows of each group, evenly spread in its order; all where there are no more.

    Rows are sorted over all tasks by range, numbered within a range and moved on by the counts of the ranges before, so
    that no group has to be sorted in one task.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(rows.repartitionByRange(ranges, group, order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "part").agg(F.count("*").alias("held"))
    by = Window.partitionBy(group)
    before = F.sum("held").over(by.orderBy("part")) - F.col("held")
    counts = counts.select(group, "part", before.alias("before"), F.sum("held").over(by).alias("size"))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(order))
    numbered = ranged.withColumn("within", within).join(counts, [group, "part"])
    numbered = numbered.withColumn("place", F.col("before") + F.col("within") - 1)
    # place is floor(i * size / n) for the smallest i with i * size >= place * n
    i = F.ceil(F.col("place") * n / F.col("size"))
    hit = (i < n) & (F.floor(i * F.col("size") / n) == F.col("place"))
    return numbered.where((F.col("size") <= n) | hit).select(*rows.columns, "place")
