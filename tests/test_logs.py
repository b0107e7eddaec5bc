"""Pruned logs against a plain version, one log far larger than a range among them."""

import random
import re

from corpusindex.operators import logs


def plain(lines, head, tail, context, max_keep):
    total = len(lines)
    if total <= head + tail + 10:
        return list(range(total))
    keep = set(range(min(head, total))) | set(range(max(0, total - tail), total))
    for i, text in enumerate(lines):
        if text is not None and re.search("error", text):
            keep |= set(range(max(0, i - context), min(total - 1, i + context) + 1))
            if len(keep) > max_keep:
                break
    return sorted(keep)


def test_pruned_logs_are_the_plain_ones(spark):
    rng = random.Random(4)
    texts = {f"log{i}": [rng.choice(["error x", None, *["fine"] * rng.choice([1, 9, 60])]) for _ in range(rng.choice([0, 3, 17, 25, 80, 400]))] for i in range(40)}
    texts["giant"] = ["error" if rng.random() < 0.02 else "fine" for _ in range(20_000)]
    texts["all"] = ["error"] * 3000
    rows = [(log, n, text) for log, held in texts.items() for n, text in enumerate(held)]
    frame = spark.createDataFrame(rows, "log_id string, line_no int, text string").repartition(5)
    for head, tail, context, most in ((5, 5, 1, 40), (5, 5, 2, 300), (20, 20, 0, 30), (0, 3, 1, 4000)):
        found = logs.prune_logs(frame, head, tail, context, most, "error", range_lines=64).collect()
        got: dict = {}
        for r in sorted(found, key=lambda r: (r["log_id"], r["line_no"])):
            got.setdefault(r["log_id"], []).append(r)
        for log, held in texts.items():
            expected = plain(held, head, tail, context, most)
            mine = got.get(log, [])
            assert [r["line_no"] for r in mine] == expected, (log, head, tail, context, most)
            assert all(r["text"] == held[r["line_no"]] and r["kept"] == len(expected) and r["total"] == len(held) for r in mine)
            assert sum(r["elided_before"] + r["elided_after"] for r in mine) == (len(held) - len(expected) if expected else 0)
