"""Admission of batches against a plain sequence of single admissions, and the log after them."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusindex.functions.text import STOP_WORDS
from corpusindex.operators import decisions as log

ACTIVE = ("active", "proposed")


def terms(*texts):
    out = []
    for w in re.split("[^a-z0-9]+", " ".join(t for t in texts if t).lower()):
        if len(w) < 2 or w in STOP_WORDS:
            continue
        if w.endswith("ies") and len(w) > 4:
            w = w[:-3] + "y"
        elif w.endswith("ses") and len(w) > 4:
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
            w = w[:-1]
        out.append(w)
    return set(out)


def haystack(d):
    return terms(d["title"], d["domain"], d["type"], *(d.get("tags") or []), d["decision"], d.get("rationale"), d.get("context"), *(d.get("consequences") or []))


def plain_admission(candidates, on_file, today, force=False):
    """{(repo, query_id): (outcome, match)} and the log, one candidate at a time; terms weigh as in the log at the start."""
    out, logs = {}, {}
    for repo in {d["repo"] for d in [*candidates, *on_file]}:
        now = {d["id"]: d for d in on_file if d["repo"] == repo}
        df = Counter(t for d in now.values() for t in haystack(d))
        n = max(1, len(now))
        w2 = lambda t: math.log(1 + n / (df[t] + 0.5)) ** 2  # noqa: B023, E731
        for c in sorted((c for c in candidates if c["repo"] == repo), key=lambda c: (c["place"], c["query_id"])):
            c = c | {"status": c["status"] or "active", "domain": c["domain"] or "general", "date": today}
            slug = lambda t: re.sub("-+$", "", re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", (t or "").lower()))[:60]) or "decision"
            c["id"] = f"{slug(c['domain'])}/{today}-{slug(c['title'])}"
            if not (c["title"] or "").strip() or not (c["decision"] or "").strip():
                out[repo, c["query_id"]] = ("invalid", None)
                continue
            asked = terms(c["title"], c["decision"], *(c["tags"] or []))
            scored = []
            for d in now.values():
                have = haystack(d)
                if d["status"] in ACTIVE and asked & have:
                    dot = sum(w2(t) for t in asked & have)
                    scored.append((-round(dot / min(sum(map(w2, asked)), sum(map(w2, have))), 6), d["id"]))
            top = min(scored, default=None)
            forced = force or bool(c["force"])
            if top and not forced and not c["supersedes"] and math.floor(-top[0] * 100 + 0.5) / 100 >= 0.5 and now[top[1]]["domain"] == c["domain"]:
                outcome = "duplicate"
            elif c["id"] in now and not forced:
                outcome = "exists"
            else:
                outcome, now[c["id"]] = "recorded", c
            out[repo, c["query_id"]] = (outcome, top and top[1])
        logs[repo] = {i: d["decision"] for i, d in now.items()}
    return out, logs


WORDS = "cache retry token schema kafka redis audit limit page error queue worker index shard lease quota".split()


def batch(n, seed):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    rows, held = [], []
    for i in range(n):
        kind = rng.random()
        if held and kind < 0.25:  # the same again
            new = dict(rng.choice(held))
        elif held and kind < 0.6:  # a link of a chain: some words changed
            new = dict(rng.choice(held))
            words = new["decision"].split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            new |= {"decision": " ".join(words), "title": rng.choice([new["title"], text(2)])}
        else:
            new = {"title": text(2), "decision": text(rng.randint(1, 9)), "domain": rng.choice(["a", "b", None]), "tags": rng.choice([None, [], ["edge"], [text(1)]])}
        new |= {"repo": rng.choice(["r1", "r1", "r1", "r2", "empty"]), "query_id": f"q{i:03}", "place": rng.randint(0, n)}
        new |= {"type": "technical", "status": rng.choice([None, None, "superseded", "proposed"]), "supersedes": rng.choice([None, None, None, "x"]), "force": rng.choice([None, None, False, True])}
        if i % 19 == 7:
            new |= {"title": " "}
        rows.append(new)
        held.append(new)
    return rows


def on_file(n, seed):
    rows = batch(n, seed)
    out = {}
    for i, r in enumerate(rows):
        if r["repo"] != "empty" and r["title"].strip():
            d = {k: r[k] for k in ("repo", "title", "decision", "tags", "type")} | {"domain": r["domain"] or "general", "status": r["status"] or "active"}
            d["id"] = f"{d['domain']}/2026-01-01-{re.sub('[^a-z0-9]+', '-', d['title'])}" if i % 3 else f"{d['domain']}/2025-{i}"
            out[d["repo"], d["id"]] = d
    return list(out.values())


CANDIDATE = "repo string, query_id string, place int, title string, decision string, domain string, tags array<string>, type string, status string, supersedes string, force boolean"
ON_FILE = "repo string, id string, title string, domain string, type string, status string, tags array<string>, decision string, rationale string, context string, consequences array<string>"


def rows_of(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_a_batch_is_admitted_as_one_candidate_after_the_other(spark):
    candidates, held = batch(90, 5), on_file(40, 6)
    expected, logs = plain_admission(candidates, held, "2026-01-01")
    ready = log.validate(log.default_fields(rows_of(spark, candidates, CANDIDATE).repartition(3), "2026-01-01"))
    decisions = rows_of(spark, held, ON_FILE)
    judged = ready.join(log.admission(ready, decisions, first=4), ["repo", "query_id"]).cache()
    found = {(r["repo"], r["query_id"]): (r["outcome"], r["match"]) for r in judged.collect()}
    assert found == expected
    kinds = Counter(o for o, _ in found.values())
    assert min(kinds[k] for k in ("recorded", "duplicate", "exists", "invalid")) >= 2, kinds
    after = {}
    for r in log.appended(decisions, judged).collect():
        after.setdefault(r["repo"], {})[r["id"]] = r["decision"]
    assert after == logs


def test_equal_candidates_give_one_record_with_its_evidence(spark):
    rows = [{"repo": "a", "query_id": q, "place": 1, "title": "Cache policy", "decision": "cache all pages", "type": "technical", "domain": "a"} for q in ("q1", "q2")]
    base = rows_of(spark, rows, CANDIDATE).withColumn("evidence", F.array(F.lit("src/a.py:2"), F.lit("PR #1")))
    files = spark.createDataFrame([("a", "src/a.py", "one\ntwo")], "repo string, path string, content string")
    none = rows_of(spark, [], ON_FILE)
    found = {r["query_id"]: r for r in log.record_decisions(base, none, "2026-01-01", "me", files).collect()}
    assert found["q1"]["outcome"] == "recorded" and found["q2"]["outcome"] == "duplicate" and found["q2"]["match"] == "a/2026-01-01-cache-policy"
    assert found["q1"]["evidence_hashes"] == {"src/a.py:2": "ad782ecd"} and found["q1"]["authors"] == ["me"] and found["q1"]["conflicts_with"] == []
    forced = {r["query_id"]: r["outcome"] for r in log.record_decisions(base, none, "2026-01-01", force=True).collect()}
    assert forced == {"q1": "recorded", "q2": "recorded"}
    other = rows_of(spark, [rows[0] | {"tags": ["quota"], "title": "Z", "decision": "zz"}], CANDIDATE)
    held = rows_of(spark, [{"repo": "a", "id": "a/1", "title": "quota", "domain": "a", "type": "technical", "status": "active", "decision": "quota"}], ON_FILE)
    assert log.record_decisions(other, held, "2026-01-01").first()["match"] == "a/1"  # met by its tag alone
