"""Vector codes, dataset manifest and URL filter against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusindex.llm import codes, merkle, urls

# --- vector codes -------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{(vec_id, vector): (code, error, label error)} and the codebooks, by plain loops."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    whole = [[math.floor(x * 1024) if abs(x) < 2**50 else int(x) * 1024 for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    step = width // parts
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(whole[k], p) for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((dist(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in whole]
    for _ in range(rounds):
        groups = defaultdict(list)
        for v, got in zip(whole, assign()):
            for p, (_, e) in enumerate(got):
                groups[p, e].append(cut(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, labels = [], Counter()
    for (i, v, lab), got in zip(kept, assign() if kept else []):
        error = sum(d for d, _ in got)
        labels[lab] += error
        out.append((i, "".join(f"{e:02x}" for _, e in got), error, lab))
    return [(i, c, e, labels[lab]) for i, c, e, lab in out], books


def vectors_frame(spark, rows):
    data = [(i, v, lab, "x", "y") for i, v, lab in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, code string, part string").repartition(3)


def vector_rows(n, width, seed, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0, None] + [0.0] * (width - 2), 1), (n + 3, [math.nan] * width, 2), (n + 4, [math.inf] * width, 2)]
    rows += [(n + 5, rows[0][1], 1), (n + 6, rows[0][1], 1), (0, rows[1][1], 2), (None, rows[2][1], None)]
    return rows


@pytest.mark.parametrize("n, width, scale", [(400, 8, 1.0), (30, 4, 1.0), (300, 6, 0.001), (40, 8, 1e12)])
def test_codes_are_those_of_plain_loops(spark, n, width, scale):
    rows = vector_rows(n, width, n, scale)
    found = codes.vector_codes(vectors_frame(spark, rows)).collect()
    expected, books = plain_codes(rows)
    fits = lambda e: e if e is not None and e < 1 << 63 else None
    assert Counter((r.vec_id, r.code, r.error) for r in found) == Counter((i, c, fits(e)) for i, c, e, _ in expected)
    if scale < 1e6:
        assert Counter((r.vec_id, r.label_error) for r in found) == Counter((i, s) for i, _, _, s in expected)
    assert {r.codebooks_sha256 for r in found} == {codes.codebooks_digest(books)}


def test_codes_of_vectors_of_unlike_length_and_of_none(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [5.0] * 5, None), (4, [-0.5], 2)]
    found = codes.vector_codes(vectors_frame(spark, rows)).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in found} == set(plain_codes(rows)[0])
    assert codes.vector_codes(vectors_frame(spark, [])).count() == 0
    assert codes.vector_codes(vectors_frame(spark, [(1, None, 1), (None, [math.nan], 2)])).count() == 0


def test_search_scans_few_entries_and_misses_none(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    book = np.floor(rng.normal(0, 4000, (256, 4)))
    rows = np.floor(book[rng.integers(0, 256, 2000)] + rng.normal(0, 40, (2000, 4)))
    every = codes.squared(rows, book)
    start = every.argmin(1)
    scanned = []
    whole = codes.squared
    monkeypatch.setattr(codes, "squared", lambda a, b: scanned.append(len(a) * len(b)) or whole(a, b))
    around = codes.neighbours(book)
    scanned.clear()
    best, least = codes.nearest(rows, start, book, around)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert sum(scanned) < 0.1 * every.size
    best, _ = codes.nearest(rows, np.zeros(2000, int), book, around)  # a bad start costs time, not results
    assert (best == every.argmin(1)).all()


# --- manifest -----------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs, k=2):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: digest(*[field(d[c]) for c in merkle.FIELDS])

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + k]) for i in range(0, len(levels[-1]), k)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            start = i - i % k
            run = level[start : start + k]
            out.append((run[: i - start], run[i - start + 1 :]))
            i //= k
        return out

    langs = defaultdict(list)
    for d in docs:
        langs[d["lang"]].append(d)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        langs[x].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
    trees = {x: tree([leaf(d) for d in langs[x]]) for x in names}
    last = tree([trees[x][-1][0] for x in names])
    out = []
    for place, x in enumerate(names):
        for i, d in enumerate(langs[x]):
            steps = path(trees[x], i) + path(last, place)
            chosen = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0 and d["n_chars"] is not None
            h = leaf(d | {"n_chars": d["n_chars"] + 1} if chosen else d)
            for left, right in steps:
                h = digest(*left, h, *right)
            proof = digest(*[s for left, right in steps for s in left + right])
            out.append((d["doc_id"], leaf(d), trees[x][-1][0], last[-1][0], proof, h, h == last[-1][0]))
    return out


def document_rows(n, langs, seed=1):
    rng = random.Random(seed)
    docs = [
        {"doc_id": i, "text": rng.choice([None, "", "é日", "word " * rng.randint(1, 9)]), "lang": rng.choice(langs), "source": rng.choice(["a", "", None]), "n_chars": rng.choice([None, 0, i])}
        for i in range(n)
    ]
    copy = {"doc_id": 3, "text": "same", "lang": langs[0], "source": "s", "n_chars": 4}
    return docs + [dict(copy), dict(copy), copy | {"doc_id": None}, copy | {"doc_id": None, "text": "x" * 100_000}]


@pytest.mark.parametrize("n, langs, arity, block", [(150, ["en", None, "", "ß", "zz"], 2, 4), (90, ["en"], 3, 9), (40, [f"l{i}" for i in range(40)], 2, 1024), (300, ["en", "de"], 5, 25)])
def test_manifest_is_that_of_plain_trees(spark, monkeypatch, n, langs, arity, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = document_rows(n, langs)
    schema = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, leaf string, path string"
    frame = spark.createDataFrame([{**d, "tree": "t", "idx": 1, "leaf": "l", "path": "p"} for d in docs], schema).repartition(3)
    found = merkle.dataset_manifest(frame, arity).collect()
    assert Counter(tuple(r) for r in found) == Counter(plain_manifest(docs, arity))
    assert not all(r.verified for r in found)


def test_manifest_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.dataset_manifest(empty).collect() == []


# --- URL filter ---------------------------------------------------------------------------------------------------------


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def plain_rule(host, path):
    fit = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def plain_ranks(seeds, links, steps):
    out = Counter()
    for (src, _), w in links.items():
        out[src] += w
    rank, wave = Counter(seeds), Counter(seeds)
    for _ in range(steps):
        step = Counter()
        for (src, dst), w in links.items():
            step[dst] += wave[src] * urls.FOLLOWED // (out[src] * 20) * w
        wave = step
        rank.update(wave)
    return rank


def made_pages(n, seed=2):
    rng = random.Random(seed)
    hosts = [f"{a}.{b}.{t}" for a in "abcdef" for b in ("x", "example") for t in ("org", "com", "net")] + ["ORG", "Ünder.com", "example.org"]
    rows = []
    for i in range(n):
        host = "hub.big.net" if i % 3 == 0 else rng.choice(hosts)
        url = rng.choice([f"https://{host.upper() if i % 5 == 0 else host}{p}" for p in ("/fr/1", "/de/2", "/es/", "/en/12", "", "?q=/fr/", "/es#x", "/a?b#c")])
        url = {1: None, 2: "no host", 3: "a://b://c/d", 4: "://x"}.get(i % 40, url)
        linked = hosts if "hub" in (url or "") else rng.sample(hosts, rng.randint(0, 2))
        html = None if i % 31 == 0 else "<a>".join(f"<A  id=1\nhref = {rng.choice(['\"', ''])}{rng.choice(['HTTP://', '//', '/', ''])}{h}/z>" for h in linked)
        rows.append((i // 2, url, html, "clash", "clash", "clash"))
    return rows


def test_urls_are_judged_as_by_plain_loops(spark, monkeypatch):
    import re

    monkeypatch.setattr(urls, "SPLIT", 0.02)  # so that hosts are split
    rows = made_pages(400)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, src string").repartition(3)
    links, seeds, judged = Counter(), {"allow": Counter(), "block": Counter()}, []
    for page, url, html, *_ in rows:
        host, path = plain_split(url)
        rule = plain_rule(host, path)
        judged.append((page, host, path, rule))
        if rule and host:
            seeds[rule[0]][host] += urls.UNIT
        found = {m.translate(str.maketrans(urls.UPPER, urls.LOWER)) for m in re.findall(urls.LINK, html or "")}
        links.update({(host, dst): 1 for dst in found if host and dst and dst != host})
    trust = plain_ranks(seeds["allow"], links, urls.STEPS)
    distrust = plain_ranks(seeds["block"], {(b, a): w for (a, b), w in links.items()}, urls.STEPS)
    verdict = lambda host, rule: rule[0] if rule else "block" if distrust[host] > trust[host] else "allow"
    expected = Counter((page, host, path, rule and rule[1] + rule[2], verdict(host, rule)) for page, host, path, rule in judged)
    result = urls.filter_urls(frame)
    assert Counter(tuple(r) for r in result.collect()) == expected
    unruled = {v for (_, _, _, rule, v) in expected if rule is None}
    assert unruled == {"allow", "block"} and len(links) > 40
    assert "Python" not in result._jdf.queryExecution().executedPlan().toString()


def test_urls_of_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(empty).collect() == []


def test_rank_follows_links(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "a", 2)], "src string, dst string, w long")
    seeds = spark.createDataFrame([("a", 1000), ("z", 5)], "host string, rank long")
    found = {r.host: r["rank"] for r in urls.spread_rank(seeds, links, 2).collect()}
    assert found == {"a": 1000 + 180, "b": 212, "c": 636, "z": 5}
    assert urls.spread_rank(seeds, links.where(F.lit(False))).count() == 2
