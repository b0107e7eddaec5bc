"""Jaccard join, near vectors, top inner products, sentence spans, components: against brute force, with edge cases."""

import math
import random
import re
from fractions import Fraction

import numpy as np

from corpusindex.llm import jaccard, spans, topk, vectors
from corpusindex.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, owner string, label string, size int, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "o", "l", 1, "z") for i, t in rows], DOCS)


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randint(-50, 400), draw.randint(-50, 400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6300)]
    given = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long").repartition(5)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(given).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(given.where("a > 10000000")).count() == 0


def plain_sets(rows, size=5):
    out = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    return out


def plain_links(rows):
    sets = plain_sets(rows)
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links[i].append(j)
                links[j].append(i)
    component = [None] * len(rows)
    for i in range(len(rows)):
        if component[i] is None:
            stack, seen = [i], {i}
            while stack:
                for j in links[stack.pop()]:
                    if j not in seen:
                        seen.add(j)
                        stack.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                component[j] = min(ids) if ids else None
    return sets, links, component


def near_copies(seed=7):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "the", "The"]
    rows = []
    for g in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([3, 5, 9, 60, 120]))]
        for _ in range(draw.choice([1, 2, 3, 6])):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    hot = [draw.choice(words) for _ in range(100)]
    for i in range(80):
        copy = list(hot)
        for _ in range(draw.randint(0, 2)):
            copy[draw.randrange(100)] = f"x{draw.randint(0, 9)}"
        rows.append((len(rows), " ".join(copy) + " " + " ".join(draw.choice(words) for _ in range(draw.choice([0, 0, 5, 40])))))
    return rows


def test_jaccard_join_is_exact(spark):
    rows = near_copies()
    sets, links, component = plain_links(rows)
    for options in ({}, {"block": 8, "cuts": 3, "fragment_shingles": 500}):
        got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs(spark, rows).repartition(5), **options).collect()}
        for i, (doc_id, _) in enumerate(rows):
            r = got[doc_id]
            assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(sets[i]), component[i], len(links[i]))


def test_jaccard_join_is_exact_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", "members < 0")
    pairs = jaccard._candidate_pairs
    monkeypatch.setattr(jaccard, "_candidate_pairs", lambda *a: pairs(*a, longest=10))
    rows = near_copies()
    sets, links, component = plain_links(rows)
    for options in ({}, {"block": 8, "cuts": 3, "fragment_shingles": 500}):
        got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs(spark, rows).repartition(5), **options).collect()}
        for i, (doc_id, _) in enumerate(rows):
            r = got[doc_id]
            assert (r["n_shingles"], r["component_id"], r["n_links"]) == (len(sets[i]), component[i], len(links[i]))


def test_jaccard_candidates_of_shared_paragraphs(spark, monkeypatch):
    """Texts of which each shares paragraphs with others, but none links, are no blocks of all pairs."""
    draw = random.Random(4)
    paragraphs = [" ".join(f"p{draw.randint(0, 10**6)}" for _ in range(60)) for _ in range(100)]
    rows = [(i, " ".join(draw.sample(paragraphs, 5))) for i in range(1200)]
    rows += [(2000, rows[0][1] + " more"), (2001, rows[0][1])]
    seen = {}
    for name in ("_candidate_pairs", "_blocks"):
        made = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda *a, made=made, name=name, **k: seen.setdefault(name, made(*a, **k)))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(docs(spark, rows)).collect()}
    assert {i: x for i, x in got.items() if x != (i, 0)} == {0: (0, 2), 2000: (0, 2), 2001: (0, 2)}
    assert seen["_blocks"].count() == 0
    sets = plain_sets(rows)
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    met = set()
    for i, s in enumerate(sets):
        for g in sorted((g for g in s if len(holders[g]) > 1), key=lambda g: len(holders[g]))[: len(s) // 5 + 1]:
            met |= {(j, i) for j in holders[g] if j < i}
    assert seen["_candidate_pairs"].count() <= len(met) < len(rows) ** 2 / 8


def test_whole_hashes_are_the_hashes_or_tell_them_apart():
    draw = np.random.default_rng(5)
    hashes = draw.integers(0, 1 << 64, 5000, np.uint64)
    for fragments in (7, 65_536, 1_000_003):
        cut = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        keys = jaccard.whole_hashes(hashes & np.uint64((1 << 48) - 1), cut.astype(np.int64), fragments)
        assert len(np.unique(keys)) == len(hashes)
        assert fragments < 65_536 or (keys == hashes).all()


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one two"), (6, "a b c d e " * 8000), (7, "a b c d e " * 8000), (None, "one two"), (9, "É b c d e"), (10, "é b c d e")]


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_join(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["n_links"]))
    assert by[1] == [(0, 1, 0)] and by[2] == [(0, 2, 0)] and by[3] == [(0, 3, 0)]
    assert by[4] == [(1, 4, 3)] and by[5] == [(1, 4, 3)] * 2 and by[None] == [(1, 4, 3)]
    assert by[6] == [(5, 6, 1)] and by[7] == [(5, 6, 1)] and by[9] == [(1, 9, 0)]
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0


def test_keep_one_each(spark):
    kept = jaccard.keep_one_each(docs(spark, ODD))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 6, 9, 10]
    rows = near_copies()
    _, _, component = plain_links(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one_each(docs(spark, rows)).collect()}
    assert kept == set(component)


VECTORS = "vec_id long, embedding array<float>, label int, rep string, unit string, weight int"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "r", "u", 2) for i, v, c in rows], VECTORS)


def clustered(seed=3, n=700, dim=16):
    draw = np.random.default_rng(seed)
    rows, hub = [], draw.normal(size=dim)
    for i in range(n):
        if i % 5 == 0 and rows:
            v = np.array(rows[draw.integers(len(rows))][1]) + 0.03 * draw.normal(size=dim)
        elif i % 3 == 0:
            v = hub + 0.14 * draw.normal(size=dim)
        else:
            v = draw.normal(size=dim)
        rows.append((i * 3, v.astype(np.float32).tolist(), int(draw.integers(2))))
    return rows + [(9000 + i, rows[3][1], rows[3][2]) for i in range(40)]


def plain_near(rows, least=0.98):
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([c for *_, c in rows])
    hit = (x @ x.T >= least) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    return hit.sum(axis=1), vectors.local_roots(len(rows), a, b)


def test_near_vectors_recall_and_no_false_link(spark):
    rows = sorted(clustered())
    degree, roots = plain_near(rows)
    given = vector_rows(spark, rows)
    found = vectors.near_vectors(given, shard_rows=120)
    got = {r["vec_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    links = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= d for (i, *_), d in zip(rows, degree))
    assert links >= 0.9 * degree.sum() > 0
    same = sum(got[i]["component_id"] == rows[r][0] for (i, *_), r in zip(rows, roots))
    assert same >= 0.95 * len(rows)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got.values())
    audit = vectors.audit_recall(given, found, every=5).first()
    assert audit["recall"] >= 0.9 and audit["exact"] > 0


def hot_group(n=800, dim=16, seed=8):
    """One label; all but every tenth row are distinct vectors near one another."""
    draw = np.random.default_rng(seed)
    hub = draw.normal(size=dim)
    hub /= np.linalg.norm(hub)
    spread = 0.15 / np.sqrt(dim)
    return [(i, ((hub + spread * draw.normal(size=dim)) if i % 10 else draw.normal(size=dim)).astype(np.float32).tolist(), 1) for i in range(n)]


def test_near_vectors_meets_the_links_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 100)
    rows = hot_group()
    degree, roots = plain_near(rows)
    got = {r["vec_id"]: r for r in vectors.near_vectors(vector_rows(spark, rows), shard_rows=40, levels=2).collect()}
    links = np.array([got[i]["n_links"] for i, *_ in rows])
    assert degree.sum() > 100_000 and (links <= degree).all() and links.sum() >= 0.99 * degree.sum()
    assert [got[i]["component_id"] for i, *_ in rows] == [rows[r][0] for r in roots]


def test_pruned_graph_and_range_search():
    draw = np.random.default_rng(2)
    unit = draw.normal(size=(700, 24))
    unit[:200] = unit[0] + 0.02 * draw.normal(size=(200, 24))
    unit[300:600:2] = unit[301:600:2] + 0.01 * draw.normal(size=(150, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = vectors.pruned_graph(unit)
    assert graph.shape == (700, 2 * (vectors.NEAR + vectors.FAR)) and graph.max() < 700
    assert all(i not in row for i, row in enumerate(graph.tolist()))
    exact = unit @ unit.T
    for entry in (np.full(700, -1), np.arange(700)):
        seen = vectors.range_search(unit, entry, unit, graph, 0, 0.98)
        looked = np.isfinite(seen)
        assert np.allclose(seen[looked], exact[looked])
        assert ((seen >= 0.98).sum() >= 0.98 * (exact >= 0.98).sum()) and looked.mean() < 0.6
    for few in (1, 2, 5):
        graph = vectors.pruned_graph(unit[:few])
        assert vectors.range_search(unit[:few], np.full(few, -1), unit[:few], graph, 0, 0.98).shape == (few, few)


def test_near_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [0, 0], 1), (4, [1, None], 1), (5, [nan, 1], 1), (6, [1, 0], None), (7, [1, 0], 1), (8, [2, 0], 1), (9, [1, 0, 0], 1), (10, [1, 0], 2), (None, [1, 0], 1), (8, [2, 0], 1)]
    got = vectors.near_vectors(vector_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by[7] == (2, 7) and by[8] == (2, 7)
    for i in (1, 2, 3, 4, 5, 6, 9, 10):
        assert by[i] == (0, i)
    assert vectors.near_vectors(vector_rows(spark, [])).count() == 0


def test_top_inner_products_exact(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=8) * draw.choice([0.1, 1, 1, 5])).tolist(), 1) for i in range(600)]
    rows += [(600 + i, rows[0][1], 1) for i in range(30)] + [(700 + i, (np.array(rows[50][1]) * (1 + i / 50)).tolist(), 1) for i in range(20)]
    x = np.floor(256 * np.array([v for _, v, _ in rows], np.float32).astype(float)).astype(np.int64)
    ids = np.array([i for i, *_ in rows])
    for options in ({}, {"bucket_rows": 50, "query_rows": 4}):
        got = {}
        for r in topk.top_inner_products(vector_rows(spark, rows), **options).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == {int(i) for i in ids if i % 50 == 0}
        for q, found in got.items():
            score = x @ x[ids == q][0]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
            assert [found[k] for k in range(1, 6)] == [(ids[j], score[j]) for j in order]


def test_top_inner_products_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1, 1], 1), (50, [0, 0], 1), (1, None, 1), (2, [None, 1], 1), (3, [inf, 1], 1), (4, [2, 2], 1), (100, [1, 2, 3], 1), (None, [1, 1], 1), (4, [2, 2], 1)]
    got = topk.top_inner_products(vector_rows(spark, rows)).collect()
    by = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert by == {(0, 1): (4, 262144), (0, 2): (4, 262144), (0, 3): (50, 0), (50, 1): (0, 0), (50, 2): (4, 0), (50, 3): (4, 0)}
    assert topk.top_inner_products(vector_rows(spark, [])).count() == 0


def test_top_inner_products_of_large_components(spark):
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-2, 2) for _ in range(3)]) for i in range(120)]
    large = [1e17, 1e30, 1e300, 3.4028234663852886e38, -1e19, 2.0**54, float("inf")]
    rows += [(1000 + i, [x, 0.0, 1.0]) for i, x in enumerate(large)] + [(50 * 1000, [0.0, 1e12, -3.0]), (150, [-1e305, 0.0, 0.5]), (200, [0.0, 0.0, 0.0])]

    def floors(vector):
        return [math.floor(256 * Fraction(x)) for x in vector]

    ints = {i: floors(v) for i, v in rows if all(map(math.isfinite, v))}
    want = {}
    for q in ints:
        if q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q]
            fit = sorted(s for s in scored if -(1 << 63) <= -s[0] < 1 << 63)
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(fit[:5])}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(table, bucket_rows=16).collect()}
    assert got == want
    small = spark.createDataFrame([(i, v) for i, v in rows if i < 120], "vec_id long, embedding array<double>")
    extra = spark.createDataFrame([(7000, [1e300, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_inner_products(small).collect() == topk.top_inner_products(small.unionAll(extra)).where("vec_id <> 7000").collect()


def plain_spans(rows, run=3, least=12):
    first, occurrences = {}, []
    for doc_id, text in rows:
        units = spans.sentences(text or "", 12)
        words, found = [u[2] for u in units], set()
        for i in range(len(units)):
            for j in range(i + run - 1, len(units)):
                if sum(words[i : j + 1]) >= least:
                    found.add((i, j))
                    break
            for k in range(i - run + 1, -1, -1):
                if sum(words[k : i + 1]) >= least:
                    found.add((k, i))
                    break
        for i, j in found:
            key = tuple(u[3] for u in units[i : j + 1])
            occurrences.append((key, doc_id, i, j))
            first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    covered = {}
    for key, doc_id, i, j in occurrences:
        if first[key] != (doc_id, i):
            covered.setdefault(doc_id, set()).update(range(i, j + 1))
    return covered


def test_sentence_spans_against_brute_force(spark):
    draw = random.Random(6)
    passages = [" ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 50)}" + ("." if k % 7 == 6 else "") for k in range(70)) for _ in range(6)]
    rows = []
    for i in range(60):
        own = [". ".join(" ".join(f"u{draw.randint(0, 9999)}" for _ in range(draw.randint(1, 15))) for _ in range(4)) for _ in range(2)]
        rows.append((i, f"{own[0]}.\n{draw.choice(passages)}.\n{own[1]}! Yes. No. Yes. No."))
    covered = plain_spans(rows)
    got = spans.dedup_sentence_spans(docs(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r["n_removed"] == len(covered.get(r["doc_id"], ()))
        rest = texts[r["doc_id"]]
        for span in reversed([s for s in r["removed"].split(",") if s]):
            a, b = map(int, span.split(":"))
            rest = rest[:a] + rest[b:]
        assert rest == r["text"]


def test_sentence_spans_at_any_word_offset(spark):
    draw = random.Random(9)
    word = lambda: f"w{draw.randint(0, 99999)}"
    passage = " ".join(word() for _ in range(52))
    rows = [(i, " ".join([*(word() for _ in range(20 + i)), passage, *(word() for _ in range(17))])) for i in range(13)]
    got = {r["doc_id"]: r for r in spans.dedup_sentence_spans(docs(spark, rows)).collect()}
    assert got[0]["removed"] == ""
    for i, text in rows[1:]:
        at = text.index(passage)
        (a, b), = [map(int, s.split(":")) for s in got[i]["removed"].split(",")]
        assert at <= a < b <= at + len(passage) and b - a >= 60


def test_sentence_spans_odd_rows(spark):
    passage = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen. Fifteen sixteen."
    rows = [(1, None), (2, ""), (3, passage), (4, passage), (4, passage), (None, passage), (5, "short. text."), (6, "x. " * 40_000)]
    got = spans.dedup_sentence_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] == passage and by[4]["n_removed"] == by[4]["n_sentences"] == 4 and by[4]["text"].strip() == ""
    assert by[None]["text"] == passage and by[1]["text"] is None and by[5]["n_removed"] == 0
    assert by[6]["n_removed"] > 30_000
    assert spans.dedup_sentence_spans(docs(spark, [])).count() == 0
