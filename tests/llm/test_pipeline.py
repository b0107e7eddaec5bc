"""The pipeline's stages on a small table, each held against a plain version over its own input; the registry."""

import re

import corpus_pipeline
from corpusindex.llm import packing, registry, secrets, toxicity

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def smallest_linked(rows):
    """The smallest id of each text's group, by comparing all sets of five-word shingles."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in ((i, words(t)) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def plain_mask(text):
    base, added = secrets.find_secrets(text or "", 20, {"entropy_hex": 3.0, "entropy_base64": 3.9})
    marked = [False] * len(text or "")
    for a, b, _ in base + added:
        marked[a:b] = [True] * (b - a)
    out, before = [], False
    for c, hit in zip(text or "", marked):
        out += [] if hit and before else ["[SECRET]"] if hit else [c]
        before = hit
    return "".join(out)


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == names
    rows = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:-1]]
    scored = toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()
    assert sorted(i for i, _ in rows[1]) == sorted(r["doc_id"] for r in scored) and len(rows[1]) > 100
    assert {i for i, _ in rows[2]} == smallest_linked(rows[1]) and len(rows[2]) == len({i for i, _ in rows[2]})
    assert sorted(rows[3]) == sorted((i, plain_mask(t)) for i, t in rows[2])
    sources = {r["doc_id"]: r["source"] for r in tables[3].collect()}
    size, taken = {}, {}
    for i, t in rows[3]:
        size[sources[i]] = size.get(sources[i], 0) + len(words(t))
    for i, t in rows[4]:
        taken[sources[i]] = taken.get(sources[i], 0) + len(words(t))
    assert set(rows[4]) <= set(rows[3]) and max(rows[4].count(r) for r in rows[4]) <= 3
    assert all(n <= 3 * size[s] for s, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())
    expected = sum(len(packing.encoder("byte_bpe_50k").ids(t or "")) + 1 for _, t in rows[4])
    assert sum(r["length"] for r in tables[5].collect()) == expected


def test_every_operator_is_registered():
    found = registry.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found if re.match("op[0-9]", k)) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "mix_sources", "retrieval_packing"]
