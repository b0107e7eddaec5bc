"""Toxicity: a linear classifier on words and word beginnings, regularised by counterfactual swaps of identity terms.

Labelled sentences are read again with the group that they name swapped for another, or with a group put into them; the
difference in score is penalised while the classifier is fitted, so that the mention of a group by itself moves no score.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import record, sliced

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Features are hashed to so many buckets; SELECTED of them, at most, get a weight beside those of the identity terms.
BUCKETS = 1 << 21
SELECTED = 4096
#: Rows of each label, in expectation, of the sample on which the classifier is fitted.
SAMPLE_PER_LABEL = 6000
#: Labelled sentences into which each pair of identity terms is put.
SENTENCES_PER_PAIR = 4
#: Words up to this length are remembered with their features; longer ones are read anew.
REMEMBERED = 48

# Groups of identity terms that can stand for each other, in the languages of the texts.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "arab"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "blind", "deaf"),
    ("old", "young", "elderly"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs", "arabes", "asiatiques"),
    ("immigrés", "citoyens", "réfugiés"),
    ("homosexuels", "hétérosexuels"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "atheisten"),
    ("schwarze", "weiße", "araber", "asiaten"),
    ("einwanderer", "bürger", "flüchtlinge"),
    ("homosexuelle", "heterosexuelle"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos", "árabes", "asiáticos"),
    ("inmigrantes", "ciudadanos", "refugiados"),
    ("homosexuales", "heterosexuales"),
)


def counterparts(groups=IDENTITY_TERMS) -> dict[str, tuple[str, ...]]:
    """Each identity term with the others of its group."""
    return {term: tuple(t for t in group if t != term) for group in groups for term in group}


def word_features(word: str) -> list[int]:
    """Buckets of a word: the whole word, and each beginning of 3 to 8 characters that it goes beyond."""
    parts = [word + "$"] + [word[:k] + "+" for k in range(3, min(9, len(word)))]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def counterfactual_pairs(texts: list[str | None], others: dict[str, tuple[str, ...]], per_pair: int = SENTENCES_PER_PAIR) -> list[tuple[set[str], set[str]]]:
    """Words of labelled sentences and of the same with an identity term swapped for each of its counterparts.

    Sentences that name a group give a pair for every term and counterpart. So that the penalty also holds where few texts
    name one, each pair of terms is put into `per_pair` other sentences, and each term is held against the bare sentence.
    """
    pairs, bare = [], []
    for text in texts:
        if len(bare) >= per_pair * len(others) and not text_words(text) & others.keys():
            continue
        for m in SENTENCE.finditer(text or ""):
            words = text_words(m.group())
            named = sorted(words & others.keys())
            pairs += [(words, (words - {term}) | {other}) for term in named for other in others[term]]
            if words and not named and len(bare) < per_pair * len(others):
                bare.append(words)
    turn = 0
    for term, rest in sorted(others.items()) if bare else ():
        for k in range(per_pair):
            words = bare[turn % len(bare)]
            turn += 1
            pairs += [(words | {term}, words | {other}) for other in rest] + [(words, words | {term})]
    return pairs


def _matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a matrix given by the columns of each row."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows or [np.empty(0, int)]).astype(int)


def fit(
    texts: list[str | None],
    toxic: np.ndarray,
    weights: np.ndarray,
    others: dict[str, tuple[str, ...]],
    penalty: float,
    ridge: float = 8e-6,
    steps: int = 600,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the intercept of a weighted logistic regression.

    Loss: weighted log loss + ridge * |w|^2 + penalty * mean squared difference of the log-odds of the two sentences of
    each counterfactual pair.
    """
    support = [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
    rows = []
    for i, text in enumerate(texts):
        row = np.unique(np.array([f for w in text_words(text) for f in word_features(w)], np.int32))
        support[int(toxic[i])][row] += 1
        rows.append(row)
    totals = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    shares = [(s + 0.5) / (n + 1) for s, n in zip(support, totals)]
    both = support[0] + support[1]
    ranked = np.where(both >= 4, np.abs(np.log(shares[1] / shares[0])) * np.sqrt(both) * (1 + 9 * (shares[1] > shares[0])), 0)
    chosen = np.sort(np.argsort(-ranked, kind="stable")[:SELECTED])
    chosen = chosen[ranked[chosen] > 0]
    named = np.unique(np.array([f for term in others for f in word_features(term)], int))
    chosen = np.union1d(chosen, named[both[named] > 0]) if len(named) else chosen
    column = np.full(BUCKETS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    picked = [column[r][column[r] >= 0] for r in rows]
    del rows, support, both, shares, ranked
    at, col = _matrix(picked)
    pairs = [(buckets_of(a, column), buckets_of(b, column)) for a, b in counterfactual_pairs(texts, others)] if penalty else []
    p_at, p_col = _matrix([a for a, _ in pairs])
    s_at, s_col = _matrix([b for _, b in pairs])
    n, k = len(texts), len(chosen)
    w, b = np.zeros(k), 0.0
    weights = weights / weights.sum() if len(weights) else weights
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], n) + b
        error = weights * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        slope = np.bincount(col, error[at], k) + 2 * ridge * w
        if pairs:
            gap = np.bincount(p_at, w[p_col], len(pairs)) - np.bincount(s_at, w[s_col], len(pairs))
            gap *= 2 * penalty / len(pairs)
            slope += np.bincount(p_col, gap[p_at], k) - np.bincount(s_col, gap[s_at], k)
        gradient = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:k], b - move[k]
    return chosen, w, float(b)


def buckets_of(words: set[str], column: np.ndarray) -> np.ndarray:
    found = column[np.unique(np.array([f for w in words for f in word_features(w)] or [0], np.int64))]
    return found[found >= 0]


def _sample(labels: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, toxic, weight): about `per_label` ids of each label by a hash of the id, none of the held-out third."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    clean = clean.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    clean = clean.where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in clean.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {k: min(1.0, per_label / max(1, counts.get(k, 0))) for k in (0, 1)}
    chance = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0])
    return clean.where(chance < wanted).withColumn("weight", F.sqrt(1.0 / wanted))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, penalty: float = 1.0, groups=IDENTITY_TERMS):
    """The fitted buckets, weights and intercept: at most SELECTED numbers, from a sample of bounded size.

    The ids of the sample, some 2 * `per_label`, are sent to every task to pick their texts, one of each id (that with the
    smallest hash), which one task then fits.
    """
    sample = F.broadcast(_sample(labels, per_label))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    picked = picked.groupBy("doc_id", "toxic", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text")).repartition(1)
    others = counterparts(groups)

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (r[0], r[1] or ""))
        toxic = np.array([r[2] for r in rows], float)
        if len(set(toxic)) < 2:
            # one label or none: the score is the label's smoothed share
            share = (toxic.sum() + 0.5) / (len(toxic) + 1)
            features, weights, intercept = np.empty(0, int), np.empty(0), math.log(share / (1 - share))
        else:
            features, weights, intercept = fit([r[1] for r in rows], toxic, np.array([r[3] for r in rows]), others, penalty)
        schema = pa.schema([("feature", pa.int64()), ("weight", pa.float64())])
        yield record(schema, [np.append(features, -1).astype(np.int64), np.append(weights, intercept)])

    model = picked.select("doc_id", "text", "toxic", "weight").mapInArrow(run, "feature long, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in model if r["feature"] >= 0}
    return weights, next((r["weight"] for r in model if r["feature"] < 0), 0.0)


def scorer(weights: dict[int, float], intercept: float, terms=frozenset()):
    """A function from a list of texts to their scores and the number of `terms` that each names; it remembers the features
    of words it has seen."""
    known: dict[str, frozenset] = {}

    def features(word: str) -> frozenset:
        hits = known.get(word)
        if hits is None:
            hits = frozenset(f for f in word_features(word) if f in weights)
            if len(word) <= REMEMBERED:
                if len(known) >= 200_000:
                    known.clear()
                known[word] = hits
        return hits

    def scores(texts: list[str | None]) -> tuple[list[float], list[int]]:
        out, named = [], []
        for text in texts:
            words, found = text_words(text), set()
            for word in words:
                found |= features(word)
            z = intercept + sum(sorted(weights[f] for f in found))
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            named.append(len(words & terms))
        return out, named

    return scores


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, penalty: float = 1.0, threshold: float = 0.7, groups=IDENTITY_TERMS
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (1 where score >= threshold), n_identity.

    Only the text makes the score: presence of words and word beginnings in the whole text; `n_identity` counts the
    identity terms that it names. A null or empty text gets the score of a text without features. Labels come from rows
    whose crc32 of the id, as text, is not 1 modulo 3; rows with a null or other label are skipped, and an id labelled twice
    counts as toxic if one row says so. Without labels of both kinds every text gets the same score. Repeated rows each give
    a row; a null id is not held out; other columns are not read. The model, a few thousand numbers, travels with the tasks.
    """
    weights, intercept = train(docs, labels, per_label, penalty, groups)
    names = docs.select(F.col("doc_id"), F.col("text"))
    terms = frozenset(counterparts(groups))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_identity", pa.int64())])

    def run(batches):
        scores = scorer(weights, intercept, terms)
        for batch in sliced(batches):
            yield record(schema, [batch.column(0).cast(pa.int64()), *scores(batch.column(1).to_pylist())])

    scored = names.mapInArrow(run, "doc_id long, score double, n_identity long")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_identity"
    )


def mention_report(docs: DataFrame, labels: DataFrame, penalties=(0.0, 1.0), threshold: float = 0.7, groups=IDENTITY_TERMS) -> DataFrame:
    """(penalty, term, mentions, flagged, mean_gap): what naming a group does to clean sentences that were held out.

    Every sentence of a held-out text labelled clean is scored bare and with one identity term, chosen by a hash of the
    sentence. `flagged` counts the mentions that pass the threshold while the bare sentence does not; `mean_gap` is the mean
    absolute change of the score. One model is fitted for each penalty.
    """
    clean = labels.where("toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where(held_out(F.col("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(clean, "doc_id", "left_semi").select("text")
    models = {p: train(docs, labels, penalty=p, groups=groups) for p in penalties}
    terms = sorted(counterparts(groups))
    schema = pa.schema([("penalty", pa.float64()), ("term", pa.string()), ("flag", pa.int64()), ("gap", pa.float64())])

    def run(batches):
        scores = {p: scorer(*model) for p, model in models.items()}
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                bare = [m.group() for m in SENTENCE.finditer(text or "") if text_words(m.group())]
                said = [terms[zlib.crc32(x.encode("utf-8", "replace")) % len(terms)] for x in bare]
                for p, score in scores.items():
                    before, after = score(bare)[0], score([f"{x} {t}" for x, t in zip(bare, said)])[0]
                    flags = [int(a >= threshold > b) for a, b in zip(after, before)]
                    yield record(schema, [[p] * len(bare), said, flags, [abs(a - b) for a, b in zip(after, before)]])

    scored = texts.mapInArrow(run, "penalty double, term string, flag long, gap double")
    return scored.groupBy("penalty", "term").agg(F.count("*").alias("mentions"), F.sum("flag").alias("flagged"), F.avg("gap").alias("mean_gap"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores below `threshold`."""
    weights, intercept = train(docs, labels)

    def run(batches):
        scores = scorer(weights, intercept)
        for batch in sliced(batches):
            yield batch.filter(pa.array([x < threshold for x in scores(batch.column("text").to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
