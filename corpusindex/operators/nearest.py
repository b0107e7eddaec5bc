"""The best match of each question among many texts, where nearly every pair shares a term.

No pair is written or moved: texts are cut into slices, a question travels to the slices of its repo, and a task sums up the
weights that it shares with all texts of a slice at once. Only the best text of each slice leaves the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.functions.text import idf
from corpusindex.operators.postings import StoredIndex
from corpusindex.operators.retrieval import decision_terms, document_frequency, postings
from corpusindex.sources.store import spread, stored

#: Terms of a slice's texts, about. A task holds one slice.
SLICE_TERMS = 1 << 21
#: A term that one in so many texts of a slice holds has a row of 0 and 1 by text, the others lists of texts.
COMMON = 4
#: Scores that are summed up at once, and rows of questions and of texts whose terms are.
CELLS = 1 << 20
ASKED, READ = 512, 4000

ROW = "repo string, slice long, kind int, name string, domain string, value double, since long, until long, terms array<string>, w2 array<double>"
BEST = "repo string, query_id string, low double, id string, domain string"
VOCABULARY, TEXT, QUESTION = 0, 1, 2


@dataclass(frozen=True)
class Held:
    """Written once: `texts` (repo, id, domain, live, terms) of all rows, `weights` (repo, term, w2) of their terms and `sizes`
    (repo, n)."""

    texts: DataFrame
    weights: DataFrame
    sizes: DataFrame


def held_decisions(decisions: DataFrame, keep: Column) -> Held:
    """Decisions as texts to be met; `keep` tells which are live. A term's weight is its squared idf over all rows."""
    live = F.coalesce(keep, F.lit(False)).alias("live")
    texts = stored(decision_terms(spread(decisions, "repo", "id")).select("repo", "id", "domain", live, "terms"))
    sizes = stored(texts.groupBy("repo").agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))
    df = document_frequency(postings(texts)).join(sizes, "repo")
    return Held(texts, stored(df.select("repo", "term", (idf(F.col("df"), F.col("n")) ** 2).alias("w2"))), sizes)


def held_index(index: StoredIndex, decisions: DataFrame, keep: Column) -> Held:
    """The same of a kept index, whose texts are not read again."""
    live = decisions.select("repo", "id", "domain", F.coalesce(keep, F.lit(False)).alias("live"))
    forward = index.forward.join(index.docs.select("repo", "id", "batch"), ["repo", "id", "batch"], "left_semi")
    return Held(stored(forward.select("repo", "id", "terms").join(live, ["repo", "id"])), index.weights, index.sizes)


def _rows(df: DataFrame, **given) -> DataFrame:
    """`df` as rows of ROW, its other columns null."""
    out = []
    for c in ROW.split(", "):
        name, kind = c.split()
        value = given[name] if name in given else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _parents(lists: pa.ListArray) -> np.ndarray:
    """The list in which each value of the flattened lists stands."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())


def _vocabulary(texts: DataFrame) -> DataFrame:
    """(repo, slice, term) of `texts`, repeats within a batch left out where the texts are read."""

    def own(batches):
        for batch in (b.slice(at, READ) for b in batches for at in range(0, b.num_rows, READ)):
            terms = batch.column("terms")
            at = _parents(terms)
            table = pa.table({"repo": batch.column("repo").take(pa.array(at)), "slice": batch.column("slice").take(pa.array(at)), "term": terms.flatten()})
            yield from table.group_by(["repo", "slice", "term"]).aggregate([]).combine_chunks().to_batches()

    return texts.select("repo", "slice", "terms").mapInArrow(own, "repo string, slice long, term string")


class _Slice:
    """The texts of one slice, in the order of id and domain."""

    def __init__(self):
        self.words, self.weights, self.parts, self.codes = [], [], [], None

    def build(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.names, self.domains = column("name"), column("domain")
        self.since = column("since").fill_null(np.iinfo(np.int64).min).to_numpy()
        self.until = column("until").fill_null(np.iinfo(np.int64).max).to_numpy()
        terms = column("terms")
        flat = terms.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        rows = _parents(terms)
        self.n = n = table.num_rows
        if self.words:
            words = pa.chunked_array(self.words).combine_chunks()
            weights = np.concatenate(self.weights)[pc.index_in(flat.dictionary, value_set=words).to_numpy()]
            self.own = np.bincount(rows, weights=weights[codes], minlength=n)
        else:
            self.own = column("value").to_numpy(zero_copy_only=False)
        df = np.bincount(codes, minlength=len(flat.dictionary))
        self.codes = dict(zip(flat.dictionary.to_pylist(), range(len(df))))
        self.place = np.full(len(df) + 1, -1)
        common = np.flatnonzero(df * COMMON >= n)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n))
        here = self.place[codes] >= 0
        self.dense[self.place[codes[here]], rows[here]] = 1.0
        order = np.argsort(codes[~here], kind="stable")
        self.rows = rows[~here][order]
        df[common] = 0
        self.starts = np.concatenate([[0], np.cumsum(df)])
        self.words, self.weights, self.parts = [], [], []

    def best(self, batch: pa.RecordBatch):
        """(place in the batch, score, row) of each question that meets a text."""
        terms, w2 = batch.column("terms"), batch.column("w2")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
        weights = w2.flatten().to_numpy()
        codes = np.array([self.codes.get(t, -1) for t in terms.flatten().to_pylist()], np.int64)
        until = batch.column("since")
        timed, at = until.null_count < len(until), until.fill_null(0).to_numpy()
        block = max(1, CELLS // self.n)
        for low in range(0, batch.num_rows, block):
            high = min(batch.num_rows, low + block)
            asked = np.zeros((high - low, len(self.dense)))
            for i in range(low, high):
                c, w = codes[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]
                p = self.place[c]  # -1 too where the term is unknown
                asked[i - low, p[p >= 0]] = w[p >= 0]
            dots = asked @ self.dense
            for i in range(low, high):
                c, w = codes[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]]
                dot, rare = dots[i - low], (c >= 0) & (self.place[c] < 0)
                if rare.any():
                    lists = [self.rows[self.starts[x] : self.starts[x + 1]] for x in c[rare]]
                    dot = dot + np.bincount(np.concatenate(lists), weights=np.repeat(w[rare], [len(x) for x in lists]), minlength=self.n)
                least = np.minimum(w.sum(), self.own)
                score = np.floor(np.divide(dot, least, out=np.zeros(self.n), where=least > 0) * 1e6 + 0.5) / 1e6
                if timed:
                    score[(self.since >= at[i]) | (at[i] > self.until)] = 0.0
                found = int(score.argmax())
                if score[found] > 0:
                    yield i, -score[found], found


def _meet(batches):
    schema = pa.schema([("repo", pa.string()), ("query_id", pa.string()), ("low", pa.float64()), ("id", pa.string()), ("domain", pa.string())])
    key, held = None, None
    for batch in batches:
        keys = list(zip(batch.column("repo").to_pylist(), batch.column("slice").to_pylist(), batch.column("kind").to_pylist()))
        starts = [i for i in range(len(keys)) if i % ASKED == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if keys[a][:2] != key:
                key, held = keys[a][:2], _Slice()
            part, kind = batch.slice(a, b - a), keys[a][2]
            if kind == VOCABULARY:
                held.words.append(part.column("name"))
                held.weights.append(part.column("value").to_numpy())
            elif kind == TEXT:
                held.parts.append(part.select(["name", "domain", "value", "since", "until", "terms"]))
            elif held.codes is not None or held.parts:
                if held.codes is None:
                    held.build()
                found = list(held.best(part))
                at = pa.array([f[2] for f in found], pa.int64())
                asked = part.take(pa.array([f[0] for f in found], pa.int64()))
                columns = [asked.column("repo"), asked.column("name"), pa.array([f[1] for f in found], pa.float64()), held.names.take(at), held.domains.take(at)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def questions(asked: DataFrame) -> DataFrame:
    """(repo, query_id, terms, w2), written, of weighed terms (repo, query_id, term, w2)."""
    each = asked.groupBy("repo", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", "w2"))).alias("t"))
    return stored(each.select("repo", "query_id", F.col("t.term").alias("terms"), F.col("t.w2").alias("w2")))


def best_matches(asked: DataFrame, texts: DataFrame, weights: DataFrame | None = None, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(repo, query_id, id, domain, score): the text of the highest score above 0 for each of the `asked`, see retrieval.scores().

    `asked` are questions(), with or without `idx`; `texts` are (repo, id, domain, terms) with `weights` (repo, term, w2) of all
    their terms, else with `d_self`, the sum of each one's weights. A question with an `idx` meets only texts whose `since` is
    below it and whose `until` is not, where they have one. Ties go to the smaller id, then domain, by code point. Questions
    without `idx` and of equal terms are asked once.
    """
    timed = "idx" in asked.columns
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leads = asked
    if not timed:
        leads = stored(asked.groupBy("repo", "terms").agg(F.min("query_id").alias("query_id"), F.first("w2").alias("w2")))
    counts = texts.groupBy("repo").agg(F.ceil(F.sum(F.size("terms")) / slice_terms).alias("slices")).where("slices > 0")
    sizes = stored(counts)
    own = texts.where(F.size("terms") > 0).join(sizes, "repo").withColumn("slice", F.pmod(F.xxhash64("id", "domain"), F.col("slices")))
    since, until = (F.col(c) if c in texts.columns else F.lit(None) for c in ("since", "until"))
    value = F.col("d_self") if weights is None else F.lit(None)
    fixed = {c: F.col(c) for c in ("repo", "slice")}
    rows = _rows(own, **fixed, kind=F.lit(TEXT), name=F.col("id"), domain=F.col("domain"), value=value, since=since, until=until, terms=F.col("terms"))
    each = leads.join(sizes, "repo").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    idx = F.col("idx") if timed else F.lit(None)
    rows = rows.unionByName(_rows(each, **fixed, kind=F.lit(QUESTION), name=F.col("query_id"), since=idx, terms=F.col("terms"), w2=F.col("w2")))
    if weights is not None:
        words = _vocabulary(own).join(weights, ["repo", "term"])
        rows = rows.unionByName(_rows(words, **fixed, kind=F.lit(VOCABULARY), name=F.col("term"), value=F.col("w2")))
    met = rows.repartition(n, "repo", "slice").sortWithinPartitions("repo", "slice", "kind", "name", "domain").mapInArrow(_meet, BEST)
    best = met.groupBy("repo", "query_id").agg(F.min(F.struct("low", "id", "domain")).alias("best"))
    best = best.select("repo", "query_id", "best.id", "best.domain", (-F.col("best.low")).alias("score"))
    if timed:
        return best
    same = leads.select("repo", "terms", F.col("query_id").alias("lead")).join(best.withColumnRenamed("query_id", "lead"), ["repo", "lead"])
    return asked.join(same, ["repo", "terms"]).select("repo", "query_id", "id", "domain", "score")
