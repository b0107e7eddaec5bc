"""Inverted index and batch recall. Every table carries `repo`; statistics and joins are per repo."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from corpusindex.functions.text import idf, normalize_terms
from corpusindex.sources.store import spread, stored

ACTIVE_STATUSES = ("active", "proposed")


def with_terms(docs: DataFrame, *columns: str) -> DataFrame:
    """`docs` with `terms` of the given text or array columns joined by spaces."""
    parts = [F.array_join(c, " ") if dict(docs.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    return docs.withColumn("terms", normalize_terms(F.concat_ws(" ", *parts)))


#: The fields of a decision that are searched.
HAYSTACK = ("title", "domain", "type", "tags", "decision", "rationale", "context", "consequences")


def decision_terms(decisions: DataFrame) -> DataFrame:
    return with_terms(decisions, *HAYSTACK)


def postings(docs: DataFrame) -> DataFrame:
    """(repo, term, id): one row per distinct term of a row with `terms`."""
    return docs.select("repo", "id", F.explode("terms").alias("term")).select("repo", "term", "id")


def document_frequency(index: DataFrame) -> DataFrame:
    """(repo, term, df); a term stands once per id, so rows are counted after map-side sums."""
    return index.groupBy("repo", "term").agg(F.count("*").alias("df"))


def idf_table(docs: DataFrame) -> DataFrame:
    """(repo, term, df, n, idf) over the rows of each repo."""
    sizes = docs.groupBy("repo").agg(F.count("*").alias("n"))
    df = document_frequency(postings(docs))
    return df.join(sizes, "repo").withColumn("idf", idf(F.col("df"), F.col("n")))


@dataclass(frozen=True)
class Index:
    """A written index: `postings` (repo, term, id) of the candidates, `weights` (repo, term, w2) of all terms, `norms`
    (repo, id, d_self) of the candidates and `sizes` (repo, n) of all rows."""

    postings: DataFrame
    weights: DataFrame
    norms: DataFrame
    sizes: DataFrame


def build_index(docs: DataFrame, keep: Column | None = None) -> Index:
    """The index of `docs` (repo, id, terms), written once; `keep` tells which rows are candidates.

    Terms are taken from the texts once; a recall then reads narrow tables only. A term's weight is its squared idf over
    all rows, candidates or not.
    """
    live = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    flat = stored(docs.select("repo", "id", live.alias("live"), F.explode("terms").alias("term")))
    sizes = stored(docs.groupBy("repo").agg(F.greatest(F.count("*"), F.lit(1)).alias("n")))
    weights = document_frequency(flat).join(sizes, "repo").select("repo", "term", (idf(F.col("df"), F.col("n")) ** 2).alias("w2"))
    weights = stored(weights)
    candidates = flat.where("live").drop("live")
    norms = candidates.join(weights, ["repo", "term"]).groupBy("repo", "id").agg(F.sum("w2").alias("d_self"))
    return Index(candidates, weights, stored(norms), sizes)


def decision_index(decisions: DataFrame, keep: Column | None = None) -> Index:
    return build_index(decision_terms(spread(decisions, "repo", "id")), keep)


def weighed_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(repo, query_id, term, w2) of `queries` (repo, query_id, terms), written first, so that Spark knows how few they are and
    does not send the postings about. A repo without rows has n 1."""
    asked = queries.select("repo", "query_id", F.explode(F.array_distinct("terms")).alias("term"))
    asked = asked.join(index.sizes, "repo", "left").join(index.weights, ["repo", "term"], "left")
    n = F.coalesce("n", F.lit(1))
    return stored(asked.select("repo", "query_id", "term", F.coalesce("w2", idf(F.lit(0), n) ** 2).alias("w2")))


def scores(asked: DataFrame, postings: DataFrame, norms: DataFrame) -> DataFrame:
    """(repo, query_id, id, score) of all pairs that share a term: shared idf**2 over the smaller sum of either side's."""
    q_self = asked.groupBy("repo", "query_id").agg(F.sum("w2").alias("q_self"))
    dots = asked.join(postings, ["repo", "term"]).groupBy("repo", "query_id", "id").agg(F.sum("w2").alias("dot"))
    scored = dots.join(q_self, ["repo", "query_id"]).join(norms, ["repo", "id"])
    score = F.round(F.col("dot") / F.least("q_self", "d_self"), 6)
    return scored.select("repo", "query_id", "id", score.alias("score")).where("score > 0")


def overlap_scores(queries: DataFrame, index: Index) -> DataFrame:
    """scores() of `queries` (repo, query_id, terms) against the index."""
    return scores(weighed_terms(queries, index), index.postings, index.norms)


def ranked_top(scored: DataFrame, counts: DataFrame, top: int | None = None) -> DataFrame:
    """`scored` (repo, query_id, id, score) with rank, matched (of `counts`) and shown, its first rows only: `top`, else 1
    where the first has twice the second's score, else 3. Ties go to the smaller id by code point."""
    by = Window.partitionBy("repo", "query_id")
    order = by.orderBy(F.col("score").desc(), "id")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(top or 0, 3))
    ranked = first.withColumn("s1", F.max("score").over(by)).withColumn("s2", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(by))
    shown = F.lit(top) if top else F.when(F.col("s1") >= 2 * F.coalesce("s2", F.lit(0.0)), 1).otherwise(3)
    ranked = ranked.join(counts, ["repo", "query_id"]).withColumn("shown", F.least(shown, F.col("matched")))
    return ranked.where("rank <= shown").drop("s1", "s2")


def adaptive_top(scored: DataFrame, top: int | None = None) -> DataFrame:
    """ranked_top() of `scored`, counted by itself. Scores are written once, as both need them; only the first rows of each
    query are ranked against each other."""
    scored = stored(scored)
    return ranked_top(scored, scored.groupBy("repo", "query_id").agg(F.count("*").alias("matched")), top)


def recall(queries: DataFrame, decisions: DataFrame, statuses=ACTIVE_STATUSES, domain: str | None = None, top: int | None = None) -> DataFrame:
    """(repo, query_id, id, score, rank, matched, shown); `statuses` None searches all."""
    keep = F.lit(True) if statuses is None else F.col("status").isin(*statuses)
    if domain is not None:
        keep = keep & (F.col("domain") == domain)
    asked = queries.withColumn("terms", normalize_terms(F.col("q")))
    return adaptive_top(overlap_scores(asked, decision_index(decisions, keep)), top)


def recall_cards(queries: DataFrame, decisions: DataFrame, **options) -> DataFrame:
    """recall() with the decisions' fields: the first of each query in full, the others as summaries."""
    return cards(recall(queries, decisions, **options), decisions)


def cards(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    hits = stored(hits)
    full = F.col("rank") == 1
    fields = ["type", "status", "domain", "title", "decision", "tags"]
    rest = ["date", "context", "rationale", "consequences", "supersedes"]
    joined = hits.join(decisions.select("repo", "id", *fields, *rest), ["repo", "id"])
    return joined.select(
        "repo", "query_id", "rank", "matched", "shown", "id", (F.floor(F.col("score") * 100 + 0.5) / 100).alias("score"),
        *fields, *[F.when(full, F.col(c)).alias(c) for c in rest],
    )


def unmatched(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries without a hit."""
    return queries.join(hits.select("repo", "query_id").distinct(), ["repo", "query_id"], "left_anti")


#: Words of as many characters in all go to every task; more are dealt out with the texts.
WORDS_SENT = 1 << 20
#: Words of an automaton, and bytes of text that meet one, where words are dealt out.
SLICE_WORDS, BLOCK_BYTES = 50_000, 64 << 20


def _automaton(words: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        if w:
            found.add_word(w, w)
    found.make_automaton()
    return found if len(found) else None


def _within(automaton, empty: bool, hay: str | None) -> list[str]:
    """The distinct words in a text, in one pass over it."""
    if hay is None:
        return []
    found = {w for _, w in automaton.iter(hay)} if automaton else set()
    return [*([""] if empty else []), *sorted(found)]


def _hits(batch: pa.RecordBatch, hits: Iterable[tuple[int, int, list[str]]], schema: pa.Schema, most: int = 1 << 23):
    """Batches of `hits` (row of `batch`, length of its text, words), of some `most` characters, as a row comes with every word."""
    rows, found, size = [], [], 0

    def flush():
        taken = batch.take(pa.array(rows, pa.int64()))
        columns = [taken.column(f.name).cast(f.type) for f in schema if f.name != "word"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], schema=schema)

    for row, length, words in hits:
        for word in words:
            rows.append(row)
            found.append(word)
            size += length + len(word) + 64
            if size > most:
                yield flush()
                rows, found, size = [], [], 0
    if rows:
        yield flush()


def containing(texts: DataFrame, words: DataFrame, *keep: str, sent: int = WORDS_SENT, slice_words: int = SLICE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(repo, keep, word): each row of `texts` (repo, hay, keep) with each distinct one of its repo's `words` that `hay` contains.

    All words of a repo are looked for in one pass over a text. Words of at most `sent` characters in all go to the tasks that
    read the texts, and no text moves. More words are cut into slices of about `slice_words` a repo and the texts into blocks
    of about `block_bytes`; a text moves once for each slice of its repo, together with its block, to where the slice's words
    stand before it, so a repo with most texts or words is spread. Null texts and words meet nothing; the empty word is in
    every text.
    """
    spark = texts.sparkSession
    asked = words.select("repo", "word").where("word IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    columns = ["repo", *keep]
    out = T.StructType([*[texts.select(*columns).schema[c] for c in columns], T.StructField("word", T.StringType())])
    schema = to_arrow_schema(out)
    if size <= sent:
        by_repo: dict = {}
        for r in asked.collect():
            by_repo.setdefault(r.repo, []).append(r.word)

        def scan(batches):
            built: dict = {}

            def hits(batch):
                for i, (repo, hay) in enumerate(zip(batch.column("repo").to_pylist(), batch.column("hay").to_pylist())):
                    if repo in by_repo:
                        if repo not in built:
                            built[repo] = _automaton(by_repo[repo]), "" in by_repo[repo]
                        yield i, len(hay or ""), _within(*built[repo], hay)

            for batch in batches:
                yield from _hits(batch, hits(batch), schema)

        return texts.select("hay", *columns).mapInArrow(scan, out)

    asked = stored(asked)
    slices = asked.groupBy("repo").agg(F.ceil(F.count("*") / slice_words).alias("slices"))
    blocks = texts.groupBy("repo").agg(F.ceil(F.sum(F.octet_length("hay")) / block_bytes).alias("blocks"))
    sizes = stored(slices.join(blocks, "repo").where("blocks > 0"))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    of = F.struct(*columns).alias("row")
    moved = texts.join(sizes, "repo").select(F.col("repo").alias("key"), F.pmod(F.xxhash64("hay", *keep), "blocks").alias("block"), "hay", of, "slices")
    moved = moved.select("key", "block", each("slices").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("word"), "hay", "row")
    sliced = asked.join(sizes, "repo").select("repo", "word", F.pmod(F.xxhash64("word"), "slices").alias("slice"), each("blocks").alias("block"))
    none = lambda name: F.lit(None).cast(moved.schema[name].dataType).alias(name)
    sliced = sliced.select(F.col("repo").alias("key"), "block", "slice", F.lit(0).alias("kind"), "word", none("hay"), none("row"))
    keys = ["key", "block", "slice"]
    met = sliced.unionByName(moved).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "kind")

    def meet(batches):
        state: list = [None, [], None]  # the group, its words, its automaton

        def hits(batch):
            kinds, own, hays = (batch.column(c).to_pylist() for c in ("kind", "word", "hay"))
            for i, key in enumerate(zip(*[batch.column(c).to_pylist() for c in keys])):
                if key != state[0]:
                    state[:] = key, [], None
                if kinds[i] == 0:
                    state[1].append(own[i])
                    continue
                if state[2] is None:
                    state[2] = _automaton(state[1]), "" in state[1]
                yield i, len(hays[i] or ""), _within(*state[2], hays[i])

        for batch in batches:
            flat = pa.RecordBatch.from_arrays(batch.column("row").flatten(), names=columns)
            yield from _hits(flat, hits(batch), schema)

    return met.mapInArrow(meet, out)


def ask(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(repo, query_id, id, score): how many of a query's words, repeats counted, are within a context's `hay`.

    Words that stand in several queries are looked for once.
    """
    words = queries.select("repo", "query_id", F.explode(F.split(F.lower("q"), r"\s+")).alias("word")).where("word <> ''")
    counted = words.groupBy("repo", "query_id", "word").agg(F.count("*").alias("times"))
    hit = containing(contexts.select("repo", "id", F.lower("hay").alias("hay")), counted, "id")
    return hit.join(counted, ["repo", "word"]).groupBy("repo", "query_id", "id").agg(F.sum("times").cast("double").alias("score"))


def ask_payload(
    hits: DataFrame, endpoints: DataFrame, rules: DataFrame, cards: DataFrame | None = None, flows: DataFrame | None = None
) -> DataFrame:
    """(repo, query_id, id, rank, kind, text): endpoints and cards of the contexts shown, and the first one's rules and flows.

    Each table has repo, id, text. Only contexts that a query shows reach the joins' output.
    """
    shown = hits.select("repo", "query_id", "id", "rank")
    out = None
    for kind, table, first in (("endpoint", endpoints, False), ("card", cards, False), ("rule", rules, True), ("flow", flows, True)):
        if table is not None:
            part = (shown.where("rank = 1") if first else shown).join(table.select("repo", "id", F.lit(kind).alias("kind"), "text"), ["repo", "id"])
            part = part.where("text IS NOT NULL").select("repo", "query_id", "id", "rank", "kind", "text")
            out = part if out is None else out.unionByName(part)
    return out


def signature_lines(endpoints: DataFrame) -> DataFrame:
    """(repo, id, text): `VERB path <- Req -> Resp` of each endpoint."""
    req = F.when(F.col("req").isNotNull(), F.concat(F.lit(" <- "), "req")).otherwise("")
    resp = F.when(F.col("resp").isNotNull(), F.concat(F.lit(" -> "), "resp")).otherwise("")
    return endpoints.select("repo", F.col("ctx_id").alias("id"), F.concat("verb", F.lit(" "), "path", req, resp).alias("text"))


def lookup_detail(wanted: DataFrame, details: DataFrame, *keys: str) -> DataFrame:
    """`wanted` with the detail row of each key, null where there is none, and `found`."""
    marked = details.withColumn("found", F.lit(True))
    return wanted.join(marked, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
