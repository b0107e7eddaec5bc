"""Lexical retrieval packing: each seed document's window is filled with its unused BM25 neighbours.

Token ids serve as the terms, so the statistics over the corpus are bounded by the vocabulary. Documents are dealt to
shards of about equal size by a signature of their terms, cut where exact counts of signatures say; each shard holds an
inverted index of its documents.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import checkpointed, record, runs, shuffle_partitions, sliced

END_ID = 0
#: Signatures are counted by their first SIGNATURE_BITS of 63.
SIGNATURE_BITS = 18
K1, B = 1.2, 0.75
_loaded: dict[str, object] = {}


class Encoder:
    """Ids of the byte-level BPE in `name`.json, computed with the same vocabulary's ranks in `name`.tiktoken.

    Both give the same ids for ordinary text; a text that holds a special token's string, or that the faster library
    refuses, goes to the tokenizer of the .json file itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.json_path = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = None

    def ids(self, text: str) -> list[int]:
        if self.SPECIAL not in text:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the library's panics are no Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.json_path)
        return self.full.encode(text, add_special_tokens=False).ids


def encoder(name: str) -> Encoder:
    if name not in _loaded:
        _loaded[name] = Encoder(name)
    return _loaded[name]


TOKENISED = "doc_id long, tokens long, near long, nearer long, full binary, rest binary, terms binary, counts binary"


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    out = (values.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _narrow(values: np.ndarray) -> bytes:
    """Two bytes a value where that is enough, else four."""
    return values.astype("<u2" if values.max(initial=0) < 1 << 16 else "<u4").tobytes()


def _wide(blob: bytes, count: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * count else "<u4").astype("<u4")


def tokenised(docs: DataFrame, window: int, tokenizer: str) -> DataFrame:
    """Per row: the number of ids, two signatures of its terms, checksums of its whole windows, the ids after the last of
    them, and its distinct ids with their counts."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "tokens", "near", "nearer")] + [(c, pa.binary()) for c in ("full", "rest", "terms", "counts")]
    )

    def scan(batches):
        encode = encoder(tokenizer)
        for batch in sliced(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                held = array("I", encode.ids(text) if text else ())
                held.append(END_ID)
                ids = np.frombuffer(held, "<u4")
                whole = len(ids) - len(ids) % window
                raw = ids.tobytes()
                full = np.array([zlib.crc32(raw[4 * a : 4 * (a + window)]) for a in range(0, whole, window)], "<u4")
                terms, counts = np.unique(ids, return_counts=True)
                near, nearer = (int(_mixed(terms, seed).min() >> np.uint64(1)) for seed in (1, 2))
                rows.append((doc_id, len(ids), near, nearer, full.tobytes(), _narrow(ids[whole:]), terms.astype("<u4").tobytes(), _narrow(counts)))
            yield record(schema, [list(c) for c in zip(*rows)])

    picked = docs.select(F.col("doc_id").cast("long"), "text")
    return picked.mapInArrow(scan, TOKENISED)


def _term_weights(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequency of every id over all documents, and the mean length: as long as the vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in sliced(batches):
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            got = np.bincount(terms, minlength=len(total))
            got[: len(total)] += total
            total = got
        some = np.flatnonzero(total)
        yield record(pa.schema([("term", pa.int64()), ("docs", pa.int64())]), [pa.array(some), pa.array(total[some])])

    found = tokens.select("terms").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    found = found.toPandas()
    n, mean = tokens.agg(F.count("*"), F.avg("tokens")).first()
    df = np.zeros(int(found["term"].max()) + 1 if len(found) else 1)
    df[found["term"].to_numpy(int)] = found["docs"].to_numpy(float)
    return np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), float(mean or 1)


def _groups(tokens: DataFrame, shard_docs: int) -> DataFrame:
    """(prefix, first, parts, shard_rows): which groups take the documents of each first SIGNATURE_BITS of a signature.

    A group takes neighbouring prefixes of `shard_docs` documents or more; a prefix of many more, as that of copies of one
    text, is a range of `parts` groups, dealt by a hash of the row. The counts are exact, so the groups depend on the
    documents only, and no more than 2**SIGNATURE_BITS numbers travel.
    """
    prefix = F.shiftright("near", 63 - SIGNATURE_BITS).alias("prefix")
    counted = tokens.groupBy(prefix).agg(F.count("*").alias("n")).toPandas().sort_values("prefix")
    rows, number, held = [], 0, []

    def close() -> None:
        nonlocal number, held
        if held:
            total = sum(n for _, n in held)
            per = -(-total // max(1, round(total / shard_docs)))
            rows.extend((p, number, 1, per) for p, _ in held)
            number, held = number + 1, []

    for p, n in zip(counted["prefix"].tolist(), counted["n"].tolist()):
        if n > 2 * shard_docs:
            close()
            parts = -(-n // shard_docs)
            rows.append((p, number, parts, shard_docs))
            number += parts
            continue
        held.append((p, n))
        if sum(x for _, x in held) >= shard_docs:
            close()
    close()
    return tokens.sparkSession.createDataFrame(rows, "prefix long, first long, parts long, shard_rows long")


def _shards(tokens: DataFrame, shard_docs: int) -> DataFrame:
    """`tokens` dealt by group and ordered by group, signature, id and content, so that a task reads shard after shard."""
    placed = tokens.withColumn("prefix", F.shiftright("near", 63 - SIGNATURE_BITS))
    placed = placed.join(F.broadcast(_groups(tokens, shard_docs)), "prefix").withColumn("content", F.xxhash64("full", "rest"))
    part = F.pmod(F.xxhash64(F.lit(29), "doc_id", "content"), F.col("parts"))
    placed = placed.withColumn("group", F.col("first") + part)
    out = placed.repartition(shuffle_partitions(tokens.sparkSession), "group")
    out = out.sortWithinPartitions("group", "near", "nearer", F.col("doc_id").asc_nulls_last(), "content")
    return out.select("group", "shard_rows", *(c.split()[0] for c in TOKENISED.split(", ")))


def in_shards(batches) -> Iterator[tuple[int, pa.Table]]:
    """(group, rows): the rows of each group in pieces of its `shard_rows`."""
    held, count, now = [], 0, None
    for batch in batches:
        group = batch.column(0).to_numpy()
        edges = runs(group)
        for a, b in zip(edges[:-1], edges[1:]):
            if held and now != group[a]:
                yield now, pa.Table.from_batches(held)
                held, count = [], 0
            now, per = int(group[a]), int(batch.column(1)[int(a)].as_py())
            while a < b:
                some = min(b - a, per - count)
                held.append(batch.slice(a, some))
                a, count = a + some, count + some
                if count == per:
                    yield now, pa.Table.from_batches(held)
                    held, count = [], 0
    if held:
        yield now, pa.Table.from_batches(held)


class Shard:
    """The documents of one shard with their inverted index; packs what is left of them after their whole windows.

    A term that one in COMMON documents holds has a row of weights by document in a table, so that a seed's common terms
    are added row by row; the others have postings. Both leave used documents out from time to time.
    """

    COMMON = 8
    #: Neighbours that are ordered at first; the others only where these don't fill a window.
    FIRST = 16

    def __init__(self, lengths, rests, terms, counts, idf, mean, window):
        self.window = window
        self.rests = rests
        self.left = np.array([len(r) for r in rests])
        self.order = 0
        of = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        flat, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / mean).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + norm[of])
        by = np.argsort(flat, kind="stable")
        of, weight = of[by], weight[by]
        self.names, starts, held = np.unique(flat[by], return_index=True, return_counts=True)
        common = held * self.COMMON >= len(terms)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        row = np.repeat(self.row, held)
        table = np.zeros((int(common.sum()), len(terms)), np.float32)
        table[row[row >= 0], of[row >= 0]] = weight[row >= 0]
        self.table = list(table)
        self.postings, self.weights = of[row < 0], weight[row < 0]
        self.starts = np.append(0, np.cumsum(np.where(common, 0, held)))
        self.terms = terms
        self.taken = np.zeros(len(rests), np.int64)
        self.live = np.arange(len(terms))

    def _shrink(self) -> None:
        """Leaves used documents out of the index once they are a quarter of it."""
        unused = self.left[self.live] > 0
        if 4 * np.count_nonzero(unused) > 3 * len(self.live):
            return
        stay = unused[self.postings]
        self.starts = np.append(0, np.cumsum(stay))[self.starts]
        self.postings, self.weights = (np.cumsum(unused) - 1)[self.postings[stay]], self.weights[stay]
        self.table, self.live = [w[unused] for w in self.table], self.live[unused]

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by BM25 score for all the seed's terms, best first, then the others in order."""
        self._shrink()
        at = np.searchsorted(self.names, self.terms[seed])
        rows = self.row[at]
        score = np.zeros(len(self.live), np.float32)
        for row in rows[rows >= 0].tolist():
            score += self.table[row]
        first, last = self.starts[at], self.starts[at + 1]
        some = last - first
        spans = np.repeat(last - np.cumsum(some), some) + np.arange(some.sum())
        score = score + np.bincount(self.postings[spans], self.weights[spans], len(score))
        unused = np.flatnonzero((self.left[self.live] > 0) & (self.live != seed))
        score, unused = score[unused], self.live[unused]
        best = np.ones(len(score), bool)
        if len(score) > 2 * self.FIRST:
            best = score >= np.partition(score, -self.FIRST)[-self.FIRST]
        for part in (best, ~best):
            yield from unused[part][np.argsort(-score[part], kind="stable")].tolist()

    def _cut(self, doc: int, most: int) -> tuple[int, int, int]:
        length = int(min(self.left[doc], most))
        start = int(self.taken[doc])
        self.taken[doc] += length
        self.left[doc] -= length
        return doc, start, length

    def sequences(self):
        """Lists of (document, start in its rest, length) that fill a window; at the end, powers of two."""
        total, seed = int(self.left.sum()), None
        while total >= self.window:
            if seed is None or not self.left[seed]:
                while not self.left[self.order]:
                    self.order += 1
                seed = self.order
            pieces, room = [self._cut(seed, self.window)], self.window
            room -= pieces[0][2]
            if room:
                for doc in self.neighbours(seed):
                    pieces.append(self._cut(doc, room))
                    room -= pieces[-1][2]
                    if not room:
                        break
            total -= self.window
            seed = pieces[-1][0]  # what a cut left over seeds the next window
            yield pieces
        rest = [int(d) for d in np.flatnonzero(self.left)]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            pieces = []
            while room:
                pieces.append(self._cut(rest[0], room))
                room -= pieces[-1][2]
                if not self.left[rest[0]]:
                    rest.pop(0)
            yield pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    window: int = 1024,
    tokenizer: str = "byte_bpe_50k",
    shard_docs: int = 2000,
) -> DataFrame:
    """One row per piece of a document in a sequence: PIECES.

    A document is the ids of its text and a closing id 0; a null text counts as empty, so every row gives an id at least.
    A document's whole windows are sequences of their own. The rest of a seed document opens a window, and its unused
    neighbours, by BM25 over the seed's terms, fill it; the last is cut, and what is left of it seeds the next window.
    Every id lies in exactly one piece. What remains of a shard at the end is less than a window and is cut to powers of
    two, which need no padding. Rows that repeat an id are documents of their own. Other columns are not read; an empty
    table gives an empty table; a null id stays null. Equal tables give equal rows, however they are partitioned.

    Statistics cover all documents and are bounded by the vocabulary; a shard, about `shard_docs` documents that are near
    by signature, is packed at once, and copies beyond a shard's size go to the next. `sequence_id` is the number of the
    shard's group times 2**32 plus the sequence's number there.
    """
    tokens = checkpointed(tokenised(docs, window, tokenizer))
    idf, mean = _term_weights(tokens)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def packed(rows: pa.Table, sequence: int, out: list) -> int:
        columns = {c: rows.column(c).to_pylist() for c in ("doc_id", "tokens", "full", "rest", "terms", "counts")}
        ids, lengths = columns["doc_id"], columns["tokens"]
        for doc_id, length, full in zip(ids, lengths, columns["full"]):
            for k, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
                out.append((doc_id, k * window, window, crc, length, sequence, 0))
                sequence += 1
        rests = [_wide(x, n % window) for x, n in zip(columns["rest"], lengths)]
        terms = [np.frombuffer(x, "<u4") for x in columns["terms"]]
        counts = [_wide(x, len(t)) for x, t in zip(columns["counts"], terms)]
        shard = Shard(np.array(lengths), rests, terms, counts, idf, mean, window)
        for pieces in shard.sequences():
            offset = 0
            for doc, start, length in pieces:
                crc = zlib.crc32(rests[doc][start : start + length].tobytes())
                out.append((ids[doc], lengths[doc] - lengths[doc] % window + start, length, crc, lengths[doc], sequence, offset))
                offset += length
            sequence += 1
        return sequence

    def pack(batches):
        now, sequence = None, 0
        for group, rows in in_shards(batches):
            if group != now:
                now, sequence = group, group << 32
            out: list[tuple] = []
            sequence = packed(rows, sequence, out)
            for at in range(0, len(out), 10_000):
                yield record(schema, [list(c) for c in zip(*out[at : at + 10_000])])

    return _shards(tokens, shard_docs).mapInArrow(pack, PIECES)
