"""Substring dedup: runs of consecutive sentences that stand elsewhere before are removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import dealt, grouped, record, runs, shuffle_partitions, sliced

SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")
LETTER = re.compile(r"\w")
TOKEN = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xD6E8FEB86659FD93
#: Words among which a long sentence is cut before the one of least hash; 3 parts then fit in any 52 words of it.
NEAR = 9


def cut_places(words: list[str], near: int = NEAR) -> list[int]:
    """Words before which a long sentence is cut: the last one of least hash among every `near` consecutive words.

    A place depends on less than `near` words to each side only, and parts have at most `near` words, so equal passages
    get equal parts wherever they stand.
    """
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    out, at = [], -1
    for start in range(len(hashes) - near + 1):
        end = start + near - 1
        if at < start:
            at = min(range(start, end + 1), key=lambda i: (hashes[i], -i))
        elif hashes[end] <= hashes[at]:
            at = end
        else:
            continue
        if at:
            out.append(at)
    return out


def sentences(text: str, longest: int) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence with a letter or digit; one of more than `longest` words is cut at `cut_places`.

    A sentence ends with a run of full stops, exclamation or question marks, or with its line. Hashes ignore case and
    white space.
    """
    out = []
    for m in SENTENCE.finditer(text):
        piece = m.group()
        words = piece.lower().split()
        if len(words) <= longest:
            if words and LETTER.search(piece):
                out.append((m.start(), m.end(), len(words), xxhash.xxh3_64_intdigest(" ".join(words))))
            continue
        places = [(t.start(), t.end()) for t in TOKEN.finditer(piece)]
        cuts = [0, *cut_places(words, min(NEAR, longest)), len(words)]
        for at, to in zip(cuts[:-1], cuts[1:]):
            part, spots = words[at:to], places[at:to]
            end = m.end() if to == len(words) else m.start() + spots[-1][1]
            out.append((m.start() + spots[0][0], end, len(part), xxhash.xxh3_64_intdigest(" ".join(part))))
    return out


def _powers(count: int, factor: int) -> np.ndarray:
    out = np.full(count, np.uint64(factor))
    out[:1] = 1
    return np.multiply.accumulate(out)


def _run_hash(hashes: np.ndarray, i: np.ndarray, j: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each run i..j of the hashes, by differences of one running sum."""
    n = len(hashes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(n, base), dtype=np.uint64)])
    value = (sums[j + 1] - sums[i]) * _powers(n, pow(base, -1, 1 << 64))[i] + (j - i).astype(np.uint64)
    value ^= value >> np.uint64(29)
    value *= np.uint64(BASE)
    value ^= value >> np.uint64(32)
    return value


def sentence_runs(words: np.ndarray, hashes: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, last sentence and hash, of 64 and 32 bits more, of every shortest run of `run` sentences and `least`
    words, at least.

    A run is the shortest from its first sentence on or the shortest up to its last one.
    """
    n = len(words)
    if n < run:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64), np.empty(0, np.uint32)
    before = np.concatenate([[0], np.cumsum(words)])
    first = np.arange(n)
    last = np.maximum(first + run - 1, np.searchsorted(before, before[:-1] + least) - 1)
    end = np.arange(n)
    start = np.minimum(end - run + 1, np.searchsorted(before, before[1:] - least, side="right") - 1)
    pairs = np.concatenate([(first * n + last)[last < n], (start * n + end)[start >= 0]])
    pairs = np.unique(pairs)
    i, j = pairs // n, pairs % n
    more = _run_hash(hashes ^ (hashes >> np.uint64(31)), i, j, OTHER_BASE)
    return i, j, _run_hash(hashes, i, j, BASE), (more >> np.uint64(32)).astype(np.uint32)


RUN_ROW = "fragment int, hashes binary, more binary, docs binary, firsts binary, lasts binary, dropped binary"


def _packed_runs(docs: DataFrame, run: int, least: int, longest: int, fragments: int, at_once: int = 1 << 19) -> DataFrame:
    """Runs by ranges of their hashes. Of a run that a batch holds more than once only the first place goes on; the others
    are certain to be no first places and go as `dropped`, so a frequent run is sent once per batch."""
    names = ("hashes", "more", "docs", "firsts", "lasts", "dropped")
    schema = pa.schema([("fragment", pa.int32())] + [(c, pa.binary()) for c in names])

    def pack(parts):
        docs, first, last, hashes, more = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((first, docs, more, hashes))
        docs, first, last, hashes, more = docs[order], first[order], last[order], hashes[order], more[order]
        later = np.zeros(len(hashes), bool)
        later[1:] = (hashes[1:] == hashes[:-1]) & (more[1:] == more[:-1])
        # rows that repeat an id are one document
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(hashes))))
        later &= (docs != docs[head]) | (first != first[head])
        gone = np.stack([docs[later], first[later], last[later]]).astype(np.int64)
        docs, first, last, hashes, more = docs[~later], first[~later], last[~later], hashes[~later], more[~later]
        cut = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        edges = runs(cut)
        columns = (hashes, more, docs, first.astype(np.int32), last.astype(np.int32))
        rows = [[int(cut[a]), *(c[a:b].tobytes() for c in columns), None] for a, b in zip(edges[:-1], edges[1:])]
        rows[0][6] = gone.tobytes()
        return record(schema, [list(c) for c in zip(*rows)])

    def scan(batches):
        parts, held = [], 0
        for batch in sliced(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = sentences(text, longest) if text else []
                if len(found) < run or doc_id is None:
                    continue
                words, hashes = np.array([s[2] for s in found]), np.array([s[3] for s in found], np.uint64)
                i, j, value, more = sentence_runs(words, hashes, run, least)
                if len(i):
                    parts.append((np.full(len(i), doc_id, np.int64), i, j, value, more))
                    held += len(i)
                if held >= at_once:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return docs.mapInArrow(scan, RUN_ROW)


def _repeats(packed: DataFrame) -> DataFrame:
    """(k_id, first, last) of every run that is not the first with its hash by id, then place."""
    schema = pa.schema([("k_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def find(batches):
        for _, rows in grouped(batches, 1):
            for gone in rows.column("dropped").to_pylist():
                if gone:
                    d, i, j = np.frombuffer(gone, np.int64).reshape(3, -1)
                    if len(d):
                        yield record(schema, [pa.array(d), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))])
            hashes, more, docs, first, last = (
                np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
                for c, kind in (("hashes", np.uint64), ("more", np.uint32), ("docs", np.int64), ("firsts", np.int32), ("lasts", np.int32))
            )
            order = np.lexsort((first, docs, more, hashes))
            hashes, more, docs, first, last = hashes[order], more[order], docs[order], first[order], last[order]
            head = np.zeros(len(hashes), bool)
            head[:1] = True
            head[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(hashes)), 0))
            later = (docs != docs[at]) | (first != first[at])
            if later.any():
                yield record(schema, [pa.array(docs[later]), pa.array(first[later]), pa.array(last[later])])

    return packed.mapInArrow(find, "k_id long, first int, last int")


def dedup_sentence_spans(
    docs: DataFrame,
    run: int = 3,
    least: int = 12,
    longest: int = 12,
    fragment_runs: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: id, text without repeated spans, n_sentences, n_removed, removed.

    Every run of `run` consecutive sentences (more where they hold fewer than `least` words) is hashed whole; of the places
    of a run all but the first, by id, then place, are repeats, and sentences that a repeat covers are removed. Sentences
    of more than `longest` words are cut by their words into parts that count as sentences. `removed` lists the removed spans of the
    given text as start:end in code points, comma-joined, end exclusive. A text with no full run stays as it is; null
    stays null with 0 sentences. Rows that repeat an id are one document: their common places are not each other's
    repeats. A row with a null id is kept and never searched. Other columns are not read. Runs are told apart by 96 bits.

    Memory: a task holds one fragment of the hash order, some `fragment_runs` runs, and of a frequent run one place for
    each batch of about half a million runs, 32 bytes.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a run begins with every sentence, of which a text has one for some 40 characters at most
    chars = picked.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(4 * shuffle_partitions(docs.sparkSession), chars // (40 * fragment_runs))
    packed = dealt(_packed_runs(picked, run, least, longest, fragments), "fragment")
    repeats = _repeats(packed).groupBy("k_id").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    joined = picked.join(repeats, F.col("id") == F.col("k_id"), "left").select("id", "text", "firsts", "lasts")
    schema = pa.schema(
        [("id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string())]
    )

    def clean(batches):
        for batch in sliced(batches):
            rows = []
            for doc_id, text, firsts, lasts in zip(*(c.to_pylist() for c in batch.columns)):
                found = sentences(text, longest) if text else []
                if not firsts:
                    rows.append((doc_id, text, len(found), 0, ""))
                    continue
                change = np.zeros(len(found) + 1, int)
                np.add.at(change, np.array(firsts), 1)
                np.add.at(change, np.array(lasts) + 1, -1)
                covered = np.cumsum(change)[:-1] > 0
                edges = runs(covered)
                gone, kept, at = [], [], 0
                for a, b in zip(edges[:-1], edges[1:]):
                    if covered[a]:
                        start, end = found[a][0], found[b - 1][1]
                        gone.append(f"{start}:{end}")
                        kept.append(text[at:start])
                        at = end
                kept.append(text[at:])
                rows.append((doc_id, "".join(kept), len(found), int(covered.sum()), ",".join(gone)))
            yield record(schema, [list(c) for c in zip(*rows)])

    cleaned = joined.mapInArrow(clean, "id long, text string, n_sentences long, n_removed long, removed string")
    return cleaned.withColumnsRenamed({"id": id_col, "text": text_col})
