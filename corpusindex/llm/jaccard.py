"""Exact Jaccard join on word shingles by vertical partitioning.

The global order of shingles is cut into fragments twice. First, by ranges of their hashes, to count in how many texts
each shingle stands: texts of which fewer than the threshold's share of shingles stand elsewhere can link with nothing. The texts left
meet where they share one of their rarest shingles. Each fragment then counts its part of the overlap of every candidate
pair separately, and the parts are summed per pair. Texts with equal sets are one class throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.llm.common import ROW_KEY, checkpointed, dealt, grouped, keyed_rows, record, row_hash, row_key, runs, shuffle_partitions, sliced
from corpusindex.llm.graph import connected_components, local_roots

#: Clusters whose members meet so often that all pairs of members are fewer than twice those meetings.
DENSE = "members * (members - 1) <= 4 * met"
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; of the whole sequence where it is shorter.

    Words are runs of other than ASCII white space, with A-Z lower-cased, which is how bytes are split and lower-cased.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - size + 1
    out = hashes[:count].copy()
    for k in range(1, size):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += hashes[k : k + count]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a whole set: texts with equal sets are one class."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def _members(docs: DataFrame, size: int) -> DataFrame:
    """(id, key, n_shingles, owner): `key` tells texts apart, `owner` is the class, null for a text without words."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("owner", pa.int64())])

    def scan(batches):
        for batch in sliced(batches):
            sets = [shingle_set(t, size) if t else None for t in batch.column(2).cast(pa.binary()).to_pylist()]
            n = [0 if s is None else len(s) for s in sets]
            owners = [class_of(s) if k else None for s, k in zip(sets, n)]
            yield record(schema, [batch.column(0), batch.column(1), n, owners])

    picked = docs.select("id", F.xxhash64("text").alias("key"), "text")
    return picked.mapInArrow(scan, "id long, key long, n_shingles long, owner long")


FRAGMENT_ROW = "fragment int, batch long, places binary, hashes binary, owners binary, sizes binary"
BATCH_ROW = "batch long, fragment int, places binary, hashes binary, spread binary, owners binary, sizes binary"


def _short(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash; the fragment tells the rest that matters."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def whole_hashes(short: np.ndarray, fragment: np.ndarray, fragments: int) -> np.ndarray:
    """A 64-bit key of the low 48 bits of a hash and its fragment, different for different ones of both.

    Of the values that the upper half can have in the fragment, it is the first that ends in the given bits: the hash
    itself where there are 65 536 fragments or more.
    """
    first = -(-(fragment.astype(object) << 32) // fragments) if len(fragment) else fragment
    first = np.array(first, np.uint64)
    upper = first + (((short >> np.uint64(32)) - first) & np.uint64(0xFFFF))
    return (upper << np.uint64(32)) | (short & np.uint64(0xFFFFFFFF))


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as differences, which compress well."""
    return np.diff(places, prepend=places[:0].dtype.type(0)).tobytes()


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint16), dtype=np.int64)


def _fragments(docs: DataFrame, size: int, fragments: int, at_once: int = 1 << 20) -> DataFrame:
    """The shingles of each class, cut into `fragments` equal ranges of hashes: 6 bytes a shingle and its place.

    Texts are taken in batches of about `at_once` shingles; a shingle carries its text's place in the batch, and one
    fragment of the batch carries the classes and set sizes of all its texts. A partition sends a class once, however many
    copies of its text it holds.
    """
    schema = pa.schema([("fragment", pa.int32()), ("batch", pa.int64())] + [(c, pa.binary()) for c in ("places", "hashes", "owners", "sizes")])

    def pack(batch, sets, owners):
        sizes = np.array([len(s) for s in sets], np.int32)
        hashes, places = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        cut = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        order = np.argsort(cut, kind="stable")
        cut, hashes, places = cut[order], hashes[order], places[order]
        edges = runs(cut)
        rows = [[int(cut[a]), batch, _steps(places[a:b]), _short(hashes[a:b]), None, None] for a, b in zip(edges[:-1], edges[1:])]
        rows[batch % len(rows)][4:] = [np.array(owners, np.int64).tobytes(), sizes.tobytes()]
        return record(schema, [list(c) for c in zip(*rows)])

    def scan(batches):
        seen: set[int] = set()
        sets, owners, held = [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                shingles = shingle_set(text, size) if text else ()
                if not len(shingles):
                    continue
                owner = class_of(shingles)
                if owner in seen:
                    continue
                seen.add(owner)
                sets.append(shingles)
                owners.append(owner)
                held += len(shingles)
                if held >= at_once or len(sets) == 1 << 16:
                    yield pack(number, sets, owners)
                    number += 1
                    sets, owners, held = [], [], 0
        if sets:
            yield pack(number, sets, owners)

    return docs.select("text").mapInArrow(scan, FRAGMENT_ROW)


def _shared(packed: DataFrame) -> DataFrame:
    """Per fragment, the shingles that two texts or more hold, with their number, sent back to the texts' batches."""
    schema = pa.schema(
        [("batch", pa.int64()), ("fragment", pa.int32())] + [(c, pa.binary()) for c in ("places", "hashes", "spread", "owners", "sizes")]
    )

    def count(batches):
        for (fragment,), rows in grouped(batches, 1):
            batch, blobs, tables = (rows.column(c).to_pylist() for c in ("batch", "hashes", "owners"))
            ends = np.cumsum([0] + [len(x) // 6 for x in blobs])
            hashes = _long(b"".join(blobs))
            order = np.argsort(hashes, kind="stable")
            ordered = hashes[order]
            lengths = np.diff(runs(ordered))
            spread = np.empty(len(hashes), np.int32)
            spread[order] = np.repeat(lengths, lengths)
            out = []
            for i, steps in enumerate(rows.column("places").to_pylist()):
                some = slice(ends[i], ends[i + 1])
                several = spread[some] > 1
                if several.any() or tables[i] is not None:
                    places = _places(steps)[several].astype(np.uint16)
                    out.append(
                        (
                            batch[i],
                            fragment,
                            _steps(places),
                            _short(hashes[some][several]),
                            spread[some][several].tobytes(),
                            tables[i],
                            rows.column("sizes")[i].as_py(),
                        )
                    )
            if out:
                yield record(schema, [list(c) for c in zip(*out)])

    return packed.mapInArrow(count, BATCH_ROW)


def _at_least(n, percent: int):
    """The smallest overlap with which a set of `n` can reach the threshold."""
    return -(-(n * percent) // 100)


def _candidates(shared: DataFrame, percent: int, fragments: int) -> DataFrame:
    """(owner, size, prefix, hashes): classes that may link, shared shingles in the global order, rarest first.

    Shingles that stand nowhere else come first in that order and can't match, so of the usual prefix only `prefix`
    shared shingles are left; classes where none is left can link with nothing.
    """
    schema = pa.schema([("owner", pa.int64()), ("size", pa.int32()), ("prefix", pa.int32()), ("hashes", pa.binary())])

    def gather(batches):
        for _, rows in grouped(batches, 1):
            owners, sizes = (b"".join(x for x in rows.column(c).to_pylist() if x) for c in ("owners", "sizes"))
            owners, sizes = np.frombuffer(owners, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
            places = np.concatenate([_places(x) for x in rows.column("places").to_pylist()])
            spread = np.frombuffer(b"".join(rows.column("spread").to_pylist()), np.int32)
            blobs = rows.column("hashes").to_pylist()
            cuts = rows.column("fragment").to_numpy()
            hashes = np.concatenate([whole_hashes(_long(x), np.full(1, f), fragments) for x, f in zip(blobs, cuts)])
            prefix = np.bincount(places, minlength=len(owners)) - _at_least(sizes, percent) + 1
            keep = prefix[places] > 0
            places, hashes, spread = places[keep], hashes[keep], spread[keep]
            order = np.lexsort((hashes, spread, places))
            places, hashes = places[order], hashes[order]
            edges = runs(places)
            out = [
                (int(owners[places[a]]), int(sizes[places[a]]), int(prefix[places[a]]), hashes[a:b].tobytes())
                for a, b in zip(edges[:-1], edges[1:])
            ]
            if out:
                yield record(schema, [list(c) for c in zip(*out)])

    found = shared.mapInArrow(gather, "owner long, size int, prefix int, hashes binary")
    # copies of a text in several batches give the same row
    return found.dropDuplicates(["owner"])


def _postings(live: DataFrame) -> DataFrame:
    """(hash, owner, size, place, rest, prior): the prefix of each class; `rest` counts its shared shingles from this one
    on, `prior` is the shingle before it, 0 for the first."""
    schema = pa.schema([(c, pa.int64()) for c in ("hash", "owner", "size", "place", "rest", "prior")])

    def spread(batches):
        for batch in sliced(batches):
            prefixes = batch.column(2).to_numpy().astype(np.int64)
            sets = [np.frombuffer(h, np.int64) for h in batch.column(3).to_pylist()]
            heads = np.concatenate([x[:p] for x, p in zip(sets, prefixes)])
            ends = np.cumsum(prefixes)
            place = np.arange(len(heads)) - np.repeat(ends - prefixes, prefixes)
            prior = np.roll(heads, 1)
            prior[place == 0] = 0
            owner, size, held = (np.repeat(x, prefixes) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array([len(x) for x in sets])))
            yield record(schema, [pa.array(x.astype(np.int64)) for x in (heads, owner, size, place, held - place, prior)])

    picked = live.select("owner", "size", "prefix", "hashes")
    return picked.mapInArrow(spread, ", ".join(f"{c} long" for c in schema.names))


def _clusters(live: DataFrame) -> DataFrame:
    """(owner, component, members, met): the classes that share a prefix shingle with another, directly or through others;
    `met` counts the pairs of the component's members that do so, once for each different set of classes that a shingle has."""
    postings = _postings(live).select("hash", "owner")
    held = postings.groupBy("hash").agg(F.min("owner").alias("b"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("owner")).alias("digest"))
    lists = held.where("n > 1").groupBy("b", "n", "digest").agg(F.min("hash").alias("hash"))
    stars = postings.join(lists, "hash").groupBy(F.col("owner").alias("a"), "b").agg(F.sum(F.col("n") - 1).alias("met"))
    stars = checkpointed(stars)
    nodes = connected_components(stars.select("a", "b"))
    met = stars.join(nodes, F.col("a") == F.col("node")).groupBy("component").agg((F.sum("met") / 2).alias("met"))
    sized = nodes.groupBy("component").agg(F.count("*").alias("members")).join(met, "component")
    return nodes.withColumnRenamed("node", "owner").join(sized, "component")


def whole_groups(batches, keys: int):
    """Tables of the rows of sorted batches that hold all rows of each of their groups by the first `keys` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [table.column(i).to_numpy() for i in range(keys)]
        other = np.zeros(table.num_rows, bool)
        for c in columns:
            other |= c != c[-1]
        last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks()
    if held is not None:
        yield held


def earlier_rows(starts: np.ndarray, at_once: int = 1 << 20):
    """(row, earlier row) of all pairs of rows of a group, where `starts` is the first row of each row's group, in pieces."""
    counts = np.arange(len(starts)) - starts
    ends = np.cumsum(counts)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + at_once)))
        some = counts[low:high]
        row = np.repeat(np.arange(low, high), some)
        within = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        yield row, starts[row] + within
        low = high


PAIR_ROW = "cluster long, left int, right int, a long, b long, need long"
PAIR_TYPES = pa.schema(
    [("cluster", pa.int64()), ("left", pa.int32()), ("right", pa.int32())] + [(c, pa.int64()) for c in ("a", "b", "need")]
)


def _candidate_pairs(live: DataFrame, sparse: DataFrame, percent: int, block: int, longest: int = 4096) -> DataFrame:
    """PAIR_ROW: the pairs of classes (a < b) of `sparse` clusters that share a prefix shingle and can still link.

    A pair's sizes must be near enough, and the shared shingles from the first common one on enough to reach `need`, the
    overlap with which it links; the first one of every pair that links passes, so later ones may be skipped. A shingle
    that many classes hold is split into blocks of about `longest` of them, of which each pair of blocks meets once.
    `left` and `right` are the blocks of about `block` members of the cluster in which the two stand.
    """
    of = sparse.select("owner", F.col("component").alias("cluster"), F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    postings = _postings(live).join(of, "owner")
    postings = postings.withColumn("block", F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int"))
    spread = postings.groupBy("hash").agg(F.ceil(F.count("*") / longest).cast("int").alias("parts"), F.count("*").alias("n"))
    dealt_out = (
        postings.join(spread.where("n > 1"), "hash")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(3), "owner"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "hash", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "owner", "size",
            "rest", "prior", "cluster", "block",
        )
    )

    def meet(batches):
        for rows in whole_groups(batches, 3):
            hashes, low, high, own, owner, size, rest, prior, cluster, blocks = (c.to_numpy() for c in rows.columns)
            change = np.ones(len(hashes), bool)
            change[1:] = (hashes[1:] != hashes[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.maximum.accumulate(np.where(change, np.arange(len(hashes)), 0))
            for x, y in earlier_rows(starts):
                need = -(-(percent * (size[x] + size[y])) // (100 + percent))
                fits = (np.minimum(rest[x], rest[y]) >= need) & (np.minimum(size[x], size[y]) >= need)
                fits &= (low[x] == high[x]) | (own[x] != own[y])
                fits &= (prior[x] != prior[y]) | (prior[x] == 0)
                x, y, need = x[fits], y[fits], need[fits]
                flip = owner[x] > owner[y]
                x, y = np.where(flip, y, x), np.where(flip, x, y)
                both = np.minimum(blocks[x], blocks[y]), np.maximum(blocks[x], blocks[y])
                yield record(PAIR_TYPES, [pa.array(v) for v in (cluster[x], *both, owner[x], owner[y], need)])

    found = dealt(dealt_out, "hash", "low", "high").mapInArrow(meet, PAIR_ROW)
    return found.dropDuplicates(["a", "b"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """The number of values that each pair of sorted sets without repeats has in common."""
    out, low = np.zeros(len(left), np.int64), 0
    lengths = np.array([len(x) for x in sets])
    ends = np.cumsum(lengths[left] + lengths[right])
    while low < len(left):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + at_once)))
        some = np.stack([left[low:high], right[low:high]], axis=1).ravel()
        values = np.concatenate([sets[i] for i in some])
        pair = np.repeat(np.arange(high - low), (lengths[left] + lengths[right])[low:high])
        order = np.lexsort((values, pair))
        values, pair = values[order], pair[order]
        twice = (values[1:] == values[:-1]) & (pair[1:] == pair[:-1])
        out[low:high] = np.bincount(pair[1:][twice], minlength=high - low)
        low = high
    return out


def _pair_links(live: DataFrame, pairs: DataFrame, weights: DataFrame, cuts: int) -> DataFrame:
    """(owner, root, links) of the given pairs: every vertical fragment counts its part of a pair's overlap, parts are summed."""
    place = ["cluster", "left", "right"]
    ends = pairs.select(*place, F.col("a").alias("owner")).unionAll(pairs.select(*place, F.col("b").alias("owner"))).distinct()
    members = ends.join(live.select("owner", "hashes"), "owner").select(*place, "owner", "hashes")
    names = [*place, "cut", "a", "b", "need", "hashes"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    row = "cluster long, left int, right int, cut int, a long, b long, need long, hashes binary"

    def cut(batches):
        for batch in sliced(batches):
            pieces = [piece for h in batch.column(4).to_pylist() for piece in vertical(np.frombuffer(h, np.uint64), cuts)]
            n = batch.num_rows
            head = [pa.array(np.repeat(batch.column(i).to_numpy(), cuts)) for i in range(4)]
            number = pa.array(np.tile(np.arange(cuts, dtype=np.int32), n))
            empty = pa.nulls(n * cuts, pa.int64())
            yield record(schema, [*head[:3], number, head[3], empty, empty, pa.array([x.tobytes() for x in pieces], pa.binary())])

    parts = members.mapInArrow(cut, row)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("cut")
    asked = pairs.select(*place, numbers, "a", "b", "need", F.lit(None).cast("binary").alias("hashes"))
    summed = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int64()), ("overlap", pa.int64())])

    def count(batches):
        for _, rows in grouped(batches, 4):
            a, b, need = (rows.column(c) for c in ("a", "b", "need"))
            member = np.array(b.is_null())
            owners = a.to_numpy()[member]
            order = np.argsort(owners)
            blobs = rows.column("hashes").filter(pa.array(member)).to_pylist()
            sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
            x, y, least = a.to_numpy()[~member], b.drop_null().to_numpy(), need.drop_null().to_numpy()
            found = overlaps(sets, np.searchsorted(owners[order], x), np.searchsorted(owners[order], y))
            some = found > 0
            yield record(summed, [pa.array(v[some]) for v in (x, y, least, found)])

    partial = dealt(parts.unionByName(asked), *place, "cut").mapInArrow(count, "a long, b long, need long, overlap long")
    linked = partial.groupBy("a", "b", "need").agg(F.sum("overlap").alias("overlap")).where("overlap >= need").select("a", "b")
    linked = checkpointed(linked)
    both = linked.unionAll(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighed = both.join(weights.withColumnRenamed("owner", "b"), "b")
    return weighed.groupBy(F.col("a").alias("owner"), F.least("a", "b").alias("root")).agg(F.sum("weight").cast("long").alias("links"))


def vertical(hashes: np.ndarray, cuts: int) -> list[np.ndarray]:
    """A set cut into `cuts` equal ranges of hashes, sorted."""
    hashes = np.sort(hashes)
    return np.split(hashes, np.searchsorted(hashes, np.array([(k << 64) // cuts for k in range(1, cuts)], np.uint64)))


PART_ROW = "cluster long, left int, right int, cut int, owner long, size int, weight long, side int, hashes binary"
SUM_ROW = "cluster long, left int, right int, owners binary, sizes binary, weights binary, sides binary, pairs binary, overlap binary"


def _blocks(live: DataFrame, clusters: DataFrame, weights: DataFrame, block: int, cuts: int) -> DataFrame:
    """The members of each dense cluster dealt to pairs of blocks and vertical fragments: PART_ROW.

    Blocks of about `block` members are by hash of the class, so a large cluster is spread over many tasks; its pairs of
    blocks cover every pair of members once.
    """
    narrow = clusters.select("owner", "component", "members").join(weights, "owner")
    placed = (
        live.join(narrow, "owner")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("component").alias("cluster"),
            F.least("own", "other").alias("left"),
            F.greatest("own", "other").alias("right"),
            "owner",
            "size",
            "weight",
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
            "hashes",
        )
    )
    names = ["cluster", "left", "right", "cut", "owner", "size", "weight", "side", "hashes"]

    def cut(batches):
        for batch in sliced(batches):
            rows = batch.to_pylist()
            out = []
            for r in rows:
                for k, piece in enumerate(vertical(np.frombuffer(r["hashes"], np.uint64), cuts)):
                    out.append([r[c] if c != "cut" else k for c in names[:-1]] + [piece.tobytes()])
            columns = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return placed.mapInArrow(cut, PART_ROW)


def _partial_overlaps(parts: DataFrame, at_once: int = 4096) -> DataFrame:
    """For each pair of blocks and fragment, the number of the fragment's shingles that each pair of members shares."""
    types = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
    names = ["cluster", "left", "right", "owners", "sizes", "weights", "sides", "pairs", "overlap"]

    def count(batches):
        for key, rows in grouped(batches, 4):
            owners = rows.column("owner").to_numpy()
            order = np.argsort(owners, kind="stable")
            blobs = rows.column("hashes").to_pylist()
            sets = [np.frombuffer(blobs[i], np.uint64) for i in order]
            sizes, weights, sides = (rows.column(c).to_numpy()[order] for c in ("size", "weight", "side"))
            columns, at = np.unique(np.concatenate(sets), return_inverse=True)
            of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            shared = np.bincount(at, minlength=len(columns)) > 1
            number = np.cumsum(shared) - 1
            keep = shared[at]
            at, of = number[at[keep]], of[keep]
            by = np.argsort(at, kind="stable")
            at, of = at[by], of[by]
            overlap = np.zeros((len(sets), len(sets)), np.float32)
            for low in range(0, int(shared.sum()), at_once):
                a, b = np.searchsorted(at, (low, low + at_once))
                has = np.zeros((len(sets), at_once), np.float32)
                has[of[a:b], at[a:b] - low] = 1
                overlap += has @ has.T
            found = np.flatnonzero(np.triu(overlap, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(
                    [*key[:3], owners[order].tobytes(), sizes.astype(np.int32).tobytes(), weights.astype(np.int64).tobytes(),
                     sides.astype(np.int32).tobytes(), found.astype(np.int32).tobytes(),
                     overlap.ravel()[found].astype(np.int32).tobytes()], types)],
                names=names,
            )

    return parts.mapInArrow(count, SUM_ROW)


def _links(partial: DataFrame, percent: int) -> DataFrame:
    """(owner, root, links): parts of the overlaps summed per pair and held against the threshold.

    `root` is the smallest class reachable within the pair of blocks; `links` the documents of other classes linked
    directly there. A pair within one block of several is counted by the pair (block, block) only.
    """
    schema = pa.schema([("owner", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def total(batches):
        for (_, left, right), rows in grouped(batches, 3):
            first = {c: rows.column(c)[0].as_py() for c in ("owners", "sizes", "weights", "sides")}
            owners, weights = (np.frombuffer(first[c], np.int64) for c in ("owners", "weights"))
            sizes, sides = (np.frombuffer(first[c], np.int32).astype(np.int64) for c in ("sizes", "sides"))
            overlap = np.zeros(len(owners) ** 2, np.int32)
            for pairs, counts in zip(rows.column("pairs").to_pylist(), rows.column("overlap").to_pylist()):
                overlap[np.frombuffer(pairs, np.int32)] += np.frombuffer(counts, np.int32)
            found = np.flatnonzero(overlap)
            a, b, o = found // len(owners), found % len(owners), overlap[found].astype(np.int64)
            linked = 100 * o >= percent * (sizes[a] + sizes[b] - o)
            if left != right:
                linked &= sides[a] != sides[b]
            a, b = a[linked], b[linked]
            roots = local_roots(len(owners), a, b)
            links = np.bincount(a, weights[b], len(owners)) + np.bincount(b, weights[a], len(owners))
            some = np.flatnonzero(links)
            yield record(schema, [pa.array(owners[some]), pa.array(owners[roots[some]]), pa.array(links[some].astype(np.int64))])

    return partial.mapInArrow(total, "owner long, root long, links long")


def _classified(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block: int, cuts: int, fragment_shingles: int
) -> DataFrame:
    """(id, key, n_shingles, owner, label, weight, links) of each row; rows with equal labels are one group."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    members = checkpointed(_members(docs, size))
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(shuffle_partitions(spark), math.ceil(shingles / fragment_shingles))
    packed = dealt(_fragments(docs, size, fragments), "fragment")
    live = checkpointed(_candidates(dealt(_shared(packed), "batch"), percent, fragments))
    classes = members.where("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("weight"))
    clusters = checkpointed(_clusters(live))
    # where most members share shingles with most others, blocks of them are counted whole; else the pairs that meet are
    parts = dealt(_blocks(live, clusters.where(DENSE), classes, block, cuts), "cluster", "left", "right", "cut")
    links = _links(dealt(_partial_overlaps(parts), "cluster", "left", "right"), percent)
    sparse = clusters.where(f"NOT ({DENSE})")
    if sparse.take(1):
        pairs = checkpointed(_candidate_pairs(live, sparse, percent, block))
        links = links.unionAll(_pair_links(live, pairs, classes, cuts))
    links = checkpointed(links)
    roots = connected_components(links.select(F.col("owner").alias("a"), F.col("root").alias("b")))
    labels = (
        links.groupBy("owner").agg(F.sum("links").alias("links"))
        .join(roots, links.owner == roots.node, "left")
        .select("owner", F.coalesce("component", "owner").alias("root"), "links")
    )
    classed = members.join(classes, "owner", "left").join(labels, "owner", "left")
    return classed.withColumn("label", F.coalesce("root", "owner"))


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    block: int = 2048,
    cuts: int = 4,
    fragment_shingles: int = 1_000_000,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable by links), n_links.

    Two rows link when 100 * |A & B| >= percent * |A | B| of their sets of `size`-word shingles; words are runs of other
    than ASCII white space with A-Z lower-cased, and a text of fewer words is one shingle. A text without words (null or
    empty) has no shingles and links with nothing: its component is its own id. `n_links` counts other rows linked
    directly; rows with equal sets link. Rows that repeat an id count each. Null ids take part but never name a component.
    Ids must be integers; other columns are not read. The result is exact but for collisions of hashes: shingles are told
    apart by 48 bits and their fragment, which makes 64 bits from 65 536 fragments on; a collision adds 1 to an overlap.

    Memory: a task holds one fragment (about `fragment_shingles` shingles, and all places of its most frequent shingle; a
    batch of texts sends a shingle once per text and a partition once per class) or one pair of blocks (2 * `block` members).
    """
    classed = _classified(docs, id_col, text_col, size, percent, block, cuts, fragment_shingles)
    heads = classed.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component_id"))
    return classed.join(heads, "label", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component_id", "id").alias("component_id"),
        F.when(F.col("owner").isNull(), 0).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, of which one of each group of linked rows stays: that with the smallest id.

    Of rows with that id the one with the smallest hash of the text stays, then of the whole row, and one of equal rows.
    Rows without words are linked with nothing and stay.
    """
    classed = _classified(docs, "doc_id", "text", size, percent, 2048, 4, 1_000_000)
    heads = classed.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("head"))
    heads = heads.select(*row_key(F.col("head.id"), F.col("head.key")), F.lit(False).alias("wordless"))
    wordless = classed.where("label IS NULL").select(*row_key(F.col("id"), F.col("key")), F.lit(True).alias("wordless")).distinct()
    kept = keyed_rows(docs).join(heads.unionAll(wordless), list(ROW_KEY))
    number = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("tie"))
    kept = kept.withColumn("tie", row_hash())
    return kept.withColumn("number", number).where("wordless OR number = 1").select("row.*")
