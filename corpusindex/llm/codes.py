"""Short codes for vectors: each vector is cut into parts, each part replaced by its nearest entry of a codebook.

Codebooks come from the vectors themselves: first entries from the smallest ids, then rounds in which every part goes to its
nearest entry and every entry to the mean of its parts. Components are integers and all distances exact. A part starts at the
entry it had before: by the triangle inequality an entry nearer than that one lies within twice its distance of it, so only
that far a list of the entry's neighbours, sorted by distance, is scanned; equal distances go to the lower index.

Vectors stay where they are read. A round writes them with their codes, then adds up each task's sums by entry; what comes
to the driver and goes to the tasks is the codebooks, whose size is `ENTRIES` vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import record, sliced
from corpusindex.sources.store import stored, unstored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Sums of this many bits are added up by Spark, one column value each; a larger sum is several of them.
LIMB = 40
#: A double holds integers up to here exactly.
EXACT = 1 << 52
#: Label sums are joined by as many keys a label, so that a label with most rows is spread.
SPREAD = 32


def usable(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def _integer(x: float) -> int:
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of `width` integer components for each vector, short ones filled up with 0.

    Integral doubles where every squared distance is sure to be exact in them, else Python's integers.
    """
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    largest = np.abs(flat).max(initial=0.0)
    if largest < 2**20 and width * (4 * largest * SCALE + 4) ** 2 < EXACT:
        out = np.zeros((len(sizes), width))
        out[row, place] = np.floor(flat * SCALE)
    else:
        out = np.zeros((len(sizes), width), object)
        out[row, place] = [_integer(x) for x in flat.tolist()]
    return out


def fitting(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two in one kind of number: doubles where both are and distances between them stay exact."""
    if rows.dtype == object or book.dtype == object:
        return rows.astype(object) if rows.dtype == object else _whole(rows), book if book.dtype == object else _whole(book)
    return rows, book


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of `a` and `b`, exact."""
    if a.dtype == object:
        return np.array([[sum((p - q) ** 2 for p, q in zip(x, y)) for y in b] for x in a], object).reshape(len(a), len(b))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the entries by distance from it, then index, and those squared distances."""
    between = squared(book, book)
    order = np.array([sorted(range(len(book)), key=lambda j: (r[j], j)) for r in between.tolist()])
    return order, np.take_along_axis(between, order, 1)


def nearest(rows: np.ndarray, before: np.ndarray, book: np.ndarray, around: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry and squared distance, the search starting at the entry `before`.

    An entry no farther from a row than `before` is at most twice that distance from it, so at most four times in squares.
    """
    order, far = around
    rows, book = fitting(rows, book)
    best = np.zeros(len(rows), np.int64)
    least = np.zeros(len(rows), rows.dtype)
    for start in np.unique(before):
        mine = np.flatnonzero(before == start)
        here = squared(rows[mine], book[start : start + 1])[:, 0]
        reach = np.searchsorted(far[start], 4 * here, "right")
        by_reach = np.argsort(reach, kind="stable")
        for some in np.array_split(by_reach, max(1, len(by_reach) // 256)):
            entries = np.sort(order[start, : reach[some].max(initial=0)])
            distance = squared(rows[mine[some]], book[entries])
            first = distance.argmin(1) if distance.dtype != object else np.array([min(range(len(d)), key=d.__getitem__) for d in distance.tolist()])
            best[mine[some]] = entries[first]
            least[mine[some]] = distance[np.arange(len(some)), first]
    return best, least


def _split(books: list[np.ndarray], rows: np.ndarray):
    width = rows.shape[1] // len(books) if books else 0
    for p in range(len(books)):
        yield p, rows[:, p * width : (p + 1) * width]


def _coder(books: list[np.ndarray], width: int, schema: pa.Schema, final: bool):
    """Batches with new codes; with their errors, and without vectors, where `final`. The columns are row, vector and code."""

    def code(batches):
        around = [neighbours(b) for b in books]
        for batch in sliced(batches):
            rows = integers(batch.column("vector"), width)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(rows), len(books)).astype(np.int64)
            codes, error = np.zeros(old.shape, np.uint8), np.zeros(len(rows), object)
            for p, part in _split(books, rows):
                found, distance = nearest(part, old[:, p], books[p], around[p])
                codes[:, p] = found
                error += np.array([int(d) for d in distance.tolist()], object)
            new = pa.array([c.tobytes() for c in codes], pa.binary())
            if final:
                fits = [e if e < 1 << 63 else None for e in error.tolist()]
                yield record(schema, [batch.column("vec_id"), batch.column("label"), new, fits])
            else:
                yield record(schema, [batch.column("vec_id"), batch.column("label"), batch.column("vector"), new])

    return code


def _limbs(value: int):
    """(place, part) of a sum in parts of LIMB bits, those of a negative one negative."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if value & ((1 << LIMB) - 1):
            yield place, sign * (value & ((1 << LIMB) - 1))
        value, place = value >> LIMB, place + 1


def _adder(parts: int, width: int, schema: pa.Schema):
    """(part, entry, place, limb, value): the sums of a task's parts by entry; place -1 has their number."""

    def add(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in sliced(batches):
            rows = integers(batch.column("vector"), width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(rows), parts)
            for p, part in _split([None] * parts, rows):
                for entry in np.unique(codes[:, p]).tolist():
                    mine = part[codes[:, p] == entry]
                    held = sums.setdefault((p, entry), [0] * (part.shape[1] + 1))
                    held[0] += len(mine)
                    for i, s in enumerate(mine.sum(0).tolist()):
                        held[i + 1] += int(s)
        flat = [(p, e, i - 1, limb, v) for (p, e), held in sums.items() for i, total in enumerate(held) for limb, v in _limbs(total)]
        if flat:
            yield record(schema, [list(c) for c in zip(*flat)])

    return add


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])


def moved(books: list[list[list[int]]], coded: DataFrame, width: int) -> list[list[list[int]]]:
    """The codebooks with each used entry at its parts' mean, rounded down by component."""
    sums = coded.select("vector", "code").mapInArrow(_adder(len(books), width, SUMS), "part int, entry int, place int, limb int, value long")
    sums = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.collect():
        held = total.setdefault((r.part, r.entry), {})
        held[r.place] = held.get(r.place, 0) + (r.value << (LIMB * r.limb))
    return [
        [[held.get(i, 0) // held[-1] for i in range(len(entry))] if (held := total.get((p, e))) else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def _arrays(books: list[list[list[int]]], width: int) -> list[np.ndarray]:
    largest = max((abs(v) for book in books for entry in book for v in entry), default=0)
    kind = np.float64 if width * (4 * largest + 4) ** 2 < EXACT else object
    return [np.array(book, kind).reshape(len(book), -1) for book in books]


def codebooks_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code binary, error) of every usable vector, and the codebooks by part, entry and component.

    Vectors are filled up with 0 to the length of the longest, itself rounded up to a multiple of `parts`. Fewer vectors than
    `entries` give as many entries. Null ids come last among those that give first entries; rows of equal id come in the
    order of their vectors. An error that 64 bits can't hold is null.
    """
    held = stored(embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").alias("vector")))
    longest = held.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    whole = [[_integer(x) for x in r.vector] + [0] * (width - len(r.vector)) for r in first]
    books = [[v[p * width // parts : (p + 1) * width // parts] for v in whole] for p in range(parts)]
    coded = held.withColumn("code", F.lit(bytes(parts)))
    kind = pa.list_(pa.float64() if dict(held.dtypes)["vector"] == "array<double>" else pa.float32())
    between = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("vector", kind), ("code", pa.binary())])
    done = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())])
    for _ in range(rounds if whole else 0):
        now = stored(coded.mapInArrow(_coder(_arrays(books, width), width, between, False), coded.schema))
        unstored(held)
        books, coded, held = moved(books, now, width), now, now
    if not whole:
        return held.select("vec_id", "label", F.lit(bytes(parts)).alias("code"), F.lit(0).cast("long").alias("error")), books
    out = stored(coded.mapInArrow(_coder(_arrays(books, width), width, done, True), "vec_id long, label string, code binary, error long"))
    unstored(held)
    return out, books


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector; other rows and tables without any give none.

    A label's error is null where one of its errors is, or where 64 bits can't hold it.
    """
    rows, books = compressed(embeddings)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when((F.count("*") == F.count("error")) & (total <= (1 << 63) - 1), total.cast("long"))
    labels = stored(rows.groupBy("label").agg(fits.alias("label_error")))
    # a label's sum stands under several keys, of which each row takes one
    key = lambda label, part: F.concat_ws("|", part.cast("string"), F.coalesce(F.concat(F.lit("="), label), F.lit("")))
    labels = labels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    labels = labels.select(key(F.col("label"), F.col("part")).alias("key"), "label_error")
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SPREAD))
    joined = rows.withColumn("key", key(F.col("label"), salt)).join(labels, "key")
    code = F.lower(F.hex("code"))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def codes_sql() -> str:
    """DuckDB's rows of `vector_codes`, for vectors of one length that PARTS divides."""

    def assigned(r: int) -> str:
        return f"""
    a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
        SELECT v.vec_id, v.part, c.entry, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist
        FROM parts v JOIN c{r} c ON c.part = v.part) GROUP BY ALL)"""

    def means(r: int) -> str:
        return f"""
    s{r} AS (SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p.part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS i
             FROM parts p JOIN a{r} a ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY ALL),
    m{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)"""

    steps = ",".join(assigned(r) + "," + means(r) for r in range(ROUNDS))
    return f"""
    WITH raw AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL),
    kept AS (SELECT vec_id, label, [CAST(floor({SCALE} * y) AS BIGINT) for y in x] AS x FROM raw WHERE len([y for y in x if y IS NULL OR NOT isfinite(y)]) = 0),
    parts AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {PARTS} + 1:(part + 1) * len(x) // {PARTS}] AS x FROM kept, range({PARTS}) r(part)),
    c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
    {steps}, {assigned(ROUNDS)},
    digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
    coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""
