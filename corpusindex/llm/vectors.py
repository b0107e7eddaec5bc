"""Embedding near-dedup: a flat graph, built and pruned on overlapping shards of clusters, searched by range.

A label's vectors are dealt to shards around centroids, each vector to those of its nearest centroids; large shards are
divided again. A shard links its points to near ones and to far ones that no kept neighbour stands for (robust pruning). A
point's neighbours in the whole graph are the union of its lists in its shards: they are never put in one place; instead a
search that comes upon a point in one shard goes on in the point's other shards. A search begins at the shard's medoid,
goes greedily towards its vector and then expands over all points within range. All cosines are computed in double
precision, so that only true links count.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import checkpointed, dealt, grouped, record, shuffle_partitions
from corpusindex.llm.graph import connected_components, local_roots

#: Neighbours kept of the POOL nearest points and of far ones, and the pruning factor.
NEAR, FAR, POOL, ALPHA = 12, 8, 32, 1.2
#: Candidates that a greedy search holds, its steps, and by how much the range expands beyond the links' angle.
BEAM, STEPS, WIDER = 8, 24, 1.3
#: Vectors searched at once, and the share of a shard in range from which on a search looks at the whole shard.
AT_ONCE, DENSE = 256, 1 / 16
#: Visitors of a shard, or members of a cell, that meet it in one task.
SLICE = 1 << 15


def _unit(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _valid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, digest, unit): labelled vectors of finite components and some length, at length 1."""
    schema = pa.schema(
        [("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("digest", pa.string()), ("unit", pa.binary())]
    )

    def scan(batches):
        for batch in batches:
            rows = []
            for vec_id, vector, label in zip(*(c.to_pylist() for c in batch.columns)):
                if vec_id is None or label is None or not vector or any(x is None for x in vector):
                    continue
                x = np.array(vector, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max()
                    scaled = x / top if top else x
                    norm = np.sqrt((scaled * scaled).sum())
                if np.isfinite(x).all() and norm > 0:
                    raw = (scaled / norm).tobytes()
                    rows.append((vec_id, label, len(x), hashlib.blake2b(raw, digest_size=16).hexdigest(), raw))
            if rows:
                yield record(schema, [list(c) for c in zip(*rows)])

    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col, F.col(label_col).cast("string").alias("label"))
    return picked.mapInArrow(scan, "vec_id long, label string, dim int, digest string, unit binary")


def hosted(batches, keys: int, kind: str = "kind"):
    """(host, guests) of sorted batches: the first row of each group by the first `keys` columns, of kind 0, and its other
    rows batch by batch. A group without a host is passed over."""
    now, host = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])
        kinds = batch.column(kind).to_numpy()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            key = tuple(batch.column(i)[a].as_py() for i in range(keys))
            if key != now:
                now, host = key, batch.slice(a, 1) if kinds[a] == 0 else None
                a += host is not None
            if host is not None and a < b:
                yield host, batch.slice(a, b - a)


def _met(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys`, hosts before guests, for `hosted`."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "kind")


# --- shards -------------------------------------------------------------------------------------------------------------

PLACE = "label string, dim int, cell long"
MEMBER = f"{PLACE}, home boolean, pid long, rep long, weight long, unit binary"
KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in ddl.split(", ")])


def means(unit: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of length 1 of `k` clusters, from rows in a fixed random order."""
    centres = unit[np.random.default_rng(3).permutation(len(unit))[:k]].copy()
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = unit[near == c].mean(axis=0)
                if np.linalg.norm(mean) > 1e-9:
                    centres[c] = mean / np.linalg.norm(mean)
    return centres


def _divided(members: DataFrame, big: DataFrame, shard_rows: int, fanout: int, per_cell: int = 32) -> DataFrame:
    """`members` with those of the `big` cells (label, dim, cell, n) dealt to new cells around centroids.

    Centroids, `fanout` at most, are fitted on a sample of about `per_cell` members each; a cell's centroids meet its
    members in slices. A member at home goes to the cells of its two nearest centroids, at home in the first; others go to
    the nearest.
    """
    place = ["label", "dim", "cell"]
    big = big.withColumn("k", F.least(F.lit(fanout), F.ceil(F.col("n") / shard_rows)).cast("int"))
    big = big.withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    inside = members.join(big, place)
    chance = F.pmod(F.xxhash64(F.lit(11), "pid", "cell"), F.lit(1 << 30)) / float(1 << 30)
    sample = inside.where(chance < per_cell * F.col("k") / F.col("n")).select(*place, "pid", "unit", "k")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        first = {c: [frame[c].iloc[0]] for c in place}
        return pd.DataFrame(first | {"centres": [means(_unit(list(frame["unit"])), int(frame["k"].iloc[0])).tobytes()]})

    fitted = sample.groupBy(*place).applyInPandas(fit, f"{PLACE}, centres binary")
    slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    rest = ["home", "pid", "rep", "weight"]
    hosts = fitted.join(big, place).select(*place, slices, F.lit(0).alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("home", "boolean"), ("pid", "long"), ("rep", "long"), ("weight", "long"))], F.col("centres").alias("unit"))
    guests = inside.select(*place, F.pmod(F.xxhash64("pid"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), *rest, "unit")
    schema = arrow_schema(MEMBER)

    def assign(batches):
        for host, rows in hosted(batches, 4):
            unit = _unit(rows.column("unit").to_pylist())
            centres = np.frombuffer(host.column("unit")[0].as_py(), np.float64).reshape(-1, unit.shape[1])
            sims = unit @ centres.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            home = rows.column("home").to_numpy(zero_copy_only=False)
            base = np.uint64(host.column("cell")[0].as_py() & (1 << 64) - 1)
            for turn in range(order.shape[1]):
                some = np.flatnonzero(home) if turn else np.arange(len(home))
                child = (base + order[some, turn].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                child ^= child >> np.uint64(29)
                taken = rows.take(pa.array(some))
                at_home = home[some] if not turn else np.zeros(len(some), bool)
                yield record(schema, [taken.column("label"), taken.column("dim"), pa.array(child.view(np.int64)), pa.array(at_home), *(taken.column(c) for c in ("pid", "rep", "weight", "unit"))])

    moved = _met(hosts.unionByName(guests), *place, "slice").mapInArrow(assign, MEMBER)
    return members.join(big.select(*place), place, "left_anti").select(*moved.columns).unionAll(moved)


def _sharded(points: DataFrame, shard_rows: int, fanout: int, levels: int) -> DataFrame:
    """MEMBER rows: a label is one cell, and cells of more than twice `shard_rows` points are divided, `levels` times at most."""
    root = F.xxhash64("label", "dim").alias("cell")
    members = points.select("label", "dim", root, F.lit(True).alias("home"), "pid", "rep", "weight", "unit")
    for _ in range(levels):
        big = members.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows)
        big = checkpointed(big)
        if not big.take(1):
            break
        members = checkpointed(_divided(members, big, shard_rows, fanout))
    return members


# --- the graph ----------------------------------------------------------------------------------------------------------


def _kept(unit: np.ndarray, own: np.ndarray, candidates: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Robust pruning: of each row's candidates, nearest first, those that no kept one is ALPHA times nearer to; -1 pads."""
    near = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
    vectors = unit[candidates]
    between = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("bid,bjd->bij", vectors, vectors)))
    alive = candidates != own[:, None]
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out, count = np.full((len(own), keep), -1, np.int32), np.zeros(len(own), int)
    for j in range(candidates.shape[1]):
        taken = alive[:, j] & (count < keep)
        out[np.flatnonzero(taken), count[taken]] = candidates[taken, j]
        count += taken
        alive[:, j + 1 :] &= ~(taken[:, None] & (ALPHA * between[:, j, j + 1 :] <= near[:, j + 1 :]))
    return out


def pruned_graph(unit: np.ndarray) -> np.ndarray:
    """Neighbours of each point, both ways, padded with -1: pruned ones of the nearest and of some far points."""
    n = len(unit)
    pool, far = min(POOL, n - 1), min(2 * FAR, n - 1)
    forward = np.full((n, NEAR + FAR), -1, np.int32)
    random = np.random.default_rng(5)
    for a in range(0, n if pool else 0, AT_ONCE):
        own = np.arange(a, min(n, a + AT_ONCE))
        sims = unit[own] @ unit.T
        sims[np.arange(len(own)), own] = -np.inf
        nearest = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        distant = random.integers(0, n, (len(own), far))
        for candidates, columns in ((nearest, slice(0, NEAR)), (distant, slice(NEAR, NEAR + FAR))):
            found = np.take_along_axis(sims, candidates, 1)
            order = np.lexsort((candidates, -found), axis=1)
            candidates, found = np.take_along_axis(candidates, order, 1), np.take_along_axis(found, order, 1)
            forward[own, columns] = _kept(unit, own, candidates, found, columns.stop - columns.start)
    # the way back, as many as there are ways forth, nearest neighbours first
    source, rank = np.nonzero(forward >= 0)
    target = forward[source, rank]
    order = np.lexsort((source, rank, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full_like(forward, -1)
    some = place < forward.shape[1]
    back[target[some], place[some]] = source[some]
    return np.concatenate([forward, back], axis=1)


def _looked_at(seen: np.ndarray, query: np.ndarray, unit: np.ndarray, q: np.ndarray, p: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Computes the cosines of the pairs (query, point) that were not looked at before, and returns those pairs."""
    keys = np.unique(q * seen.shape[1] + p)
    keys = keys[np.isneginf(seen.ravel()[keys])]
    q, p = keys // seen.shape[1], keys % seen.shape[1]
    for a in range(0, len(keys), at_once):
        some = slice(a, a + at_once)
        seen[q[some], p[some]] = np.einsum("ij,ij->i", query[q[some]], unit[p[some]])
    return q, p


def range_search(query: np.ndarray, entry: np.ndarray, unit: np.ndarray, graph: np.ndarray, medoid: int, least: float) -> np.ndarray:
    """The cosine of each query with every point of the shard that the search looked at, -inf with the others.

    Greedily from the medoid, and from the point `entry` where it is not negative, towards the query with BEAM candidates
    held; then over the neighbours of all points within a range WIDER than the links', until none is new. A query with a
    large part of the shard in range looks at the whole shard.
    """
    b, n = len(query), len(unit)
    seen = np.full((b, n), -np.inf)
    starts = np.stack([np.full(b, medoid), np.where(entry < 0, medoid, entry)], axis=1)
    _looked_at(seen, query, unit, np.repeat(np.arange(b), 2), starts.ravel())
    ids = np.full((b, BEAM), -1)
    ids[:, :2] = starts
    ids[entry == medoid, 1] = -1
    sims = np.where(ids >= 0, np.take_along_axis(seen, np.maximum(ids, 0), 1), -np.inf)
    fresh = ids >= 0
    rows = np.arange(b)
    for _ in range(STEPS):
        open_ = np.where(fresh, sims, -np.inf)
        best = open_.argmax(axis=1)
        going = np.flatnonzero(np.isfinite(open_[rows, best]))
        if not len(going):
            break
        fresh[going, best[going]] = False
        around = graph[ids[going, best[going]]]
        q, column = np.nonzero(around >= 0)
        new_q, new_p = _looked_at(seen, query, unit, going[q], around[q, column])
        if not len(new_q):
            continue
        # the new points of each query beside those it holds; the best BEAM stay
        first = np.searchsorted(new_q, new_q)
        wide = np.full((b, BEAM + int((np.arange(len(new_q)) - first).max()) + 1), -1)
        wide[:, :BEAM] = ids
        wide[new_q, BEAM + np.arange(len(new_q)) - first] = new_p
        held = np.where(wide >= 0, np.take_along_axis(seen, np.maximum(wide, 0), 1), -np.inf)
        unread = np.concatenate([fresh, np.ones((b, wide.shape[1] - BEAM), bool)], axis=1) & (wide >= 0)
        top = np.argsort(-held, axis=1, kind="stable")[:, :BEAM]
        ids, sims, fresh = (np.take_along_axis(x, top, 1) for x in (wide, held, unread))
    wider = math.cos(min(math.pi, WIDER * math.acos(min(1.0, max(-1.0, least)))))
    whole = np.zeros(b, bool)
    q, p = np.nonzero(seen >= wider)
    while len(q):
        dense = ~whole & ((seen >= least).sum(axis=1) > max(POOL, n * DENSE))
        if dense.any():
            seen[dense] = query[dense] @ unit.T
            whole |= dense
            q, p = q[~whole[q]], p[~whole[q]]
        around = graph[p]
        at, column = np.nonzero(around >= 0)
        q, p = _looked_at(seen, query, unit, q[at], around[at, column])
        inside = seen[q, p] >= wider
        q, p = q[inside], p[inside]
    return seen


INDEX = f"{PLACE}, part int, pids binary, reps binary, weights binary, homes binary, cells binary, units binary, graph binary, medoid int"


def _indexed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """INDEX: one row for each part of a cell, its points and their graph; every point is in it."""
    cells = members.groupBy("pid").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    rows = members.join(parts, ["label", "dim", "cell"]).join(cells, "pid")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
    schema = arrow_schema(INDEX)

    def build(batches):
        for key, table in grouped(batches, 4):
            pids = table.column("pid").to_numpy()
            order = np.argsort(pids)
            unit = _unit(table.column("unit").to_pylist())[order]
            lists = table.column("cells").to_pylist()
            cells = np.zeros((len(order), max(map(len, lists))), np.int64)
            for i, at in enumerate(order.tolist()):
                cells[i, : len(lists[at])] = lists[at]
            middle = unit.mean(axis=0)
            columns = [table.column(c).to_numpy()[order].astype(np.int64).tobytes() for c in ("rep", "weight", "home")]
            values = [*key, pids[order].tobytes(), *columns, cells.tobytes(), unit.tobytes(), pruned_graph(unit).tobytes(), int((unit @ middle).argmax())]
            yield record(schema, [[v] for v in values])

    picked = rows.select("label", "dim", "cell", "part", "pid", "rep", "weight", "home", "cells", "unit")
    return dealt(picked, "label", "dim", "cell", "part").mapInArrow(build, INDEX)


FOUND = "kind int, a long, b long, n long"
LINKS, STAR, WANTED = 0, 1, 2


def _searched(index: DataFrame, visits: DataFrame, least: float) -> DataFrame:
    """FOUND rows of the visits (label, dim, cell, part, slice, pid, rep, entry, cells, unit) to the parts of cells.

    LINKS: point a has links of weight n with points at home in the part. STAR: the points named a and b are connected.
    WANTED: point a has a link with point n, which also stands in cell b, where a has not been.
    """
    place = ["label", "dim", "cell", "part", "slice"]
    many = visits.groupBy(*place[:4]).agg(F.max("slice").alias("last"))
    blobs = ["pids", "reps", "weights", "homes", "cellsof", "units", "graph"]
    hosts = index.withColumnRenamed("cells", "cellsof").join(many, place[:4])
    hosts = hosts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        *place, F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("pid", "rep", "entry")], F.lit(None).cast("array<bigint>").alias("cells"),
        F.lit(None).cast("binary").alias("unit"), *blobs, "medoid",
    )
    guests = visits.select(
        *place, F.lit(1).alias("kind"), "pid", "rep", "entry", "cells", "unit", *[F.lit(None).cast("binary").alias(c) for c in blobs], F.lit(None).cast("int").alias("medoid")
    )
    schema = arrow_schema(FOUND)

    def rows(kind, a, b, n):
        return record(schema, [np.full(len(a), kind, np.int32), *(pa.array(np.asarray(x, np.int64)) for x in (a, b, n))])

    def search(batches):
        opened, shard = None, None
        for host, guests in hosted(batches, 5):
            if host is not opened:
                opened, blob = host, {c: host.column(c)[0].as_py() for c in blobs}
                pids, reps, weights, homes = (np.frombuffer(blob[c], np.int64) for c in blobs[:4])
                unit = np.frombuffer(blob["units"], np.float64).reshape(len(pids), -1)
                graph = np.frombuffer(blob["graph"], np.int32).reshape(len(pids), -1)
                sets, combo = np.unique(np.frombuffer(blob["cellsof"], np.int64).reshape(len(pids), -1), axis=0, return_inverse=True)
                shard = (pids, reps, weights * homes, unit, graph, sets, combo.ravel(), host.column("medoid")[0].as_py())
            for a in range(0, guests.num_rows, AT_ONCE):
                yield from visited(guests.slice(a, AT_ONCE), *shard)

    def visited(guests, pids, reps, at_home, unit, graph, sets, combo, medoid):
        q_pids, q_reps, entry = (guests.column(c).to_numpy() for c in ("pid", "rep", "entry"))
        at = np.minimum(np.searchsorted(pids, entry), len(pids) - 1)
        own = np.minimum(np.searchsorted(pids, q_pids), len(pids) - 1)
        seen = range_search(_unit(guests.column("unit").to_pylist()), np.where(pids[at] == entry, at, -1), unit, graph, medoid, least)
        hit = seen >= least
        itself = np.flatnonzero(pids[own] == q_pids)
        hit[itself, own[itself]] = False
        q, p = np.nonzero(hit)
        if not len(q):
            return
        links = np.bincount(q, at_home[p], len(q_pids)).astype(np.int64)
        some = np.flatnonzero(links)
        yield rows(LINKS, q_pids[some], q_reps[some], links[some])
        # a point that is both query and member is one node
        nodes = np.concatenate([q_reps, reps])
        roots = local_roots(len(nodes), np.concatenate([q, itself]), len(q_pids) + np.concatenate([p, own[itself]]))
        apart = np.flatnonzero(nodes != nodes[roots])
        yield rows(STAR, nodes[apart], nodes[roots[apart]], np.zeros(len(apart)))
        visited_cells = guests.column("cells").to_pylist()
        for k, cells in enumerate(sets):
            of = hit & (combo == k)
            for i in np.flatnonzero(of.any(axis=1)).tolist():
                new = [c for c in cells.tolist() if c and c not in visited_cells[i]]
                if new:
                    yield rows(WANTED, np.full(len(new), q_pids[i]), new, np.full(len(new), pids[of[i].argmax()]))

    return _met(hosts.unionByName(guests), *place).mapInArrow(search, FOUND)


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    shard_rows: int = 1000,
    fanout: int = 64,
    levels: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    Vectors with equal labels link when their cosine, in double precision, is at least `least`; every link counted is
    computed. Vectors that are null or empty, hold null or non-finite components or have no length, and rows with a null
    label or id, link with nothing: their component is their own id. Vectors of different dimension never link. Equal
    directions are one point, weighted by their rows, so copies are neither compared nor stored twice and link with each
    other without a search. Ids that repeat count as rows of their own. Other columns are not read.

    Every point is indexed in its shards and searched in them; where it finds links it goes on to the other shards of the
    points found, until it has been in all. Shards hold about `shard_rows` points: cells are divided `levels` times into
    `fanout` at most, and a cell that stays large is cut into parts by a hash, all of which its points visit. The graph may
    miss links: `audit_recall` holds the counts against brute force.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col, label_col)
    valid = _valid(vectors, id_col, vector_col, label_col)
    points = valid.groupBy("label", "dim", "digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min_by("unit", "vec_id").alias("unit")
    )
    # an id that stands with several vectors names several points
    points = checkpointed(points.withColumn("pid", F.xxhash64("label", "dim", "digest")))
    members = _sharded(points, shard_rows, fanout, levels)
    sizes = checkpointed(members.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / (3 * shard_rows)).cast("int").alias("parts")))
    index = checkpointed(_indexed(members, sizes.drop("n")))
    cells = members.groupBy("pid").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    searched = points.select("label", "dim", "pid", "rep", "unit").join(cells, "pid")
    asked = members.select("pid", "cell", F.col("pid").alias("entry"))
    been, found = asked.select("pid", "cell"), None
    while True:
        visitors = asked.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        visits = asked.join(searched, "pid").join(sizes.select("cell", "parts"), "cell").join(visitors, "cell")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        visits = visits.withColumn("slice", F.pmod(F.xxhash64(F.lit(5), "pid"), F.col("slices")).cast("int"))
        got = checkpointed(_searched(index, visits, least))
        found = got if found is None else found.unionAll(got)
        wanted = got.where(F.col("kind") == WANTED).groupBy(F.col("a").alias("pid"), F.col("b").alias("cell")).agg(F.min("n").alias("entry"))
        asked = checkpointed(wanted.join(been, ["pid", "cell"], "left_anti"))
        if not asked.take(1):
            break
        been = been.unionAll(asked.select("pid", "cell"))
    roots = connected_components(found.where(F.col("kind") == STAR).select("a", "b"))
    counted = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("pid")).agg(F.sum("n").alias("links"))
    labels = (
        points.select("label", "dim", "digest", "rep", "pid", "weight")
        .join(counted, "pid", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            "label", "dim", "digest", F.coalesce("component", "rep").alias("component"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        )
    )
    linked = valid.select("vec_id", "label", "dim", "digest").join(labels, ["label", "dim", "digest"]).select(
        F.col("vec_id").alias("v_id"), "component", "links"
    )
    linked = linked.groupBy("v_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    joined = named.select("vec_id").join(linked, F.col("vec_id") == F.col("v_id"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        F.col("vec_id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def audit_recall(vectors: DataFrame, found: DataFrame, least: float = 0.98, every: int = 50, at_once: int = 512) -> DataFrame:
    """(exact, found, recall) of the link counts of every `every`-th id against brute force over all rows.

    Audited rows meet all rows of their label in blocks of about `at_once` audited rows, which stream past a block; only
    counts leave it.
    """
    valid = checkpointed(_valid(vectors, "vec_id", "embedding", "label"))
    queries = valid.where(F.col("vec_id") % every == 0)
    blocks = queries.groupBy("label", "dim").agg(F.ceil(F.count("*") / at_once).cast("int").alias("blocks"))
    slices = shuffle_partitions(valid.sparkSession)
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    packed = queries.join(blocks, ["label", "dim"]).select("label", "dim", block, "vec_id", "unit").groupBy("label", "dim", "block")
    packed = packed.agg(F.collect_list(F.struct("vec_id", "unit")).alias("queries"))
    hosts = packed.select("label", "dim", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("binary").alias("unit"), "queries")
    rows = valid.join(blocks, ["label", "dim"]).select(
        "label", "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(slices)).cast("int").alias("slice"),
        F.lit(1).alias("kind"), "vec_id", "unit", F.lit(None).cast("array<struct<vec_id:bigint,unit:binary>>").alias("queries"),
    )
    schema = pa.schema([("vec_id", pa.int64()), ("exact", pa.int64())])

    def count(batches):
        for host, guests in hosted(batches, 4):
            asked = host.column("queries")[0].as_py()
            ids = np.array([x["vec_id"] for x in asked])
            hit = _unit([x["unit"] for x in asked]) @ _unit(guests.column("unit").to_pylist()).T >= least
            hit &= ids[:, None] != guests.column("vec_id").to_numpy()[None, :]
            yield record(schema, [pa.array(ids), pa.array(hit.sum(axis=1))])

    exact = _met(hosts.unionByName(rows), "label", "dim", "block", "slice").mapInArrow(count, "vec_id long, exact long")
    exact = exact.groupBy("vec_id").agg(F.sum("exact").alias("exact"))
    joined = exact.join(found.select("vec_id", "n_links"), "vec_id")
    return joined.agg(
        F.sum("exact").alias("exact"), F.sum(F.least("exact", "n_links")).alias("found"),
        F.when(F.sum("exact") > 0, F.sum(F.least("exact", "n_links")) / F.sum("exact")).otherwise(1.0).alias("recall"),
    )
