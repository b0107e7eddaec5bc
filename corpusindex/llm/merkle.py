"""Merkle manifest of a table of documents, with a proof for every row looked up by coordinates.

A row's leaf is a digest of its fields. The leaves of each language, ascending by id, form a tree in which every `ARITY`
consecutive nodes become one; the roots of the languages form the last tree. A node's place is (tree, level, index). A
leaf's siblings follow from its index and its tree's size alone, so a proof is a join of those coordinates with the table of
nodes, put in order and folded.

Trees are cut into blocks of at most `BLOCK` consecutive nodes: a block's levels are computed in one task, its root is a
leaf of the tier above, and all leaves of a block share what stands above it. No node is looked up by more rows than a block
has, so the nodes near a root are no hot keys, and a language with most rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.operators.order import numbered
from corpusindex.sources.store import stored

ARITY = 2
BLOCK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """A field as it enters a leaf: its length in bytes, a colon and itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]), 256)


def stride(arity: int) -> int:
    """How many levels a block holds."""
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _powers(arity: int) -> Column:
    return F.array(*[F.lit(arity**level).cast("long") for level in range(stride(arity) + 1)])


def _levels(n: Column, arity: int) -> Column:
    """The levels, within a block, of a tree of `n` nodes that have a level above them."""
    powers = _powers(arity)
    return F.filter(F.sequence(F.lit(0), F.lit(stride(arity) - 1)), lambda level: n > F.get(powers, level))


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a quotient of longs that are not negative, without doubles."""
    return F.call_function("div", a, b)


def _nodes(leaves: DataFrame, arity: int) -> DataFrame:
    """(tree, n, level, at, hash): the nodes of every block of `leaves` (tree, n, idx, hash) up to the blocks' roots."""
    block = _whole(F.col("idx"), F.lit(arity ** stride(arity)))
    lists = leaves.groupBy("tree", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("own"))

    def above(nodes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(nodes), F.lit(arity))
        return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, F.lit(arity)), ""), 256))

    first = F.array(F.transform("own", lambda x: x["hash"]))
    levels = F.aggregate(_levels(F.col("n"), arity), first, lambda so_far, _: F.concat(so_far, F.array(above(F.element_at(so_far, -1)))))
    each = lists.select("tree", "n", "block", F.posexplode(levels).alias("level", "hashes"))
    each = each.select("tree", "n", "block", "level", F.posexplode("hashes").alias("i", "hash"))
    width = F.get(_powers(arity), F.lit(stride(arity)) - F.col("level"))
    return each.select("tree", "n", "level", (F.col("block") * width + F.col("i")).alias("at"), "hash")


def climbed(leaves: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The tables of nodes of each tier, from the leaves (tree, n, idx, hash) up, and (tree, root). Only the size of the
    largest tree comes to the driver, once a tier."""
    tiers = []
    step = arity ** stride(arity)
    while True:
        tiers.append(stored(_nodes(leaves, arity)))
        roots = tiers[-1].where(F.col("level") == F.size(_levels(F.col("n"), arity)))
        above = F.greatest(F.lit(1), _whole(F.col("n") + step - 1, F.lit(step))).cast("long")
        leaves = roots.select("tree", above.alias("n"), F.col("at").alias("idx"), "hash")
        if (leaves.agg(F.max("n")).first()[0] or 1) <= 1:
            return tiers, roots.select("tree", F.col("hash").alias("root"))


def sibling_coordinates(idx: Column, n: Column, arity: int) -> Column:
    """The coordinates (level, at) of the siblings within a block of the leaf `idx` of a tree of `n`, and of the leaf itself."""
    powers = _powers(arity)

    def siblings(level: Column) -> Column:
        width = F.get(powers, level)
        own, size = _whole(idx, width), _whole(n + width - 1, width)
        start = own - F.pmod(own, F.lit(arity))
        run = F.sequence(start, F.least(start + arity, size) - 1)
        return F.transform(F.filter(run, lambda j: j != own), lambda j: F.struct(level.alias("level"), j.alias("at")))

    itself = F.array(F.struct(F.lit(0).alias("level"), idx.alias("at")))
    return F.concat(itself, F.flatten(F.transform(_levels(n, arity), siblings)))


def _paths(leaves: DataFrame, nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, hash, path) of `leaves` (tree, n, idx): what stands left and right of each node up to the block's root."""
    wanted = leaves.select("tree", "n", "idx", F.explode(sibling_coordinates(F.col("idx"), F.col("n"), arity)).alias("c"))
    found = wanted.select("tree", "n", "idx", "c.level", "c.at").join(nodes.select("tree", "level", "at", "hash"), ["tree", "level", "at"])
    found = found.groupBy("tree", "n", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "at", "hash"))).alias("met"))
    powers = _powers(arity)

    def beside(level: Column) -> Column:
        own = _whole(F.col("idx"), F.get(powers, level))
        text = lambda side: F.array_join(F.transform(F.filter("met", lambda x: (x["level"] == level) & side(x["at"])), lambda x: x["hash"]), "")
        return F.struct(text(lambda at: at < own).alias("left"), text(lambda at: at > own).alias("right"))

    itself = F.filter("met", lambda x: (x["level"] == 0) & (x["at"] == F.col("idx")))
    return found.select("tree", "idx", F.get(itself, F.lit(0))["hash"].alias("hash"), F.transform(_levels(F.col("n"), arity), beside).alias("path"))


def descended(leaves: DataFrame, tiers: list[DataFrame], top: DataFrame, arity: int = ARITY) -> DataFrame:
    """(tree, idx, hash, path, ...) of `leaves`: each path through the tiers, then on with the `path` that `top` (tree, path,
    ...) has for the tree, with `top`'s other columns."""
    step = F.lit(arity ** stride(arity))
    carried = [c for c in top.columns if c not in ("tree", "path")]
    upper = top.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(range(len(tiers))):
        own = tiers[tier].where("level = 0").select("tree", "n", F.col("at").alias("idx")) if tier else leaves
        here = _paths(own, tiers[tier], arity).withColumn("block", _whole(F.col("idx"), step))
        above = upper.withColumnRenamed("path", "rest")
        here = here.join(above, ["tree", "block"]).select("tree", "idx", "hash", F.concat("path", "rest").alias("path"), *carried)
        if not tier:
            return here
        upper = stored(here.drop("hash").withColumnRenamed("idx", "block"))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, altered): a row's language as the key of its tree, nulls first, its leaf, and for rows of which a
    copy is tampered with the leaf of that copy."""
    value = {c: F.col(c) for c in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = [value[c] + 1 if c == "n_chars" else value[c] for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf_digest(list(value.values())).alias("leaf"), F.when(chosen, leaf_digest(tampered)).alias("altered"))


def dataset_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of `docs`.

    Null and empty fields differ; null languages form a tree of their own, and null ids stand first. Rows of equal id are
    ordered by their leaves; rows equal throughout have leaves of their own beside each other. No rows give no rows.
    """
    places = stored(numbered(manifest_leaves(docs), "tree", "doc_id", "leaf"))
    tiers, subroots = climbed(places.select("tree", "n", "idx", F.col("leaf").alias("hash")), arity)
    named = stored(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "root"), "tree", "name"))
    last, roots = climbed(named.select("tree", "n", "idx", F.col("root").alias("hash")), arity)
    none = F.array().cast("array<struct<left:string,right:string>>")
    whole = descended(named.select("tree", "n", "idx"), last, roots.select("tree", none.alias("path"), "root"), arity)
    whole = whole.join(named.select("tree", "idx", "name"), ["tree", "idx"])
    top = stored(whole.select(F.col("name").alias("tree"), "path", F.col("hash").alias("subroot"), "root"))
    paths = descended(places.select("tree", "n", "idx"), tiers, top, arity)
    found = paths.join(places.select("tree", "idx", "doc_id", "altered"), ["tree", "idx"])
    found = found.withColumn("folded_root", folded(F.coalesce("altered", "hash"), F.col("path")))
    return found.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _combined(nodes: str) -> str:
    return f"[sha256(array_to_string({nodes}[i:i + {ARITY - 1}], '')) for i in range(1, len({nodes}) + 1, {ARITY})]"


#: CRC-32 of a decimal number's digits, by the table of its byte values.
CRC_SQL = """
    crc_table AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS v FROM range(256) r(b))),
    crc AS (SELECT doc_id, xor(list_reduce([CAST(ascii(ch) AS BIGINT) for ch in string_split(CAST(doc_id AS VARCHAR), '')],
                   lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""


def _field_sql(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def manifest_sql() -> str:
    """DuckDB's rows of `dataset_manifest` at arity 2."""
    leaf = " || ".join(_field_sql(c) for c in FIELDS)
    altered = leaf.replace(_field_sql("n_chars"), _field_sql("(n_chars + 1)"))
    return f"""
    WITH RECURSIVE {CRC_SQL},
    l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({leaf}) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256({altered}) END AS altered
          FROM documents LEFT JOIN crc USING (doc_id)),
    p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
    lv AS (SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM p GROUP BY tree
           UNION ALL SELECT tree, level + 1, {_combined("nodes")} FROM lv WHERE len(nodes) > 1),
    sub AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM lv WHERE len(nodes) = 1),
    tl AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub UNION ALL SELECT level + 1, {_combined("nodes")} FROM tl WHERE len(nodes) > 1),
    top AS (SELECT nodes[1] AS root FROM tl WHERE len(nodes) = 1),
    steps AS (SELECT p.tree, idx, level, CASE WHEN (idx >> level) % 2 = 1 THEN nodes[(idx >> level)] END AS lft, CASE WHEN (idx >> level) % 2 = 0 THEN nodes[(idx >> level) + 2] END AS rgt
              FROM p JOIN lv ON lv.tree = p.tree AND len(nodes) > 1
              UNION ALL SELECT p.tree, idx, 1000 + level, CASE WHEN (place >> level) % 2 = 1 THEN nodes[(place >> level)] END, CASE WHEN (place >> level) % 2 = 0 THEN nodes[(place >> level) + 2] END
              FROM p JOIN sub ON sub.tree = p.tree JOIN tl ON len(nodes) > 1),
    paths AS (SELECT tree, idx, list({{'l': coalesce(lft, ''), 'r': coalesce(rgt, '')}} ORDER BY level) AS path FROM steps GROUP BY ALL),
    whole AS (SELECT p.*, coalesce(path, []) AS path FROM p LEFT JOIN paths ON paths.tree = p.tree AND paths.idx = p.idx),
    folds AS (SELECT *, list_reduce([x.l || '|' || x.r for x in path], lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)), coalesce(altered, leaf)) AS folded_root FROM whole)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.l || x.r for x in path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM folds JOIN sub ON sub.tree = folds.tree, top"""
