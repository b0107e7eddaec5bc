"""Allow or block web pages by rules on their addresses, and what no rule names by the links between hosts.

Trust starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and follows links
backwards, for who links to a blocked host earns less trust. Both are personalised PageRanks; a host whose distrust exceeds
its trust is blocked. Ranks are whole numbers, so they are the same whatever the order of additions.

Columns and joins only. A host that has most links is split: its links lie under several keys, and its rank is copied to each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusindex.llm.common import shuffle_partitions
from corpusindex.sources.store import stored

# The rules (verdict, host, path), and what a letter's lower case is.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rank that each page judged by a rule gives its host. Sums of it stay below 64 bits up to 10**12 pages.
UNIT = 100_000
#: The part of a host's rank that follows its links, over 20.
FOLLOWED = 17
#: How many links are followed from a seed; what is left after them is less than 4 % of the whole.
STEPS = 20
#: A host with more than this part of a partition's links is split.
SPLIT = 0.25

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def linked_hosts(html: Column) -> Column:
    """The distinct hosts that a page's links name; links without a host stay on their own."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The verdict and text of the longest rule that fits, or null; of rules of one length the first listed."""

    def fits(rule: tuple[str, str, str]) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = [F.when(fits(r), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule"))) for r in by_length]
    return F.coalesce(*found, F.lit(None).cast("struct<verdict:string,rule:string>"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, w) of different hosts: how many pages of `src` link to `dst`. `pages` has host and html."""
    each = pages.select(F.col("host").alias("src"), F.explode(linked_hosts(F.col("html"))).alias("dst"))
    each = each.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return each.groupBy("src", "dst").agg(F.count("*").alias("w"))


def spread_rank(seeds: DataFrame, links: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, rank) from `seeds` (host, rank) along `links` (src, dst, w), in proportion to their weights.

    A rank is the sum, over walks of at most `steps` links, of the seeds' rank times `FOLLOWED`/20 a link, rounded down at each host. Rank
    at a host without links goes nowhere. Only whether a step moved anything comes to the driver.
    """
    count = links.count()
    if not count:
        return seeds.groupBy("host").agg(F.sum("rank").alias("rank"))
    parts = shuffle_partitions(links.sparkSession)
    size = max(1, int(count / parts * SPLIT))
    out = stored(links.groupBy("src").agg(F.sum("w").alias("out"), F.count("*").alias("degree")))
    # sources of more than `size` links: at most parts / SPLIT of them
    large = out.where(F.col("degree") > size).select("src", F.ceil(F.col("degree") / size).alias("keys"))
    keyed = links.join(F.broadcast(large), "src", "left")
    keyed = stored(keyed.select("src", F.pmod(F.xxhash64("dst"), F.coalesce("keys", F.lit(1).cast("long"))).alias("key"), "dst", "w"))
    degree = stored(out.join(F.broadcast(large), "src", "left").select("src", "out", F.coalesce("keys", F.lit(1).cast("long")).alias("keys")))
    wave = stored(seeds.groupBy("host").agg(F.sum("rank").alias("rank")))
    waves = [wave]
    for _ in range(steps):
        sent = wave.join(degree, F.col("host") == F.col("src"))
        share = F.call_function("div", F.col("rank") * FOLLOWED, F.col("out") * 20)
        sent = sent.select("src", share.alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("keys") - 1)).alias("key")).where("share > 0")
        got = keyed.join(sent, ["src", "key"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("w")).alias("rank"))
        wave = stored(got)
        if wave.isEmpty():
            break
        waves.append(wave)
    return reduce(DataFrame.unionByName, waves).groupBy("host").agg(F.sum("rank").alias("rank"))


def host_ranks(judged: DataFrame, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) of hosts that either reaches. `judged` has host, verdict (null where no rule fits) and html."""
    seeds = stored(judged.where("verdict IS NOT NULL AND host <> ''").groupBy("host", "verdict").agg((F.count("*") * UNIT).alias("rank")))
    links = stored(host_links(judged))
    kind = lambda verdict: seeds.where(F.col("verdict") == verdict).select("host", "rank")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    trust = spread_rank(kind("allow"), links, steps).withColumnRenamed("rank", "trust")
    distrust = spread_rank(kind("block"), back, steps).withColumnRenamed("rank", "distrust")
    both = trust.join(distrust, "host", "full_outer")
    return both.select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, steps: int = STEPS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages` (page_id, url, html).

    The longest rule that fits gives the verdict; else a page is blocked where its host's distrust exceeds its trust. Hosts
    that neither reaches, and addresses without a host, are allowed. Null texts have no links. A row is judged by itself,
    repeated ids too. `rules` are few: they become one expression.
    """
    own = pages.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"), "html")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = own.withColumn("fit", fit).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "html")
    # written first, so that Spark knows how few hosts are blocked before it plans the join of the pages
    blocked = stored(host_ranks(judged, steps).where("distrust > trust").select("host", F.lit("block").alias("by_links")))
    found = judged.drop("html").join(blocked, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit("allow")).alias("verdict"))


def urls_sql() -> str:
    """DuckDB's rows of `filter_urls`."""
    def fits(r):
        return f"(host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}')"

    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in by_length) + " END"
    link = LINK.replace("'", "''").replace("(?i)", "(?is)")

    def ranks(name: str, seed: str, src: str, dst: str) -> str:
        steps = [f"{name}0 AS MATERIALIZED (SELECT host, count(*) * {UNIT} AS rank FROM j WHERE verdict = '{seed}' AND host <> '' GROUP BY host)"]
        steps.append(f"{name}out AS (SELECT {src} AS src, sum(w) AS out FROM e GROUP BY {src})")
        for k in range(STEPS):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT e.{dst} AS host, CAST(sum(share * w) AS BIGINT) AS rank FROM e JOIN (SELECT {name}out.src, CAST(rank * {FOLLOWED} AS BIGINT) // CAST(out * 20 AS BIGINT) AS share "
                f"FROM {name}{k} JOIN {name}out ON {name}out.src = host) s ON s.src = e.{src} WHERE share > 0 GROUP BY e.{dst})"
            )
        every = " UNION ALL ".join(f"SELECT host, rank FROM {name}{k}" for k in range(STEPS + 1))
        return ", ".join(steps) + f", {name} AS (SELECT host, sum(rank) AS rank FROM ({every}) GROUP BY host)"

    return f"""
    WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    j AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS verdict FROM p),
    e AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (SELECT host AS src, unnest(list_distinct([translate(x, '{UPPER}', '{LOWER}') for x in regexp_extract_all(html, '{link}', 1)])) AS dst FROM j)
          WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
    {ranks("t", "allow", "src", "dst")}, {ranks("d", "block", "dst", "src")}
    SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' END, 'allow') AS verdict
    FROM j LEFT JOIN t ON t.host = j.host LEFT JOIN d ON d.host = j.host"""
