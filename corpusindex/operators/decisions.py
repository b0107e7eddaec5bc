"""The decision log: validation, ids, admission, conflicts, drift of evidence, catalogues. Per repo throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusindex.functions.text import content_hash, make_id, normalize_terms, whole_word
from corpusindex.operators.nearest import Held, best_matches, held_decisions, held_index, questions
from corpusindex.operators.order import numbered
from corpusindex.operators.postings import StoredIndex
from corpusindex.operators.retrieval import ACTIVE_STATUSES, decision_terms, weighed_terms
from corpusindex.sources.store import stored

# What a decision's fields may hold.
TYPES = ("architecture", "technical", "functional", "convention")
STATUSES = ("proposed", "active", "superseded", "deprecated")
CONFIDENCES = ("high", "medium", "low")
SCOPES = ("global", "domain", "local")
REQUIRED = ("title", "type", "status", "domain", "date", "decision")
FRENCH_LETTERS = "[àâäçéèêëîïôöùûü]"
FRENCH_WORDS = "le|la|les|une|des|nous|pour|avec|sans|être|décision|fonctionnel"
CUES = (
    "(?i)"
    + whole_word(
        r"from now on|going forward|we should always|always (?:use|do|prefer|avoid)|let'?s standardi[sz]e|standardi[sz]e on"
        r"|the rule is|as a (?:rule|convention)|by convention"
    )
    + r"|à partir de maintenant|désormais|(?:tu devrais|il faut|on doit|nous devons|on devrait) toujours|on standardise"
    r"|la règle (?:c'est|est)|on décide (?:de|que)|par convention"
)


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def validate(decisions: DataFrame) -> DataFrame:
    """`decisions` with arrays `errors` and `warnings`; absent columns count as null."""
    value = {c: _text(decisions, c) for c in (*REQUIRED, "scope", "confidence", "context", "rationale")}

    def given(name: str) -> Column:
        return F.coalesce(value[name] != "", F.lit(False))

    def wrong(name: str, allowed: tuple[str, ...], listed: bool) -> Column:
        tail = f" (expected {'|'.join(allowed)})" if listed else ""
        return F.when(given(name) & ~value[name].isin(*allowed), F.concat(F.lit(f"invalid {name}: "), value[name], F.lit(tail)))

    checks = [F.when(F.coalesce(F.trim(value[c]), F.lit("")) == "", F.lit(f"missing required field: {c}")) for c in REQUIRED]
    checks += [wrong("type", TYPES, True), wrong("status", STATUSES, True), wrong("scope", SCOPES, True)]
    checks += [wrong("confidence", CONFIDENCES, False)]
    checks += [
        F.when(
            given("date") & ~value["date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
            F.concat(F.lit("invalid date (want YYYY-MM-DD): "), value["date"]),
        )
    ]
    french = f"(?iu){FRENCH_LETTERS}|{whole_word(FRENCH_WORDS)}"
    first = F.coalesce(*[F.when(value[c].rlike(french), F.lit(c)) for c in ("title", "context", "decision", "rationale")])
    warning = F.concat(F.lit('field "'), first, F.lit('" looks non-English — the index must be English'))
    return decisions.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull())).withColumn(
        "warnings", F.filter(F.array(warning), lambda w: w.isNotNull())
    )


def effective_scope(scope: Column, kind: Column) -> Column:
    return F.coalesce(F.when(scope != "", scope), F.when(kind.isin("architecture", "convention"), "global").otherwise("domain"))


def _list(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in df.columns else F.array().cast("array<string>")


def default_fields(candidates: DataFrame, today: str, author: str = "unknown") -> DataFrame:
    """Candidates with status active, domain general, date `today`, the one author `author` and empty lists where they have
    none, and ids made from them."""
    filled = candidates
    for name, value in (("status", "active"), ("domain", "general"), ("date", today)):
        filled = filled.withColumn(name, F.coalesce(F.when(_text(candidates, name) != "", _text(candidates, name)), F.lit(value)))
    authors = F.array(F.lit(author))
    filled = filled.withColumn("authors", F.coalesce("authors", authors) if "authors" in candidates.columns else authors)
    for name in ("consequences", "tags", "conflicts_with", "evidence"):
        filled = filled.withColumn(name, _list(candidates, name))
    none = F.array().cast("array<struct<choice:string,rejected_because:string>>")
    filled = filled.withColumn("alternatives", F.coalesce("alternatives", none) if "alternatives" in candidates.columns else none)
    return filled.withColumn("id", make_id(F.col("domain"), F.col("date"), F.col("title")))


def question_terms(candidates: DataFrame) -> Column:
    """The terms by which a candidate's like is looked for: of its title, decision and tags."""
    return normalize_terms(F.concat_ws(" ", "title", "decision", F.array_join(_list(candidates, "tags"), " ")))


def _forced(candidates: DataFrame, force: bool) -> Column:
    own = F.coalesce("force", F.lit(False)) if "force" in candidates.columns else F.lit(False)
    return own | F.lit(force)


def _refuses(score: Column, match_domain: Column, domain: Column, supersedes: Column, forced: Column, least: float) -> Column:
    return F.coalesce((score >= least) & (match_domain == domain), F.lit(False)) & (F.coalesce(supersedes, F.lit("")) == "") & ~forced


def _hundredths(score: Column) -> Column:
    return F.floor(score * 100 + 0.5) / 100


def _best(asked: DataFrame, decisions: DataFrame, index: StoredIndex | None) -> DataFrame:
    """(repo, query_id, id, domain, score): the best active decision of each row of `asked` (repo, query_id, terms). Terms come
    from a kept index where there is one."""
    active = F.col("status").isin(*ACTIVE_STATUSES)
    held = held_decisions(decisions, active) if index is None else held_index(index, decisions, active)
    return best_matches(questions(weighed_terms(asked, held)), held.texts.where("live"), held.weights)


def dedup_gate(candidates: DataFrame, decisions: DataFrame, least: float = 0.5, force: bool = False, index: StoredIndex | None = None) -> DataFrame:
    """(repo, query_id, match, score, refused): each candidate's overall best active match in the log.

    A candidate is refused where that match, of score `least` or more rounded to 2 places, has its domain, unless it
    supersedes something or is forced, by its own column `force` or by the argument.
    """
    asked = candidates.select("repo", "query_id", question_terms(candidates).alias("terms"))
    top = _best(asked, decisions, index)
    found = top.select("repo", "query_id", F.col("id").alias("match"), F.col("domain").alias("m_domain"), _hundredths(F.col("score")).alias("score"))
    own = candidates.select("repo", "query_id", "domain", _text(candidates, "supersedes").alias("supersedes"), _forced(candidates, force).alias("forced"))
    refused = _refuses(F.col("score"), F.col("m_domain"), F.col("domain"), F.col("supersedes"), F.col("forced"), least)
    return found.join(own, ["repo", "query_id"]).select("repo", "query_id", "match", "score", refused.alias("refused"))


def admission(ready: DataFrame, decisions: DataFrame, least: float = 0.5, force: bool = False, first: int = 64, index: Held | None = None) -> DataFrame:
    """(repo, query_id, outcome, match): each candidate of `ready` judged against the log and the candidates recorded before it.

    Candidates come in order of their column `place`, where they have one, then `query_id`. An outcome is `invalid` (there are
    `errors`), `duplicate` (dedup_gate's rule), `exists` (its id is taken) or `recorded`; a forced candidate takes a taken id
    and replaces what has it. Terms weigh as in the log before the batch.

    An outcome hangs on earlier candidates only. So they are judged in portions of the order, each twice as large as the one
    before, from `first` a repo: against what is recorded so far, then, as long as that changes outcomes, also against the
    portion's own recorded ones. Copies of what an earlier portion recorded fall out before they are held against each other.
    The number of candidates of the largest repo and a portion's count of recorded ones come to the driver.
    """
    index = index or held_decisions(decisions, F.col("status").isin(*ACTIVE_STATUSES))
    order = ["place", "query_id"] if "place" in ready.columns else ["query_id"]
    whole = ready
    for name in ("type", "rationale", "context", "supersedes"):
        whole = whole.withColumn(name, _text(ready, name))
    for name in ("tags", "consequences"):
        whole = whole.withColumn(name, _list(ready, name))
    rows = decision_terms(whole).select(
        "repo", *order, "id", "domain", "supersedes", _forced(ready, force).alias("forced"), (F.size("errors") == 0).alias("valid"),
        F.col("status").isin(*ACTIVE_STATUSES).alias("live"), "terms", question_terms(whole).alias("asked"),
    )
    rows = stored(rows)
    valid = stored(numbered(rows.where("valid").drop("valid"), "repo", *order).withColumn("entry", F.concat(F.lit("new:"), "query_id")))
    asked = questions(weighed_terms(valid.select("repo", "query_id", F.col("asked").alias("terms")), index))

    # what can be met: the log's rows that nothing replaces, and as entries with a time those that are, and the candidates
    replacing = stored(valid.where("forced").select("repo", "id").distinct())
    log = index.texts.select("repo", "id", "domain", "live")
    met = best_matches(asked, index.texts.where("live").join(replacing, ["repo", "id"], "left_anti"), index.weights)
    met = stored(met.select("repo", "query_id", F.struct((-F.col("score")).alias("low"), "id", "domain").alias("best")))
    old = F.concat(F.lit("log:"), "id").alias("entry")
    replaced = index.texts.join(replacing, ["repo", "id"], "left_semi").select("repo", old, "terms")
    texts = stored(valid.select("repo", "entry", "terms").unionByName(replaced))
    own = weighed_terms(texts.withColumnRenamed("entry", "query_id"), index)
    norms = own.groupBy("repo", F.col("query_id").alias("entry")).agg(F.sum("w2").alias("d_self"))
    texts = stored(texts.join(norms, ["repo", "entry"]))
    at = F.lit(-1).cast("long").alias("idx")
    taken = stored(log.join(valid.select("repo", "id").distinct(), ["repo", "id"], "left_semi").select("repo", "id", at))
    recorded = stored(log.join(replacing, ["repo", "id"], "left_semi").select("repo", old, "id", "domain", "live", at))

    def judged(portion: DataFrame, entries: DataFrame) -> DataFrame:
        versions = Window.partitionBy("repo", "id").orderBy("idx")
        live = entries.withColumn("until", F.lead("idx").over(versions)).where("live")
        live = texts.join(live.select("repo", "entry", "id", "domain", F.col("idx").alias("since"), "until"), ["repo", "entry"])
        own = best_matches(asked.join(portion.select("repo", "query_id", "idx"), ["repo", "query_id"]), live)
        top = own.select("repo", "query_id", F.struct((-F.col("score")).alias("low"), "id", "domain").alias("best"))
        top = top.unionByName(met.join(portion, ["repo", "query_id"], "left_semi"))
        top = top.groupBy("repo", "query_id").agg(F.min("best").alias("best"))
        first_of = taken.unionByName(entries.select("repo", "id", "idx")).groupBy("repo", "id").agg(F.min("idx").alias("since"))
        out = portion.join(top, ["repo", "query_id"], "left").join(first_of, ["repo", "id"], "left")
        refused = _refuses(_hundredths(-F.col("best.low")), F.col("best.domain"), F.col("domain"), F.col("supersedes"), F.col("forced"), least)
        there = F.coalesce(F.col("since") < F.col("idx"), F.lit(False)) & ~F.col("forced")
        outcome = F.when(refused, "duplicate").when(there, "exists").otherwise("recorded")
        return stored(out.select("repo", "query_id", "entry", "id", "domain", "live", "idx", outcome.alias("outcome"), F.col("best.id").alias("match")))

    found = rows.where("NOT valid").select("repo", "query_id", F.lit("invalid").alias("outcome"), F.lit(None).cast("string").alias("match"))
    most, low, size = valid.agg(F.max("n")).first()[0] or 0, 0, first
    portion_columns = ["repo", "query_id", "entry", "id", "domain", "supersedes", "forced", "live", "idx"]
    while low < most:
        portion = valid.where((F.col("idx") >= low) & (F.col("idx") < low + size)).select(*portion_columns)
        entries, before = recorded, (0, None)
        while True:
            now = judged(portion, entries)
            new = now.where("outcome = 'recorded'")
            mark = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("repo", "query_id").cast("decimal(38,0)"))).first())
            entries = recorded.unionByName(new.drop("query_id", "outcome", "match"))
            if mark == before:
                break
            before = mark
        recorded, found = stored(entries), found.unionByName(now.select("repo", "query_id", "outcome", "match"))
        low, size = low + size, 2 * size
    return found


def record_decisions(
    candidates: DataFrame, decisions: DataFrame, today: str, author: str = "unknown", files: DataFrame | None = None, force: bool = False, index: Held | None = None
) -> DataFrame:
    """Candidates with their default fields, `id`, `outcome`, `match` (see admission()) and, where `files` are given, the hashes
    of what their evidence cites. (repo, query_id) names a candidate."""
    ready = stored(validate(default_fields(candidates, today, author)))
    out = ready.join(admission(ready, decisions, force=force, index=index), ["repo", "query_id"])
    if files is not None:
        hashes = evidence_hashes(ready.select("repo", F.col("query_id").alias("id"), "evidence"), files)
        hashes = hashes.groupBy("repo", F.col("id").alias("query_id")).agg(F.map_from_entries(F.collect_list(F.struct("ref", "hash"))).alias("evidence_hashes"))
        out = out.drop("evidence_hashes").join(hashes, ["repo", "query_id"], "left")
    return out


def appended(decisions: DataFrame, judged: DataFrame) -> DataFrame:
    """The log after record_decisions(): its rows but those replaced, and the recorded candidates, the last of each id."""
    order = F.struct("place", "query_id") if "place" in judged.columns else F.col("query_id")
    new = judged.where("outcome = 'recorded'")
    last = new.groupBy("repo", "id").agg(F.max(order).alias("last"))
    new = new.withColumn("last", order).join(last, ["repo", "id", "last"], "left_semi")
    return decisions.join(new, ["repo", "id"], "left_anti").unionByName(new.select(*[c for c in decisions.columns if c in new.columns]), allowMissingColumns=True)


def file_part(ref: Column) -> Column:
    return F.regexp_replace(ref, r":[0-9]+(-[0-9]+)?$", "")


def is_file_ref(ref: Column) -> Column:
    """Whether a reference names a file: no white space, no issue or address, and a slash or an extension led by a letter."""
    odd = ref.rlike(r"\s") | ref.rlike(r"(?i)^(PR|#|https?:)")
    return ~odd & (F.contains(ref, F.lit("/")) | file_part(ref).rlike(r"(?i)\.[a-z][a-z0-9]{0,5}$"))


def cited(content: Column, ref: Column) -> Column:
    """The lines that `:N` or `:N-M` at the end of a reference names, else the whole content."""
    first = F.regexp_extract(ref, r":([0-9]+)(?:-([0-9]+))?$", 1)
    last = F.regexp_extract(ref, r":([0-9]+)(?:-([0-9]+))?$", 2)
    a = F.greatest(F.lit(1), F.expr("1") * F.when(first != "", first.cast("int")).otherwise(1))
    b = F.when(last != "", last.cast("int")).otherwise(F.when(first != "", first.cast("int")).otherwise(1))
    lines = F.split(content, "\n", -1)
    picked = F.array_join(F.slice(lines, a, F.greatest(F.lit(0), b - a + 1)), "\n")
    return F.when(first == "", content).otherwise(picked)


def evidence_hashes(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, id, ref, hash) of each cited file that exists: the hash of what the reference cites."""
    refs = decisions.select("repo", "id", F.explode("evidence").alias("ref")).where(is_file_ref(F.col("ref")))
    refs = refs.withColumn("path", file_part(F.col("ref"))).distinct()
    found = refs.join(files.select("repo", "path", "content"), ["repo", "path"])
    return found.select("repo", "id", "ref", content_hash(cited(F.col("content"), F.col("ref"))).alias("hash"))


def decision_conflicts(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, type, id, ref, field): supersede-active, conflict, dangling, evidence-stale and evidence-missing.

    `evidence_hashes` of a decision maps a full reference or a bare path to the hash recorded for it.
    """
    known = decisions.select("repo", F.col("id").alias("ref"), F.col("status").isin(*ACTIVE_STATUSES).alias("target_active"))
    active = decisions.where(F.col("status").isin(*ACTIVE_STATUSES))
    refs = active.where("supersedes IS NOT NULL AND supersedes <> ''").select("repo", "id", F.col("supersedes").alias("ref"), F.lit("supersedes").alias("field"))
    refs = refs.unionByName(active.select("repo", "id", F.explode("conflicts_with").alias("ref"), F.lit("conflicts_with").alias("field")))
    joined = refs.join(known, ["repo", "ref"], "left")
    kind = (
        F.when(F.col("target_active").isNull(), "dangling")
        .when(F.col("target_active"), F.when(F.col("field") == "supersedes", "supersede-active").otherwise("conflict"))
    )
    relations = joined.select("repo", kind.alias("type"), "id", "ref", F.when(kind == "dangling", F.col("field")).alias("field")).where("type IS NOT NULL")
    cites = decisions.select("repo", "id", "evidence_hashes", F.explode("evidence").alias("ref")).where(is_file_ref(F.col("ref")))
    cites = cites.withColumn("path", file_part(F.col("ref")))
    there = files.select("repo", "path", F.coalesce("content", F.lit("")).alias("content"))
    cites = cites.join(there, ["repo", "path"], "left")
    by_ref = F.try_element_at("evidence_hashes", F.col("ref"))
    recorded = F.coalesce(by_ref, F.try_element_at("evidence_hashes", F.col("path")))
    now = content_hash(F.when(by_ref.isNotNull(), cited(F.col("content"), F.col("ref"))).otherwise(F.col("content")))
    none = F.lit(None).cast("string").alias("field")
    missing = cites.where("content IS NULL").select("repo", F.lit("evidence-missing").alias("type"), "id", F.col("path").alias("ref"), none)
    stale = cites.where(F.col("content").isNotNull() & (recorded != "") & (recorded != now))
    stale = stale.select("repo", F.lit("evidence-stale").alias("type"), "id", "ref", none)
    return relations.unionByName(missing).unionByName(stale)


def _listed(decisions: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The first `k` active decisions within `keys`, with `place`: architecture and convention first, then the newest, then
    by id; `n` is how many there are."""
    active = decisions.where(F.col("status").isin(*ACTIVE_STATUSES))
    first = F.col("type").isin("architecture", "convention").cast("int")
    order = Window.partitionBy(*keys).orderBy(first.desc(), F.col("date").desc(), "id")
    counts = active.groupBy(*keys).agg(F.count("*").alias("n"))
    return active.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).join(counts, list(keys))


def constitution(decisions: DataFrame, k: int = 30) -> DataFrame:
    """(repo, place, id, type, title, more): active global decisions; `more` is how many are not shown."""
    scoped = decisions.where(effective_scope(F.col("scope"), F.col("type")) == "global")
    listed = _listed(scoped, ("repo",), k)
    return listed.select("repo", "place", "id", "type", "title", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def domain_cards(decisions: DataFrame, k: int = 25) -> DataFrame:
    """(repo, domain, place, id, type, scope, title, active, total, more) of each domain's active decisions."""
    totals = decisions.groupBy("repo", "domain").agg(F.count("*").alias("total"))
    listed = _listed(decisions, ("repo", "domain"), k)
    scope = effective_scope(F.col("scope"), F.col("type")).alias("scope")
    more = F.greatest(F.col("n") - k, F.lit(0)).alias("more")
    return listed.join(totals, ["repo", "domain"]).select("repo", "domain", "place", "id", "type", scope, "title", F.col("n").alias("active"), "total", more)


def catalog(decisions: DataFrame) -> DataFrame:
    scope = effective_scope(F.col("scope"), F.col("type"))
    return decisions.select("repo", "id", F.concat_ws(" ", "status", "type", scope, F.lit("—"), "title").alias("line"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """(repo, domain, type, status, count, active): one row per domain, per type and per status of a repo."""
    active = F.count_if(F.col("status").isin(*ACTIVE_STATUSES))
    d, t, s = (F.col(c) for c in ("domain", "type", "status"))
    r = F.col("repo")
    grouped = decisions.groupingSets([[r, d], [r, t], [r, s]], r, d, t, s)
    return grouped.agg(F.count("*").alias("count"), active.alias("active"))


def cue_messages(messages: DataFrame) -> DataFrame:
    """Messages that state a standing rule."""
    return messages.where(F.col("text").rlike(CUES))


def harvest(messages: DataFrame, decisions: DataFrame, covered: float = 0.6, near: float = 0.3, index: StoredIndex | None = None) -> DataFrame:
    """(repo, msg_id, match, score, status) of cue messages: covered, supersedes-candidate or new by their best match."""
    cues = cue_messages(messages).select("repo", F.col("msg_id").alias("query_id"), normalize_terms(F.col("text")).alias("terms"))
    top = _best(cues, decisions, index)
    joined = cues.select("repo", "query_id").join(top.select("repo", "query_id", "id", "score"), ["repo", "query_id"], "left")
    status = F.when(F.col("score") >= covered, "covered").when(F.col("score") >= near, "supersedes-candidate").otherwise("new")
    return joined.select("repo", F.col("query_id").alias("msg_id"), F.col("id").alias("match"), "score", status.alias("status"))


# The lists from which synthetic decisions are made, by number modulo length.
GEN_DOMAINS = ("auth", "api", "data", "billing", "search", "frontend", "infra", "observability", "messaging", "payments")
GEN_TOPICS = (
    "caching strategy", "retry policy", "pagination", "rate limiting", "schema migration", "token refresh", "idempotency keys",
    "feature flags", "audit logging", "error taxonomy", "circuit breaker", "bulk import", "soft delete", "timezone handling",
    "currency rounding", "webhook delivery", "data retention",
)
GEN_TECH = ("Postgres", "Redis", "Kafka", "gRPC", "OpenAPI", "JWT", "S3", "cron", "OAuth2", "GraphQL")


def generated(numbers: DataFrame) -> DataFrame:
    """Synthetic decisions, one for each `i` of `numbers`."""
    i = F.col("i")

    def pick(values: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))

    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    out = numbers.select(
        "i", pick(GEN_DOMAINS).alias("domain"), pick(TYPES).alias("type"), pick(GEN_TOPICS).alias("topic"), pick(GEN_TECH).alias("tech"),
        F.concat_ws("-", (2024 + i % 3).cast("string"), two(i % 12 + 1), two(i % 28 + 1)).alias("date"),
        F.when(i % 11 == 0, "superseded").otherwise("active").alias("status"),
    )
    title = F.concat(F.col("topic"), F.lit(" for "), F.col("domain"), F.lit(" using "), F.col("tech"), F.lit(" #"), i.cast("string"))
    out = out.withColumn("title", title).withColumn("id", make_id(F.col("domain"), F.col("date"), F.col("title")))
    return out.select(
        "id", "title", "type", "status", "domain", "date",
        F.concat(F.lit("Standardize "), "topic", F.lit(" on "), "tech", F.lit(" across "), "domain", F.lit(".")).alias("decision"),
        F.concat(F.lit("Consistency and operational simplicity for "), "topic", F.lit(".")).alias("rationale"),
    )


def generate_decisions(spark: SparkSession, n: int) -> DataFrame:
    return generated(spark.range(n).withColumnRenamed("id", "i"))
