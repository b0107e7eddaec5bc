"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Column functions only. Positions come from splitting a text at the matches of a pattern: the pieces between matches and
the matches themselves, in turn, make up the text, so running sums of their lengths are the spans in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")

# The patterns keep the leftmost non-overlapping matches of the plain forms but read each run of characters once: a match
# begins at the head of its run or where the last match ended, and runs are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
LOOSE_SEPARATOR = r"(?<![0-9])[ -]|[ -](?![0-9])"
CARD = r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"

#: Words that make a span of the kind likelier when they stand within CONTEXT code points of it.
CONTEXT_WORDS = {
    "email": r"mail|contact|write to|address",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|master|credit|debit|payment|cvv|expir",
    "phone": r"phone|call|mobile|tel\b|fax|contact",
    "iban": r"iban|bank|account|transfer|swift",
}
CONTEXT = 40
#: Score of a confirmed span without and with such words.
PLAIN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT_BONUS = 0.2

SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"


def _spans(text: Column, pattern: str, kind: str, original: Column | None = None) -> Column:
    """All matches of `pattern` in `text` with their places, as an array of SPAN_TYPE."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN_TYPE).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["match"]), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), pair["match"].alias("match")))
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(pair["match"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], one.cast(SPAN_TYPE))).alias("spans"),
        )

    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every second digit is doubled."""
    backwards = F.reverse(digits)

    def value(at: Column) -> Column:
        digit = F.substring(backwards, at, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(at % 2 == 0, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, at: acc + value(at))
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether the rearranged account number leaves 1 on division by 97, letters counting 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, at: Column) -> Column:
        code = F.ascii(F.substring(moved, at, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id and `found`, confirmed spans as structs (kind, start, end, score).

    `found` is ordered by kind as listed in KINDS, then start; places are code points, end exclusive. The score is that of
    the kind, higher when one of the kind's context words is near; it ranks spans and drops none. A null or empty text
    has no spans; a null id stays null; repeated rows each give a row; other columns are not read. There is no shuffle.
    """
    none = F.array().cast(SPAN_TYPE)
    text = F.col("text")
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a cheap test first: most texts hold no such span at all
    proposed = picked.select(
        "id",
        "text",
        F.when(F.instr(text, "@") > 0, _spans(text, EMAIL, "email")).otherwise(none).alias("email"),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _spans(text, IP, "ip")).otherwise(none).alias("ip"),
        F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), F.regexp_replace(text, LOOSE_SEPARATOR, "x")).alias("dense"),
        F.when(F.instr(text, "+") > 0, _spans(text, PHONE, "phone")).otherwise(none).alias("phone"),
        F.when(text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), _spans(text, IBAN, "iban")).otherwise(none).alias("iban"),
    )
    proposed = proposed.withColumn(
        "card", F.when(F.col("dense").isNotNull(), _spans(F.col("dense"), CARD, "card")).otherwise(none)
    )

    def part_ok(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    confirmed = proposed.select(
        "id",
        "text",
        F.concat(
            F.col("email"),
            F.filter("ip", lambda s: F.forall(F.split(s["match"], r"\."), part_ok)),
            F.filter("card", lambda s: F.length(_digits(s["match"])).between(13, 19) & luhn_ok(_digits(s["match"]))),
            F.filter("phone", lambda s: F.length(_digits(s["match"])).between(9, 15)),
            F.filter("iban", lambda s: mod97_ok(s["match"])),
        ).alias("spans"),
    )

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1
        near = F.lower(F.substring(F.col("text"), begin.cast("int"), (s["end"] + CONTEXT - begin + 1).cast("int")))
        plain = F.coalesce(*[F.when(s["kind"] == k, F.lit(PLAIN_SCORE[k])) for k in KINDS])
        helped = F.coalesce(*[F.when(s["kind"] == k, near.rlike(CONTEXT_WORDS[k])) for k in KINDS])
        return F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.when(helped, plain + CONTEXT_BONUS).otherwise(plain).alias("score"),
        )

    return confirmed.select(F.col("id").alias(id_col), F.transform("spans", scored).alias("found"))


def span_list(found: Column) -> Column:
    """`kind:start:end`, comma-joined in the order of the array."""
    return F.concat_ws(
        ",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and span list of each document, and the sum of its spans' scores."""
    found = find_personal_data(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"),
        F.round(F.aggregate("found", F.lit(0.0), lambda acc, s: acc + s["score"]), 6).alias("risk"),
    )
