"""Column functions on text: terms, slugs, hashes, token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOP_WORDS = (
    "a an the is are am be was were do does did how what why where which who whom when of to in on for from with by at as it "
    "its this that these those and or not no your you i we they show list give tell me my our their about into over under can "
    "could would should"
).split()


def stem(term: Column) -> Column:
    """A plural's singular: ies to y, ses without es, s (not ss) without s."""
    n = F.length(term)
    return (
        F.when(term.endswith("ies") & (n > 4), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when(term.endswith("ses") & (n > 4), F.substring(term, F.lit(1), n - 2))
        .when(term.endswith("s") & ~term.endswith("ss") & (n > 3), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


def normalize_terms(text: Column) -> Column:
    """Distinct stemmed terms in first-seen order: lower case, letters and digits only, no stop words or single characters.

    A null text has no terms.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.transform(words, stem))


def normalized_query(terms: Column) -> Column:
    return F.array_join(F.array_sort(terms), " ")


def content_hash(text: Column) -> Column:
    """The first 8 hex digits of the SHA-1 of a text's UTF-8 bytes."""
    return F.substring(F.sha1(text.cast("binary")), 1, 8)


def half_up(number: Column) -> Column:
    return F.floor(number + 0.5).cast("long")


def tokens(text: Column) -> Column:
    """A quarter of the text's bytes, rounded half up; null counts 0."""
    return half_up(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def slugify(text: Column) -> Column:
    """Lower-case runs of letters and digits joined by single dashes, at most 60 characters; `decision` where none is left."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 60)
    cut = F.regexp_replace(cut, "-+$", "")
    return F.when(cut == "", "decision").otherwise(cut)


def make_id(domain: Column, date: Column, title: Column) -> Column:
    return F.concat(slugify(domain), F.lit("/"), date, F.lit("-"), slugify(title))


def id_from_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.ya?ml$", "")


def idf(df: Column, n: Column) -> Column:
    """ln(1 + n / (df + 0.5)); an unseen term has df 0."""
    return F.log(1 + n / (F.coalesce(df, F.lit(0)) + 0.5))


def whole_word(words: str) -> str:
    """A pattern of alternatives that stand as whole ASCII words."""
    return rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"
