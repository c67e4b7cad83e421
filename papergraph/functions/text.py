"""Column functions for names, keywords, abstracts, dates and labels. Null in gives null, unless a function says otherwise."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases of publishers that are no part of an abstract; each runs to the end of its line.
BOILERPLATE = [
    r"copyright\s+©?\s*\d{4}.*",
    r"all rights reserved\.?",
    r"published by elsevier.*",
    r"this article is protected by copyright.*",
    r"©\s*\d{4}.*",
    r"this is an open.access article.*",
    r"for correspondence.*",
    r"electronic supplementary material.*",
]
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
MONTHS = "january february march april may june july august september october november december".split()

_BLANK = r"(?U)\s+"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(StringType())
def without_accents(texts: pa.Array) -> pa.Array:
    """Letters without their combining marks."""
    return pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFD"), r"\p{Mn}", "")


@F.arrow_udf(StringType())
def composed(texts: pa.Array) -> pa.Array:
    """Unicode form NFC."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def collapsed(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(as_column(text), _BLANK, " "))


def word_case(text: Column | str) -> Column:
    """Each word with a capital first and small letters after it, words joined by single blanks."""
    words = F.filter(F.split(collapsed(text), " "), lambda w: w != "")

    def cased(w):
        initial = F.upper(F.substring(w, 1, 1))  # some letters have two capitals
        return F.concat(F.substring(initial, 1, 1), F.lower(F.substr(initial, F.lit(2))), F.lower(F.substr(w, F.lit(2))))

    return F.array_join(F.transform(words, cased), " ")


def author_name(name: Column | str) -> Column:
    """Canonical "Last, Fore" without accents; a name without a comma has its surname last. Null gives an empty string."""
    plain = collapsed(without_accents(F.coalesce(as_column(name), F.lit(""))))
    at = F.instr(plain, ",")
    last = F.when(at > 0, F.substr(plain, F.lit(1), at - 1)).otherwise(F.element_at(F.split(plain, " "), -1))
    fore = F.when(at > 0, F.substr(plain, at + 1)).otherwise(F.regexp_replace(plain, r"\s*\S+$", ""))
    last, fore = word_case(last), word_case(fore)
    return F.when(fore == "", last).otherwise(F.regexp_replace(F.concat(last, F.lit(", "), fore), r"^[, ]+|[, ]+$", ""))


def keyword(text: Column | str) -> Column:
    """Lower case, without punctuation at the ends, single blanks inside. Null gives an empty string."""
    lowered = F.lower(composed(F.coalesce(as_column(text), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, r"(?U)^[^\w]+|[^\w]+$", ""), _BLANK, " ")


def clean_abstract(text: Column | str) -> Column:
    """Without tags and publishers' phrases, entities decoded, lines trimmed; null if nothing is left."""
    out = F.regexp_replace(as_column(text), "<[^>]+>", " ")
    for entity, character in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(character))
    out = composed(out)
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, f"(?iudU){pattern}", "")
    out = F.regexp_replace(F.regexp_replace(out, "\r\n|\r", "\n"), " {2,}", " ")
    lines = F.transform(F.split(out, "[\n\u000b\u000c\u001c\u001d\u001e\u0085  ]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")
    return F.when(out != "", out)


def _month(name: Column) -> Column:
    number = F.lit(None).cast("string")
    for i, month in enumerate(MONTHS, 1):
        number = F.when(F.lower(name).isin(month, month[:3]), f"{i:02d}").otherwise(number)
    return number


def partial_date(text: Column | str) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from the forms that publication dates have; null if there is no year.

    A range of months gives the year, as does a month that is not known. Numbers are not checked for their range.
    """
    s = F.trim(F.regexp_replace(as_column(text), r"(?U)^\s+|\s+$", ""))

    def part(pattern, i):
        return F.regexp_extract(s, pattern, i)

    def dated(year, month, day):
        given = F.when(day != "", F.concat(F.lit("-"), F.lpad(day, 2, "0"))).otherwise("")
        return F.when(month.isNull(), year).otherwise(F.concat(year, F.lit("-"), month, given))

    first, named, daily, slashed = r"^(\d{4})\s+([A-Za-z]+)(?:\s+(\d{1,2}))?", r"^([A-Za-z]+)\s+(\d{4})", r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", r"^(\d{4})/(\d{1,2})(?:/(\d{1,2}))?"
    return (
        F.when(s.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), s)
        .when(s.rlike(r"^\d{4}\s+[A-Za-z]+-"), F.substring(s, 1, 4))
        .when(s.rlike(first), dated(part(first, 1), _month(part(first, 2)), part(first, 3)))
        .when(s.rlike(named), dated(part(named, 2), _month(part(named, 1)), F.lit("")))
        .when(s.rlike(daily), dated(part(daily, 3), _month(part(daily, 2)), part(daily, 1)))
        .when(s.rlike(slashed), dated(part(slashed, 1), F.lpad(part(slashed, 2), 2, "0"), part(slashed, 3)))
        .when(s.rlike(r"^\d{4}"), F.substring(s, 1, 4))
    )


def year_of(date: Column | str) -> Column:
    """The four digits that a date begins with, as an integer; null if it does not."""
    return F.when(as_column(date).rlike(r"^\d{4}"), F.substring(as_column(date), 1, 4).cast("int"))


def mid_year(year: Column | str) -> Column:
    """The fifteenth of June; of 2000 for a null year or one outside 1900 to 2100."""
    y = as_column(year)
    return F.make_date(F.when(y.between(1900, 2100), y).otherwise(2000), F.lit(6), F.lit(15))


def month_name(month: Column | str) -> Column:
    """`MMM yyyy` of a YYYY-MM."""
    return F.date_format(F.to_date(as_column(month), "yyyy-MM"), "MMM yyyy")


def author_short(name: Column | str) -> Column:
    """Last name and the forenames' initials of "Last, Fore"; null gives an empty string."""
    n = F.coalesce(as_column(name), F.lit(""))
    at = F.instr(n, ",")
    last = F.trim(F.when(at > 0, F.substr(n, F.lit(1), at - 1)).otherwise(n))
    fore = F.when(at > 0, F.substr(n, at + 1)).otherwise("")
    initials = F.array_join(F.transform(F.filter(F.split(collapsed(fore), " "), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(initials != "", F.concat(last, F.lit(" "), initials)).otherwise(last)


def truncated(text: Column | str, n: int) -> Column:
    """The text, or its first n - 1 characters and an ellipsis if it is longer than n. Null gives an empty string."""
    t = F.coalesce(as_column(text), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def without_tags(text: Column | str) -> Column:
    """Markup taken out; null gives an empty string."""
    return F.regexp_replace(F.coalesce(as_column(text), F.lit("")), "<[^>]+>", "")


def query_hash(text: Column | str) -> Column:
    """The first twelve hex digits of the SHA-256 of a query."""
    return F.substring(F.sha2(as_column(text), 256), 1, 12)


def sentences(text: Column | str) -> Column:
    """Pieces after each full stop, exclamation or question mark with white space behind it, without empty ones."""
    pieces = F.split(F.trim(as_column(text)), r"(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def text_to_embed(abstract: Column | str, title: Column | str) -> Column:
    """The abstract, or the title where that is blank."""
    return F.when(F.trim(F.coalesce(as_column(abstract), F.lit(""))) != "", as_column(abstract)).otherwise(F.coalesce(as_column(title), F.lit("")))


def placeholder(text: Column | str, word: str = "[NO ABSTRACT]") -> Column:
    """The word where a text is null or blank, so that topics can be fitted."""
    return F.when(F.trim(F.coalesce(as_column(text), F.lit(""))) == "", F.lit(word)).otherwise(as_column(text))


def author_list(names: Column | str, shown: int = 3) -> Column:
    """The first names joined by commas, and how many more there are."""
    n = as_column(names)
    head = F.array_join(F.slice(n, 1, shown), ", ")
    return F.when(F.size(n) > shown, F.concat(head, F.lit(" et al. (+"), (F.size(n) - shown).cast("string"), F.lit(")"))).otherwise(head)


def topic_label(words: Column | str, k: int = 5) -> Column:
    """The first k words of two letters at least that are not digits alone, joined by slashes."""
    return F.array_join(F.slice(F.filter(as_column(words), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$")), 1, k), " / ")


def short_label(words: Column | str, k: int = 3) -> Column:
    """The first k words, without variants that begin with a word chosen before or that it begins with."""

    def choose(chosen, w):
        near = F.exists(chosen, lambda c: F.lower(c).startswith(F.lower(w)) | F.lower(w).startswith(F.lower(c)))
        return F.when(near | (F.size(chosen) >= k), chosen).otherwise(F.array_append(chosen, w))

    return F.array_join(F.aggregate(as_column(words), F.array().cast("array<string>"), choose), ", ")


def confidence_score(label: Column | str) -> Column:
    """Fixed values for high, medium and low; null for other words."""
    lowered = F.lower(as_column(label))
    return F.when(lowered == "high", 0.85).when(lowered == "medium", 0.55).when(lowered == "low", 0.25)


def confidence_tier(score: Column | str) -> Column:
    s = as_column(score)
    return F.when(s >= 0.7, "High").when(s >= 0.45, "Medium").when(s.isNotNull(), "Low")


def node_size(weight: Column | str, least: Column, most: Column, low: float, high: float) -> Column:
    """Between low and high by the root of the place in [least, most]."""
    return low + F.sqrt((as_column(weight) - least) / (most - least + 1e-9)) * (high - low)


def edge_width(weight: Column | str, least: Column, most: Column, low: float, high: float) -> Column:
    """Between low and high by the logarithm of the distance from the least weight."""
    return low + F.ln(1 + as_column(weight) - least) / F.ln(1 + most - least + 1e-9) * (high - low)


def highlighted(text: Column | str, terms: Column | str) -> Column:
    """The text with each whole-word occurrence of a term between ** marks, whatever its case."""
    quoted = F.transform(as_column(terms), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?iuU)\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    return F.when(F.size(as_column(terms)) > 0, F.regexp_replace(as_column(text), pattern, F.lit("**$1**"))).otherwise(as_column(text))
