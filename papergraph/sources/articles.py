"""Records from dumps of article XML, one element for each article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.functions.text import MONTHS

_CHARACTERS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_INSIDE = r"""(?:[^>"'/]|"[^"]*+"|'[^']*+'|/(?!>))*+"""  # of a tag, behind its name: values may hold a >
_REFERENCE = r"&#([xX][0-9a-fA-F]{1,8}|[0-9]{1,10});"


def _bound(value: Column, use) -> Column:
    """use of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _escaped(text: Column) -> Column:
    for character, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(name))
    return text


def _character(number: Column) -> Column:
    """The character of a numeric reference; those of markup by name, what is no character as it was."""
    code = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number).cast("long")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for name, character in _CHARACTERS.items():
        out = F.when(code == ord(character), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.concat(F.lit("&#"), number, F.lit(";")))


def _normal(xml: Column) -> Column:
    """The same element without comments, instructions, CDATA sections, empty-element tags and numeric references."""
    parts = F.split(xml, r"<!\[CDATA\[|\]\]>", -1)
    outside = F.transform(parts, lambda p, i: F.when(i % 2 == 1, _escaped(p)).otherwise(F.regexp_replace(p, r"(?s)<!--.*?-->|<\?.*?\?>", "")))
    whole = F.when(F.contains(xml, F.lit("<![CDATA[")) | F.contains(xml, F.lit("<!--")) | F.contains(xml, F.lit("<?")), F.array_join(outside, "")).otherwise(xml)
    full = F.regexp_replace(whole, rf"<([A-Za-z_][\w.:-]*)((?:\s{_INSIDE})?)/>", "<$1$2></$1>")

    def decoded(full):
        pieces, numbers = F.split(full, _REFERENCE, -1), F.regexp_extract_all(full, F.lit(_REFERENCE), F.lit(1))
        return F.when(F.contains(full, F.lit("&#")), F.array_join(F.zip_with(pieces, numbers, lambda p, n: F.concat(p, F.coalesce(_character(n), F.lit("")))), "")).otherwise(full)

    return _bound(full, decoded)


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)(<{tag}(?:\s{_INSIDE})?>.*?</{tag}\s*>)"), F.lit(1))


def _raw(xml: Column, tag: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<{tag}(?:\s{_INSIDE})?>(.*?)</{tag}\s*>", 1)


def _plain(text: Column) -> Column:
    """Text of mixed content: markup taken out, named references decoded."""
    out = F.regexp_replace(text, rf"(?s)</?[A-Za-z_]{_INSIDE}>", "")
    for name, character in _CHARACTERS.items():
        out = F.replace(out, F.lit(name), F.lit(character))
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def _inner(block: Column) -> Column:
    return _plain(F.regexp_extract(block, rf"(?s)^<[^\s>]+(?:\s{_INSIDE})?>(.*)</[^>]*>$", 1))


def _text(xml: Column, tag: str) -> Column:
    return _plain(_raw(xml, tag))


def _or_null(text: Column) -> Column:
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


def _attribute(block: Column, name: str) -> Column:
    """An attribute's value in the block's first tag, in either kind of quotes; empty if there is none."""
    quoted = F.regexp_extract(block, rf"""^<[^\s>]+(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*?\s+{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return _plain(_bound(quoted, lambda q: F.when(q == "", F.lit("")).otherwise(F.substr(q, F.lit(2), F.length(q) - 2))))


def _texts(xml: Column, tag: str) -> Column:
    return F.filter(F.transform(_blocks(xml, tag), _inner), lambda t: t != "")


def _date(block: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of Year, Month and Day; null without a year."""
    def dated(parts):
        year, month, day = parts["year"], parts["month"], parts["day"]
        number = F.lpad(month, 2, "0")
        for i, name in enumerate(MONTHS, 1):
            number = F.when(F.lower(F.substring(month, 1, 3)) == name[:3], f"{i:02d}").otherwise(number)
        whole = F.when(month == "", F.lpad(year, 4, "0")).otherwise(F.concat(F.lpad(year, 4, "0"), F.lit("-"), number, F.when(day != "", F.concat(F.lit("-"), F.lpad(day, 2, "0"))).otherwise("")))
        return F.when(year != "", whole)

    return _bound(block, lambda b: _bound(F.struct(*[_text(b, t).alias(t.lower()) for t in ("Year", "Month", "Day")]), dated))


def _free_date(text: Column) -> Column:
    """Year, with the first month that is named, of a free-form date; the text itself without a year, null if empty."""
    def dated(text):
        month = F.lower(F.regexp_extract(text, r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b", 1))
        number = F.lit(None).cast("string")
        for i, name in enumerate(MONTHS, 1):
            number = F.when(month == name[:3], f"-{i:02d}").otherwise(number)
        year = F.regexp_extract(text, r"^(\d{4})", 1)
        return F.when(text == "", None).when(year == "", text).otherwise(F.concat(year, F.coalesce(number, F.lit(""))))

    return _bound(text, dated)


def _named(blocks: Column, attribute: str) -> Column:
    """The first block whose attribute says doi."""
    return F.get(F.filter(blocks, lambda b: F.lower(F.trim(_attribute(b, attribute))) == "doi"), F.lit(0))


def parse_articles(articles: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each article (an XML element as text) that is well formed and has an id; others are left out.

    All references and CDATA sections are read as the text they stand for. Sections of an abstract are lines, `LABEL: text` where they have a label. A name is "Last, Fore", or the collective
    name. A heading has one row for each of its qualifiers; it is major if it or its qualifier is. The date is the
    electronic one, else that of the issue, else the free-form one. Missing texts are null, missing lists empty.
    """
    # names lose their prefixes first: what declares them may stand outside the element
    bare = F.regexp_replace(F.col(xml), r"(</?)[\w.-]+:(?=[A-Za-z_])", "$1")
    sound = F.from_xml(bare, "PMID string, _corrupt_record string", {"mode": "PERMISSIVE"})
    # explode keeps what follows from being worked out on the element as it came, once for each use
    articles = articles.where(sound["_corrupt_record"].isNull()).select(F.explode(F.array(_normal(F.col(xml)))).alias("xml"))
    x = F.col("xml")
    section = F.transform(_blocks(_raw(x, "Abstract"), "AbstractText"), lambda b: F.struct(_attribute(b, "Label").alias("label"), _inner(b).alias("text")))
    said = F.transform(F.filter(section, lambda s: (s["label"] != "") | (s["text"] != "")), lambda s: F.when(s["label"] != "", F.concat(s["label"], F.lit(": "), s["text"])).otherwise(s["text"]))

    def author(b):
        last, fore = _text(b, "LastName"), _text(b, "ForeName")
        name = _bound(F.struct(last.alias("last"), fore.alias("fore")), lambda n: F.when((n["last"] != "") | (n["fore"] != ""), F.regexp_replace(F.concat(n["last"], F.lit(", "), n["fore"]), r"^[, ]+|[, ]+$", "")).otherwise(_text(b, "CollectiveName")))
        return F.struct(name.alias("name"), last.alias("last_name"), fore.alias("fore_name"), _text(b, "Initials").alias("initials"), _or_null(F.array_join(_texts(b, "Affiliation"), "; ")).alias("affiliation"))

    def headings(b):
        def listed(h):
            each = F.transform(h["qualifiers"], lambda q: F.struct(h["descriptor"].alias("descriptor"), _inner(q).alias("qualifier"), (h["major"] | (_attribute(q, "MajorTopicYN") == "Y")).alias("is_major_topic")))
            alone = F.array(F.struct(h["descriptor"].alias("descriptor"), F.lit(None).cast("string").alias("qualifier"), h["major"].alias("is_major_topic")))
            return F.when(F.size(h["qualifiers"]) > 0, each).otherwise(alone)

        told = lambda top: F.struct(_inner(top).alias("descriptor"), (_attribute(top, "MajorTopicYN") == "Y").alias("major"), _blocks(b, "QualifierName").alias("qualifiers"))
        return _bound(_bound(F.get(_blocks(b, "DescriptorName"), F.lit(0)), told), listed)

    mesh = F.flatten(F.transform(F.filter(_blocks(x, "MeshHeading"), lambda b: F.size(_blocks(b, "DescriptorName")) > 0), headings))
    issue = _raw(x, "JournalIssue")
    issued = _raw(issue, "PubDate")
    rows = articles.select(
        _or_null(_text(x, "PMID")).alias("pmid"),
        _or_null(_text(x, "ArticleTitle")).alias("title"),
        _or_null(F.array_join(said, "\n")).alias("abstract"),
        F.filter(F.transform(_blocks(x, "Author"), author), lambda a: a["name"] != "").alias("authors"),
        F.flatten(F.transform(_blocks(x, "KeywordList"), lambda b: _texts(b, "Keyword"))).alias("keywords"),
        mesh.alias("mesh_terms"),
        F.filter(F.transform(_blocks(x, "Chemical"), lambda b: F.struct(_text(b, "NameOfSubstance").alias("name"), _or_null(_text(b, "RegistryNumber")).alias("registry_number"))), lambda c: c["name"] != "").alias("chemical_terms"),
        _texts(x, "PublicationType").alias("publication_types"),
        F.filter(F.transform(_blocks(x, "Grant"), lambda b: F.struct(_text(b, "GrantID").alias("id"), _text(b, "Agency").alias("agency"), _text(b, "Country").alias("country"))), lambda g: (g["id"] != "") | (g["agency"] != "")).alias("grant_info"),
        F.coalesce(_or_null(_text(_raw(x, "Journal"), "Title")), _or_null(_text(x, "MedlineTA"))).alias("journal"),
        _or_null(_text(issue, "Volume")).alias("volume"), _or_null(_text(issue, "Issue")).alias("issue"), _or_null(_text(x, "MedlinePgn")).alias("pages"),
        F.coalesce(_or_null(_inner(_named(_blocks(x, "ArticleId"), "IdType"))), _or_null(_inner(_named(_blocks(x, "ELocationID"), "EIdType")))).alias("doi"),
        _or_null(_text(x, "Language")).alias("language"),
        F.coalesce(_date(_raw(x, "ArticleDate")), _date(issued), _free_date(_text(issued, "MedlineDate"))).alias("pub_date"),
    )
    qualifiers = F.sort_array(F.array_distinct(F.filter(F.col("mesh_terms")["qualifier"], lambda q: q.isNotNull())))
    return rows.where("pmid IS NOT NULL").withColumn("mesh_qualifiers", qualifiers)


def read_articles(spark: SparkSession, path: str, query: str | None = None) -> DataFrame:
    """Records of the article elements in the files of a path; a broken article is left out alone."""
    ends = "</PubmedArticle>"
    rows = spark.read.option("lineSep", ends).text(path).where(F.contains("value", F.lit("<PubmedArticle")))
    closed = F.concat(F.regexp_extract("value", r"(?s).*(<PubmedArticle[\s>].*)$", 1), F.lit(ends))
    return parse_articles(rows.select(closed.alias("xml"))).withColumns({"query_used": F.lit(query), "fetched_at": F.current_timestamp()})
