"""Benchmark decontamination by templates: typed placeholders, a hash join of windows, and a check of what fills the slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papergraph.llm.common import saved

#: Up to so many windows (of about 200 bytes with their words) the benchmark is broadcast; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 200_000
#: Units of measure.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s ms min h hr hrs hours minutes seconds days weeks months years eur usd gbp kb mb gb tb hz w kw v a j k c f mph kmh".split()
_NUMBER = r"^[^\p{L}\p{N}]*\p{N}[\p{N}.,:/]*[^\p{L}\p{N}]*$"
_MEASURE = rf"^[^\p{{L}}\p{{N}}]*\p{{N}}[\p{{N}}.,:/]*({'|'.join(UNITS)})[^\p{{L}}\p{{N}}]*$"


#: Words for numbers.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()


def _tokens(text):
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _bare(word):
    """The word without punctuation around it, in lower case; most words are so already."""
    return F.when(word.rlike("^[a-z]+$"), word).otherwise(F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))


def _template(tokens):
    """Tokens with typed placeholders: numbers, units after numbers, and capitalised words; other words are bare.

    A name inside a sentence keeps its word behind <name>, a capitalised word at the start of one behind <first>.
    Words of small letters alone, which are most, are told by one pattern.
    """

    def lowered(plain, before):
        after_number = F.coalesce(before.rlike(_NUMBER) | before.isin(NUMBER_WORDS), F.lit(False))
        return F.when(plain.isin(NUMBER_WORDS), F.lit("<number>")).when(plain.isin(UNITS) & after_number, F.lit("<unit>"))

    def other(word, before):
        def by_bare(plain):
            inside = F.coalesce(~before.rlike(r"[.!?:][^\p{L}\p{N}]*$"), F.lit(False))
            return F.coalesce(
                lowered(plain, before),
                F.when(word.rlike(r"^[^\p{L}\p{N}]*\p{Lu}"), F.concat(F.when(inside, F.lit("<name>")).otherwise(F.lit("<first>")), plain)).otherwise(plain),
            )

        bare = F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return F.when(word.rlike(_NUMBER), F.lit("<number>")).when(word.rlike(_MEASURE), F.lit("<measure>")).otherwise(F.get(F.transform(F.array(bare), by_bare), F.lit(0)))

    def canonical(word, i):
        before = F.get(tokens, i - 1)
        return F.when(word.rlike("^[a-z]+$"), F.coalesce(lowered(word, before), word)).otherwise(other(word, before))

    return F.transform(tokens, canonical)


def _word(code, *marks):
    """The word behind any of the marks (none begins another), else the code itself."""
    cases = F
    for mark in marks:
        cases = cases.when(code.startswith(mark), F.substr(code, F.lit(len(mark) + 1)))
    return cases.otherwise(code)


def _typed(template):
    return F.transform(template, lambda c: F.when(c.startswith("<name>"), F.lit("<name>")).otherwise(_word(c, "<first>")))


def _plain(template):
    return F.transform(template, lambda c: _word(c, "<name>", "<first>"))


def _every(template):
    return F.transform(template, lambda c: F.when(c.startswith("<name>") | c.startswith("<first>"), F.lit("<name>")).otherwise(c))


def _around(template, mark: str, words: int):
    """Places of the windows that hold a token with the mark; elsewhere two templates agree."""
    last = F.greatest(F.size(template) - words, F.lit(0))
    marked = F.filter(F.transform(template, lambda c, i: F.when(c.startswith(mark), i)), lambda i: i.isNotNull())
    return F.array_distinct(F.flatten(F.transform(marked, lambda i: F.sequence(F.greatest(F.least(i, last) - F.greatest(F.least(i, last) - i + words - 1, F.lit(0)), F.lit(0)), F.least(i, last)))))


def _windows(template, places, words: int):
    """Hashes of the runs of that many tokens at the places; a shorter template is one window."""
    return F.transform(places, lambda i: F.xxhash64(F.slice(template, i + 1, words)))


def _named_windows(template, places, words: int):
    """The same, but null where a window is nothing but names."""
    return F.transform(places, lambda i: F.when(F.exists(F.slice(template, i + 1, words), lambda c: c != "<name>"), F.xxhash64(F.slice(template, i + 1, words))))


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots and slot_consistency of each document that holds an item.

    It does if it has at least that share of the item's distinct template windows, and if, where the two texts agree at
    the most places, that share of the item's values that fill several slots is each replaced by one value all through.
    A window counts by its typed template, by the one that leaves names as words, so that texts all in capitals or in
    small letters match, or by the one that takes capitalised words at the start of a sentence for names as well (unless
    it holds nothing else). There such a word's value is judged if the item has it as a name inside a sentence too.
    Equal numbers before unlike words are values of their own, but not if some keep the item's number and others do not. n_slots counts the item's slot values; without a repeated one (or any) the consistency is 1.
    All of every text is read; no Python runs on rows.

    Null, empty and wordless texts hold nothing and are held by nothing. Fewer words than a window are one window. Null
    ids take no part. Rows of one id count as one document. Empty tables give an empty result; other columns are not read.
    """
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("item_id IS NOT NULL")
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def templated(df):
        coded = df.withColumn("tokens", _tokens(F.col("text"))).withColumn("template", _template(F.col("tokens")))
        coded = coded.withColumns({"typed": _typed(F.col("template")), "plain": _plain(F.col("template")), "every": _every(F.col("template"))})
        n = F.size("template")
        coded = coded.withColumns(
            {
                "at_typed": F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0)))),
                "at_plain": _around(F.col("template"), "<name>", words),
                "at_every": _around(F.col("template"), "<first>", words),
            }
        )
        return coded.withColumns({"by_typed": _windows(F.col("typed"), F.col("at_typed"), words), "by_plain": _windows(F.col("plain"), F.col("at_plain"), words), "by_every": _named_windows(F.col("every"), F.col("at_every"), words)})

    def spots(df, *kept):
        """A row for each window by any template: its place `at` and hash `h`."""
        zipped = [F.arrays_zip(F.col(f"at_{c}").alias("at"), F.col(f"by_{c}").alias("h")) for c in ("typed", "plain", "every")]
        return df.select(*kept, F.explode_outer(F.concat(*zipped)).alias("x")).select(*[k for k in kept], "x.at", "x.h").where("h IS NOT NULL")

    asked = templated(items).withColumn("bare", F.transform("tokens", _bare))
    both = spots(asked, "item_id", "by_typed").select("item_id", F.get("by_typed", F.col("at")).alias("w"), "h")
    wanted = saved(both.distinct(), "template-windows")
    totals = wanted.groupBy("item_id").agg(F.count_distinct("w").alias("n_windows"))
    small = wanted.count() <= BROADCAST_WINDOWS

    def sized(df):
        return F.broadcast(df) if small else df

    # explode_outer throughout: a plain explode makes the optimizer test the windows' size below the projections that
    # hold tokens and templates, and work both out anew for each element.
    # Distinct hashes first, so that windows that many items share meet a document's windows once.
    hit = templated(source).select("doc_id", F.explode_outer(F.concat("by_typed", "by_plain", "by_every")).alias("h")).join(sized(wanted.select("h").distinct()), "h", "left_semi")
    hit = saved(hit.distinct(), "template-hits")
    pairs = hit.join(sized(wanted), "h").groupBy("doc_id", "item_id").agg(F.count_distinct("w").alias("n_matched"))
    pairs = pairs.join(sized(totals), "item_id").where(F.col("n_matched") >= least * F.col("n_windows"))
    pairs = saved(pairs, "template-pairs")

    # What the slots of an item are, and for numbers the word that follows, which tells equal values of unlike slots apart.
    names = F.filter("template", lambda c: c.startswith("<name>"))
    kinds = F.transform("template", lambda c: F.when(c.startswith("<name>") | (c.startswith("<first>") & F.array_contains(F.col("names"), F.concat(F.lit("<name>"), _word(c, "<first>")))), F.lit("<name>")).otherwise(_word(c, "<first>")))
    roles = F.transform("template", lambda c, i: F.when(c.startswith("<number>") | c.startswith("<measure>"), F.coalesce(F.get("bare", i + 1), F.lit(""))).otherwise(F.lit("")))
    slots = asked.where(F.exists("template", lambda c: c.startswith("<"))).withColumn("names", names).withColumn("kinds", kinds).withColumn("roles", roles)
    slots = spots(slots, "item_id", "bare", "kinds", "roles").select("item_id", "h", F.col("at").alias("i"), *[F.slice(c, F.col("at") + 1, words).alias(a) for c, a in (("kinds", "kinds"), ("roles", "roles"), ("bare", "item_words"))])
    found = templated(source.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")).withColumn("bare", F.transform("tokens", _bare))
    found = spots(found, "doc_id", "bare").select("doc_id", "h", F.col("at").alias("j"), F.slice("bare", F.col("at") + 1, words).alias("doc_words"))
    slot = F.col("kinds").startswith("<")
    filled = (
        found.join(sized(slots), "h")
        .join(pairs.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "i", (F.col("j") - F.col("i")).alias("shift"), F.posexplode(F.arrays_zip("kinds", "roles", "item_words", "doc_words")).alias("k", "s"))
        .select("doc_id", "item_id", "shift", (F.col("i") + F.col("k")).alias("place"), "s.kinds", "s.roles", "s.item_words", "s.doc_words")
        .distinct()
        .groupBy("doc_id", "item_id", "shift", "kinds", "item_words", "roles")
        .agg(F.min("doc_words").alias("low"), F.max("doc_words").alias("high"), F.count("*").alias("n"))
        .groupBy("doc_id", "item_id", "shift", "kinds", "item_words")
        .agg(F.sum("n").alias("n"), F.every(F.col("low") == F.col("high")).alias("same"), F.some(F.col("low") == F.col("item_words")).alias("kept"), F.some(F.col("low") != F.col("item_words")).alias("changed"))
        .groupBy("doc_id", "item_id", "shift")
        .agg(F.sum("n").alias("covered"), F.count_if(slot).alias("n_slots"), F.count_if(slot & (F.col("n") > 1)).alias("repeated"), F.count_if(slot & (F.col("n") > 1) & F.col("same") & ~(F.col("kept") & F.col("changed"))).alias("steady"))
        .withColumn("share", F.when(F.col("repeated") > 0, F.col("steady") / F.col("repeated")).otherwise(1.0))
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_slots", "share"), F.struct("covered", "share", "n_slots")).alias("best"))
        .select("doc_id", "item_id", "best.n_slots", F.col("best.share").alias("slot_consistency"))
    )
    return (
        pairs.join(filled, ["doc_id", "item_id"], "left")
        .select("doc_id", "item_id", "n_windows", "n_matched", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("slot_consistency", F.lit(1.0)).alias("slot_consistency"))
        .where(F.col("slot_consistency") >= least)
    )
