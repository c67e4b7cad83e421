"""Keyword retrieval through an inverted index of character trigrams, and query terms marked in texts by many patterns at once."""

from __future__ import annotations

from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from papergraph.operators.storage import forget, written

#: Records in the first range (each further one has twice as many) and in a block of postings.
FIRST_RANGE, BLOCK = 1024, 8192
#: Words of an automaton that goes to all tasks; a larger vocabulary goes in several.
MAX_WORDS = 200_000
GRAM = 3


def search_tokens(text: Column, least: int, cut: int | None = None) -> Column:
    """Lower-cased words of so many characters at least; the text itself (its first `cut` characters) if there is none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_distinct(F.filter(F.split(lowered, r"(?U)\W+"), lambda w: F.length(w) >= least))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.substring(lowered, 1, cut) if cut else lowered))


def lowered_text() -> Column:
    """Title and abstract, as they are searched."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))


@F.arrow_udf(ArrayType(StringType()))
def grams(texts: pa.Array) -> pa.Array:
    """The distinct trigrams of a text, its single and double characters, and the empty one."""
    return pa.array([None if t is None else sorted({t[i : i + n] for n in range(GRAM + 1) for i in range(len(t) - n + 1)}) for t in texts.to_pylist()], pa.list_(pa.string()))


def range_cuts(rows: DataFrame, growth: int) -> list[int]:
    """The last ords of all ranges but the last one: the first has some FIRST_RANGE rows, each further one `growth` times as many."""
    n = rows.count()
    shares, size = [], FIRST_RANGE
    while sum(shares) + size / max(n, 1) < 1:
        shares.append(size / n)
        size *= growth
    return rows.agg(F.percentile_approx("ord", [sum(shares[: i + 1]) for i in range(len(shares))], 10_000)).first()[0] if shares else []


def scanned(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, ord and doc_id of rows (ord, doc_id, text) that hold a token, each text being read once by one automaton of all tokens (token), in groups of MAX_WORDS."""
    groups = max(1, -(-tokens.count() // MAX_WORDS))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = None
    for i in range(groups):
        sent = rows.sparkSession.sparkContext.broadcast([r.token for r in tokens.where(F.pmod(F.xxhash64("token"), F.lit(groups)) == i).collect()])  # some MAX_WORDS

        def searched(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for x in sent.value:
                if x:
                    automaton.add_word(x, x)
            automaton.make_automaton()
            always = {x for x in sent.value if not x}  # the empty token is in every text
            for batch in batches if sent.value else ():
                held = [always | {x for _, x in automaton.iter(text)} if len(automaton) else always for text in batch.column(2).to_pylist()]
                at = pa.array([j for j, own in enumerate(held) for _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for own in held for x in own], pa.string()), batch.column(0).take(at), batch.column(1).take(at)], ["token", "ord", "doc_id"])

        one = rows.select("ord", "doc_id", "text").mapInArrow(searched, f"token string, ord {kinds['ord']}, doc_id {kinds['doc_id']}")
        found = one if found is None else found.unionByName(one)
    return found


def gram_index(records: DataFrame) -> DataFrame:
    """Postings of records (ord, text): range, block, gram and docs (the ords that hold it).

    Ranges of ord double in size, about, so that the first of many hits are found without reading the rest; the docs of a
    range lie in blocks of some BLOCK records, so that no posting grows with the table. Null ords and texts are left out.
    """
    rows = written(records.where("ord IS NOT NULL AND text IS NOT NULL").select(F.col("ord").cast("long").alias("ord"), "text"), "retrieval-records")
    cuts = range_cuts(rows, 2)
    place = sum(((F.col("ord") > c).cast("int") for c in cuts), F.lit(0))
    blocks = F.ceil(F.lit(float(FIRST_RANGE)) * F.pow(F.lit(2.0), F.col("range")) / BLOCK).cast("int")
    dealt = rows.select("ord", place.alias("range"), F.explode(grams("text")).alias("gram")).withColumn("block", F.pmod(F.xxhash64("ord"), blocks).cast("int"))
    return written(dealt.groupBy("range", "block", "gram").agg(F.collect_list("ord").alias("docs")), "retrieval-postings")  # some BLOCK ords


def keyword_retrieval(questions: DataFrame, records: DataFrame, k: int = 5, least: int = 4, cut: int | None = 20, index: DataFrame | None = None) -> DataFrame:
    """question_id, rank and doc_id: the first k records (by ord) that hold one of the question's words.

    questions: question_id, question; records: ord (unique), doc_id, title, abstract. Without an index the records of each
    range are read once for all words. In each range of an index
    each word looks up its two rarest trigrams, and the records that have both are read and searched for the word. A
    question that has its k records drops out before the next range, so a word that most records hold makes few pairs and a rare
    one has few postings. Questions without a word of `least` characters look for their first
    `cut` (None: all) instead. index: what gram_index made of the records, which pays for many searches only.
    """
    rows = records.select("ord", "doc_id", lowered_text().alias("text"))
    cuts = range_cuts(rows.select("ord").where("ord IS NOT NULL"), 4) if index is None else []
    asked = written(questions.select("question_id", F.explode(search_tokens(F.col("question"), least, cut)).alias("token")).distinct(), "retrieval-asked")
    found = None
    ranges = len(cuts) + 1 if index is None else (index.agg(F.max("range")).first()[0] or 0) + 1

    def looked_up(tokens, i):
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - GRAM + 1, F.lit(1))), lambda p: F.substr("token", p, F.lit(GRAM)))
        needed = tokens.select("token", F.explode(F.array_distinct(own)).alias("gram"))
        here = index.where(F.col("range") == i)
        sized = needed.join(here.groupBy("gram").agg(F.sum(F.size("docs")).alias("size")), "gram", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        rarest = sized.withColumn("nth", F.row_number().over(Window.partitionBy("token").orderBy("size", "gram"))).where("nth <= 2")
        rarest = rarest.groupBy("token").agg(F.min_by("gram", "nth").alias("gram"), F.max_by("gram", "nth").alias("second"))
        both = rarest.join(here.select("block", "gram", "docs"), "gram").join(here.select("block", F.col("gram").alias("second"), F.col("docs").alias("others")), ["block", "second"])
        candidates = both.select("token", F.explode(F.array_intersect("docs", "others")).alias("ord"))
        return candidates.join(rows, "ord").where(F.contains("text", F.col("token"))).select("token", "ord", "doc_id")

    for i in range(ranges):
        open_ = asked if found is None else asked.join(found.groupBy("question_id").agg(F.count("*").alias("c")).where(F.col("c") >= k), "question_id", "left_anti")
        if i and open_.isEmpty():
            break
        tokens = open_.select("token").distinct()
        if index is None:
            inside = F.col("ord").isNotNull()
            inside = inside & (F.col("ord") > cuts[i - 1]) if i else inside
            hits = scanned(rows.where(inside & (F.col("ord") <= cuts[i]) if i < len(cuts) else inside), tokens)
        else:
            hits = looked_up(tokens, i)
        first = Window.partitionBy("question_id").orderBy("ord")
        new = open_.join(hits, "token").select("question_id", "ord", "doc_id").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth")
        found = written(new if found is None else found.unionByName(new), "retrieval-found")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("ord"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "doc_id")
    forget(asked)
    return out


def vocabulary(labels: DataFrame, least: int = 4) -> DataFrame:
    """word: the lower-cased words of labels (label), of `least` characters at least, split at white space, hyphens and slashes."""
    return labels.select(F.explode(F.split(F.lower("label"), r"(?U)[\s\-/]+")).alias("word")).where(F.length("word") >= least).distinct()


def _among(sent):
    @F.arrow_udf("array<string>")
    def among(terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [x for x in t if x in sent.value] for t in terms.to_pylist()], pa.list_(pa.string()))

    return among


def marked_terms(pairs: DataFrame, words: DataFrame | None = None, least: int = 4, marks: tuple[str, str] = ("**", "**")) -> DataFrame:
    """The rows of pairs (query, text, ...) with marked: the text with all occurrences of the query's terms between marks.

    Terms are the query's parts between white space, of `least` characters at least, that are no English stop words and, if
    words (word) are given, among them. They are found whatever the case, also inside words; longer ones go before shorter,
    the first before the second, and none inside another's mark. All words are one automaton that goes to every task, in
    groups of MAX_WORDS; a text is read once for each. A null text or query has no marks.
    """
    stop = StopWordsRemover.loadDefaultStopWords("english")
    parts = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"(?U)\s+"), lambda t: (F.length(t) >= least) & ~t.isin(stop)))
    rows = pairs.withColumn("_terms", parts)
    if words is not None:
        groups = max(1, -(-words.count() // MAX_WORDS))
        known = None
        for i in range(groups):
            held = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == i).collect()]  # some MAX_WORDS
            one = _among(pairs.sparkSession.sparkContext.broadcast(frozenset(held)))("_terms")
            known = one if known is None else F.array_union(known, one)
        rows = rows.withColumn("_terms", known)

    @F.arrow_udf("string")
    def marked(texts: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([mark(text, own, marks) for text, own in zip(texts.to_pylist(), terms.to_pylist(), strict=True)], pa.string())

    return rows.withColumn("marked", marked("text", "_terms")).drop("_terms")


def label_mentions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and n: how often a text of docs (doc_id, text) holds a label as whole words, whatever the case.

    All labels (label) are one automaton, broadcast in groups of MAX_WORDS: each text is read once for a group, not once for a
    label. Empty labels are left out; labels that differ in case alone are one, in lower case.
    """
    names = labels.select(F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct()
    groups = max(1, -(-names.count() // MAX_WORDS))
    found = None
    for i in range(groups):
        sent = docs.sparkSession.sparkContext.broadcast([r.label for r in names.where(F.pmod(F.xxhash64("label"), F.lit(groups)) == i).collect()])  # some MAX_WORDS

        def searched(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for x in sent.value:
                automaton.add_word(x, x)
            automaton.make_automaton()
            for batch in batches if sent.value else ():
                out = []
                for at, text in enumerate(batch.column(1).to_pylist()):
                    low = (text or "").lower()
                    counts = Counter(x for end, x in automaton.iter(low) if not (low[end - len(x) : end - len(x) + 1] if end >= len(x) else "").isalnum() and not low[end + 1 : end + 2].isalnum())
                    out += [(at, x, n) for x, n in counts.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], ["doc_id", "label", "n"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        one = docs.select("doc_id", "text").mapInArrow(searched, f"doc_id {kind}, label string, n long")
        found = one if found is None else found.unionByName(one)
    return found


def mark(text: str | None, terms: list[str] | None, marks: tuple[str, str]) -> str | None:
    """The text with the terms marked; letters whose lower-cased form has another length are compared as they are."""
    if not text or not terms:
        return text
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, len(t))
    automaton.make_automaton()
    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    spans = sorted(((end - n + 1, end + 1) for end, n in automaton.iter(low)), key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], marks[0], text[a:b], marks[1]]
            at = b
    return "".join([*out, text[at:]])
