"""Registered queries of the record operators and text functions, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papergraph.functions import text as T
from papergraph.operators import linkage, mentions, records, retrieval, statistics
from papergraph.operators.storage import shared_folder
from papergraph.sources import sinks, tables
from papergraph.sources.articles import read_articles


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit("([^ \\t\\n\\x0B\\f\\r]+)"), F.lit(1)).alias("w"))
    return docs.where("size(w) >= 3")


def _raw_names(spark, sf_dir):
    """A name from the first three words of a document, in the three forms that names have."""
    w = [F.col("w")[i] for i in range(3)]
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", *w)).when(F.col("doc_id") % 3 == 1, F.concat(w[0], F.lit(", "), w[1], F.lit(" "), w[2])).otherwise(F.concat(w[2], F.lit(","), w[0]))
    return _words(spark, sf_dir).select("doc_id", raw.alias("raw"))


def _author_names(spark, sf_dir):
    rows = _raw_names(spark, sf_dir)
    return rows.select("doc_id", T.author_name("raw").alias("name"), T.author_short(F.concat(F.lit("Last, "), F.translate("raw", ",", " "))).alias("short"))


def _keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word")).select("doc_id", "at", T.keyword("word").alias("keyword"))


def _raw_abstract():
    return F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>  p&lt;0.05 &amp; more\r\n  © 2020 The Authors. tail\nAll rights reserved. x\n last "))


def _abstracts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.clean_abstract(_raw_abstract()).alias("abstract"))


_FORMS = ["yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy MMM d", "MMM yyyy", "d MMM yyyy", "yyyy/M/d", "yyyy MMM"]


def _raw_dates(spark, sf_dir):
    raw = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        raw = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", form)).otherwise(raw)
    raw = F.when(F.col("o_orderkey") % 9 == 8, F.concat(F.date_format("o_orderdate", "yyyy MMM"), F.lit("-Dec"))).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", raw.alias("raw"))


def _dates(spark, sf_dir):
    rows = _raw_dates(spark, sf_dir).select("o_orderkey", "o_orderdate", T.partial_date("raw").alias("pub_date"))
    return rows.select("o_orderkey", "pub_date", T.year_of("pub_date").alias("pub_year"), T.mid_year(T.year_of("pub_date")).cast("string").alias("mid_year"), T.month_name(F.date_format("o_orderdate", "yyyy-MM")).alias("month"))


def _helpers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 4 == 0, "High").when(F.col("doc_id") % 4 == 1, "Medium").when(F.col("doc_id") % 4 == 2, "Low")
    return docs.select(
        "doc_id", T.truncated("text", 40).alias("cut"), T.collapsed(T.without_tags(F.concat(F.lit("<b>"), "text", F.lit("</b> ")))).alias("plain"), T.query_hash("text").alias("hash"),
        T.text_to_embed(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(" "), "source").alias("embed"), T.placeholder(F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("topic_text"),
        T.confidence_score(label).alias("score"), T.confidence_tier(T.confidence_score(label)).alias("tier"),
    )


def _sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(T.collapsed("text"))).alias("at", "sentence"))


def _payload(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    names = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name")))["s_name"].alias("names"))
    return names.select("l_orderkey", T.author_list("names").alias("authors"))


def _labels(spark, sf_dir):
    first = F.slice("w", 1, 12)
    return _words(spark, sf_dir).select("doc_id", T.topic_label(first).alias("label"), T.short_label(first).alias("short"))


def _titles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return linkage.dedup_titles(docs, "title", "doc_id").select("doc_id")


def _clusters(spark, sf_dir):
    names = _raw_names(spark, sf_dir).select(T.author_name("raw").alias("name"))
    return linkage.canonical_names(names, "name")


def _clean_records(spark, sf_dir):
    """A record is a document: first line, text, one author, its first words as keywords."""
    author = F.struct(F.col("raw").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("last_name", "fore_name", "initials", "affiliation", "normalized_name")])
    docs = table(spark, sf_dir, "documents").join(_raw_names(spark, sf_dir), "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("pmid"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"), F.array(author).alias("authors"),
        F.slice(F.split("text", " "), 1, 5).alias("keywords"), F.lit("2001 May 3").alias("pub_date"), F.col("doc_id").alias("row_ord"),
    )
    return records.clean_records(rows).select("pmid", "pub_year", "first_author", "author_count", "keyword_count", F.sha2("abstract", 256).alias("abstract_hash"), F.array_join("keywords", "|").alias("keywords"))


def _entities(spark, sf_dir):
    return mentions.extract_entities(table(spark, sf_dir, "documents"), "doc_id", "text")


def _relations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mentions.extract_corpus(docs, "doc_id", "text")[1]


def _xml(spark, sf_dir):
    """Articles are orders: written as XML, then read back."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")
    author = F.concat(F.lit("<Author><LastName>"), "s_name", F.lit("</LastName><ForeName>F "), F.col("l_linenumber").cast("string"), F.lit("</ForeName></Author>"))
    heading = F.concat(F.lit("<MeshHeading><DescriptorName MajorTopicYN=\"Y\">"), "p_name", F.lit("</DescriptorName><QualifierName>"), "p_type", F.lit("</QualifierName></MeshHeading>"))
    listed = lines.groupBy("l_orderkey").agg(*[F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", c.alias("x"))))["x"], "").alias(n) for n, c in (("authors", author), ("mesh", heading))])
    rows = table(spark, sf_dir, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    date = F.concat(F.lit("<PubDate><Year>"), F.date_format("o_orderdate", "yyyy"), F.lit("</Year><Month>"), F.date_format("o_orderdate", "MMM"), F.lit("</Month></PubDate>"))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"), F.col("o_orderkey").cast("string"), F.lit("</PMID><Article><Journal><JournalIssue><Volume>7</Volume>"), date, F.lit("</JournalIssue><Title>J &amp; K</Title></Journal><ArticleTitle>On <i>"), "o_orderpriority",
        F.lit("</i> orders</ArticleTitle><Abstract><AbstractText Label=\"AIM\">p &lt; <b>1</b></AbstractText>\n<AbstractText>"), "o_orderstatus", F.lit("</AbstractText></Abstract><AuthorList>"), F.coalesce("authors", F.lit("")), F.lit("</AuthorList><Language>eng</Language></Article><MeshHeadingList>"),
        F.coalesce("mesh", F.lit("")), F.lit("</MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.1/"), F.col("o_orderkey").cast("string"), F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"),
    )
    path = f"{shared_folder(spark)}/articles-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    rows.select(xml.alias("value")).write.mode("overwrite").text(path)
    found = read_articles(spark, path, "q")
    return found.select(
        F.col("pmid").cast("long").alias("pmid"), "title", "abstract", F.array_join(F.col("authors")["name"], ";").alias("authors"), F.array_join(F.transform("mesh_terms", lambda m: F.concat(m["descriptor"], F.lit("/"), m["qualifier"], F.lit("/"), m["is_major_topic"].cast("string"))), ";").alias("mesh"),
        F.array_join("mesh_qualifiers", ";").alias("qualifiers"), "journal", "volume", "doi", "language", "pub_date",
    )


def _upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus")).unionByName(orders.select((-1 - F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus").where("o_orderkey > -11"))
    return records.upsert(orders, new, ["o_orderkey"])


def _merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("pmid"), F.col("o_orderkey").alias("row_ord"), F.lit("first").alias("batch"))
    second = orders.select(F.col("o_custkey").alias("pmid"), F.col("o_orderkey").alias("row_ord"), F.lit("second").alias("batch"))
    return records.merge_batches([first, second], "pmid")


def _dimension(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    known = parts.where("p_partkey % 7 = 0").select("p_name", "p_type").distinct().withColumn("id", F.xxhash64("p_name", "p_type"))
    return records.insert_missing(known, parts, ["p_name", "p_type"]).groupBy("p_name", "p_type").agg(F.count("*").alias("n"))


def _links(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    arrays = lines.groupBy("l_orderkey").agg(F.collect_list("p_name").alias("names"))
    dimension = table(spark, sf_dir, "part").select(F.col("p_name").alias("item"), "p_brand").groupBy("item").agg(F.min("p_brand").alias("brand"))
    return records.terms_of(records.links(arrays, "l_orderkey", "names"), dimension, arrays.select(F.col("l_orderkey").alias("doc")))


def _json(spark, sf_dir):
    kind = "array<struct<k:int>>"
    props = records.json_array(F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.concat(F.lit("["), "props", F.lit("]"))), kind)
    return table(spark, sf_dir, "events").select("event_id", F.size(props).alias("n"), F.get(props, F.lit(0))["k"].alias("k"))


def _run_log(spark, sf_dir):
    return records.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def _vector_set(spark, sf_dir):
    path = f"{shared_folder(spark)}/vectors-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sinks.save_vectors(rows, path, "all")
    sinks.save_vectors(rows.where("label % 2 = 0"), path, "even")
    return sinks.load_vectors(spark, path, "even").select(F.col("vec_id").cast("long").alias("vec_id"))


def _kpi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    years = table(spark, sf_dir, "orders").agg(F.count("*").alias("n_records"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"))
    return years.join(lines.agg(F.countDistinct(F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))).alias("n_first_authors"), F.countDistinct("p_name").alias("n_keywords")))


def _page(spark, sf_dir):
    return records.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3)


def _percentiles(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.round(F.percentile("o_totalprice", p), 4).alias(f"p{int(100 * p)}") for p in (0.5, 0.75, 0.9)])


def _any_field(spark, sf_dir):
    return records.any_field_contains(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "WIDGET").select("p_partkey")


def _layout(spark, sf_dir):
    weights = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("weight"))
    spread = weights.agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.percentile("weight", 0.5).alias("p50"), F.percentile("weight", 0.75).alias("p75"))
    rows = weights.join(F.broadcast(spread))
    tier = F.when(F.col("weight") >= F.col("p75"), 1).when(F.col("weight") >= F.col("p50"), 2).otherwise(3)
    return rows.select("l_suppkey", F.round(T.node_size("weight", F.col("low"), F.col("high"), 10, 50), 5).alias("size"), F.round(T.edge_width("weight", F.col("low"), F.col("high"), 1, 8), 5).alias("width"), tier.alias("tier"))


def _highlight(spark, sf_dir):
    """The first three of an item's longer words, marked in its text."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 4))
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", F.slice(F.array_sort(words), 1, 3).alias("terms"))
    return rows.select("item_id", T.highlighted("text", "terms").alias("marked"))


def _palette(spark, sf_dir):
    ranks = F.pmod(F.dense_rank().over(Window.orderBy("n_nationkey")) - 1, F.lit(16))
    return table(spark, sf_dir, "nation").select("n_nationkey", ranks.cast("int").alias("colour"))


def _rough_xml(spark, sf_dir):
    """Articles are orders, with references by number, CDATA, either kind of quotes, empty elements and comments; every tenth is broken."""
    number = F.col("o_orderkey").cast("string")
    end = F.when(F.col("o_orderkey") % 10 == 0, F.lit("</Article></PubmedArticle>")).otherwise(F.lit("</Article></MedlineCitation></PubmedArticle>"))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), number, F.lit("</PMID><Article><ArticleTitle>TNF-&#x3b1; &#8211; <![CDATA[x<y & "), "o_orderstatus", F.lit("]]> <i>"), "o_orderpriority",
        F.lit("</i> &#60;b&#x3E;</ArticleTitle><!-- <Language>no</Language> --><Abstract><AbstractText NlmCategory=\"A>B\" Label='AIM'>p &lt; <b>1</b></AbstractText><AbstractText/><AbstractText>&#128512; "), number,
        F.lit("</AbstractText></Abstract><Language>eng</Language>"), end,
    )
    path = f"{shared_folder(spark)}/rough-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    table(spark, sf_dir, "orders").select(xml.alias("value")).write.mode("overwrite").text(path)
    return read_articles(spark, path, "q").select(F.col("pmid").cast("long").alias("pmid"), "title", "abstract", "language")


def _upsert_in_place(spark, sf_dir):
    """A table of orders in buckets; a batch changes and adds some, twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = f"{shared_folder(spark)}/orders-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    tables.create_table(orders, path, ["o_orderkey"], 16)
    batch = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus")).unionByName(orders.where("o_orderkey % 7 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus"))
    for _ in range(2):
        tables.upsert_table(batch, path, ["o_orderkey"], 16)
    return tables.read_table(spark, path)


def _label_mentions(spark, sf_dir):
    """Words of parts' types and of benchmark items in the documents."""
    items = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{4,})"), F.lit(1))).alias("label"))
    return retrieval.label_mentions(table(spark, sf_dir, "documents"), items.unionByName(table(spark, sf_dir, "part").select(F.col("p_type").alias("label"))))


def _vocabulary_marks(spark, sf_dir):
    """Each document asks with its first line; only words of the benchmark's items are marked."""
    words = retrieval.vocabulary(table(spark, sf_dir, "benchmark").select(F.col("text").alias("label")))
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("query"), "text")
    return retrieval.marked_terms(pairs, words).select("doc_id", F.sha2("marked", 256).alias("marked_hash"))


def _reload(spark, sf_dir):
    """Orders stored as records with their suppliers as authors, of which one query's are read again."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    author = F.struct(F.col("s_name").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("last_name", "fore_name", "initials", "affiliation", "normalized_name")])
    people = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", author.alias("a"))))["a"].alias("authors"))
    orders = table(spark, sf_dir, "orders").join(people, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("pmid"), F.lit(None).cast("string").alias("title"), "authors", F.array(F.col("o_orderpriority"), F.col("o_orderpriority")).alias("keywords"),
        F.date_format("o_orderdate", "yyyy MMM d").alias("pub_date"), F.col("o_orderstatus").alias("query_used"), F.col("o_orderkey").alias("row_ord"),
    )
    kept = records.stored(rows)
    kept = kept.withColumn("keywords", F.when(F.col("row_ord") % 5 == 0, F.lit("{bad")).otherwise(F.col("keywords")))
    return records.reload_session(kept, "F").select("pmid", "pub_date", "pub_year", "author_count", "keyword_count", F.array_join(F.col("authors")["name"], ";").alias("authors"))


def _corpus_counts(spark, sf_dir):
    """Papers are orders, their query the status; authors are suppliers, entities parts, relations lines, hypotheses customers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("query"))
    lines = table(spark, sf_dir, "lineitem")
    people = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("author"))
    hypotheses = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O").alias("query"))
    return statistics.corpus_counts(orders, people, table(spark, sf_dir, "part"), lines, hypotheses, "F")


def _sketches(spark, sf_dir):
    """Distinct customers and prices by order status, from sketches of two batches, and of all statuses together."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("query"), "o_orderkey", "o_custkey", "o_totalprice")
    kept = None
    for batch in (orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 <> 0")):
        one = statistics.query_sketches(batch, ["o_custkey"], ["o_totalprice"])
        kept = one if kept is None else kept.unionByName(one)
    whole = statistics.merged_sketches(kept).withColumn("query", F.lit("all"))
    return statistics.estimates(statistics.merged_sketches(kept, ["query"]).unionByName(whole))


QUERIES = {
    "articles_rough_xml": _rough_xml, "upsert_in_place": _upsert_in_place, "label_mentions": _label_mentions, "highlight_vocabulary": _vocabulary_marks, "session_reload": _reload, "corpus_counts": _corpus_counts, "corpus_sketches": _sketches,
    "author_names": _author_names, "keywords_clean": _keywords, "abstracts_clean": _abstracts, "partial_dates": _dates, "text_helpers": _helpers, "sentences": _sentences, "display_authors": _payload,
    "topic_labels": _labels, "title_dedup": _titles, "author_clusters": _clusters, "clean_records": _clean_records, "entities": _entities, "entity_relations": _relations, "articles_from_xml": _xml,
    "upsert_records": _upsert, "merge_batches": _merge, "dimension_insert": _dimension, "link_terms": _links, "json_arrays": _json, "run_log": _run_log, "vector_set": _vector_set, "kpi_row": _kpi, "table_page": _page,
    "percentiles": _percentiles, "any_field_filter": _any_field, "layout_table": _layout, "highlight": _highlight, "community_palette": _palette,
}

def _boilerplate(column: str) -> str:
    for pattern in T.BOILERPLATE:
        column = f"regexp_replace({column}, '{pattern}', '', 'gi')"
    return column


_W = "w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents), n3 AS (SELECT * FROM w WHERE len(w) >= 3)"
_RAW = f"{_W}, raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN w[1] || ' ' || w[2] || ' ' || w[3] WHEN 1 THEN w[1] || ', ' || w[2] || ' ' || w[3] ELSE w[3] || ',' || w[1] END AS raw FROM n3)"
_CASE = "array_to_string(list_transform(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), ' ')"

ORACLES = {
    "articles_rough_xml": """SELECT o_orderkey AS pmid, 'TNF-α – x<y & ' || o_orderstatus || ' ' || o_orderpriority || ' <b>' AS title, 'AIM: p < 1' || chr(10) || '😀 ' || o_orderkey AS abstract, 'eng' AS language FROM orders WHERE o_orderkey % 10 <> 0""",
    "upsert_in_place": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 1",
    "session_reload": """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(regexp_replace(s_name, '^(.*)$', '\\1'), ';' ORDER BY l_linenumber, s_name) AS a FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o_orderkey::VARCHAR AS pmid, strftime(o_orderdate, '%Y-%m-%d') AS pub_date, year(o_orderdate)::INT AS pub_year, coalesce(n, 0)::INT AS author_count, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS keyword_count, coalesce(a, '') AS authors
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
    "corpus_counts": """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS paper_count, (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F') AS author_count,
(SELECT count(*) FROM part) AS entity_count, (SELECT count(*) FROM lineitem) AS relationship_count, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS hypothesis_count""",
    "label_mentions": """WITH b AS (SELECT DISTINCT label FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS label FROM benchmark UNION ALL SELECT lower(trim(p_type)) FROM part) WHERE label <> '' AND NOT contains(label, ' ')),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS label FROM documents) SELECT doc_id, label, count(*) AS n FROM w JOIN b USING (label) GROUP BY ALL""",
    "author_names": f"""WITH {_RAW}, p AS (SELECT doc_id, raw, trim(regexp_replace(strip_accents(raw), '\\s+', ' ', 'g')) AS s FROM raw),
q AS (SELECT *, CASE WHEN contains(s, ',') THEN split_part(s, ',', 1) ELSE regexp_extract(s, '\\S+$') END AS last,
  CASE WHEN contains(s, ',') THEN substr(s, instr(s, ',') + 1) ELSE regexp_replace(s, '\\s*\\S+$', '') END AS fore FROM p),
r AS (SELECT doc_id, raw, {_CASE.format('last')} AS last, {_CASE.format('fore')} AS fore FROM q)
SELECT doc_id, CASE WHEN fore = '' THEN last ELSE trim(last || ', ' || fore, ', ') END AS name,
  'Last ' || array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(translate(raw, ',', ' '), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END), '') AS short FROM r""",
    "keywords_clean": """WITH k AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS "at" FROM documents)
SELECT doc_id, "at"::INT AS "at", regexp_replace(regexp_replace(lower(nfc_normalize(word)), '^[^\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+$', '', 'g'), '\\s+', ' ', 'g') AS keyword FROM k""",
    "abstracts_clean": f"""WITH r AS (SELECT doc_id, '<p>' || text || '</p>  p&lt;0.05 &amp; more' || chr(13) || chr(10) || '  © 2020 The Authors. tail' || chr(10) || 'All rights reserved. x' || chr(10) || ' last ' AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, nfc_normalize(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' ')) AS t FROM r),
b AS (SELECT doc_id, {_boilerplate("t")} AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n|\\r', chr(10), 'g'), ' {{2,}}', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g') AS t FROM b)
SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS abstract FROM c""",
    "partial_dates": """WITH r AS (SELECT *, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-%m') WHEN 7 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS pub_date FROM orders)
SELECT o_orderkey, pub_date, substr(pub_date, 1, 4)::INT AS pub_year, substr(pub_date, 1, 4) || '-06-15' AS mid_year, strftime(o_orderdate, '%b %Y') AS month FROM r""",
    "text_helpers": """SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE coalesce(text, '') END AS cut, trim(regexp_replace(regexp_replace('<b>' || text || '</b> ', '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain,
  substr(sha256(text), 1, 12) AS hash, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text ELSE source END AS embed, CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text ELSE '[NO ABSTRACT]' END AS topic_text,
  CASE doc_id % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.55 WHEN 2 THEN 0.25 END::DOUBLE AS score, CASE doc_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS tier FROM documents""",
    "sentences": """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS "at", unnest(s) AS sentence FROM s""",
    "display_authors": """WITH n AS (SELECT l_orderkey, list(s_name ORDER BY l_linenumber, s_name) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT l_orderkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al. (+' || (len(names) - 3) || ')' ELSE '' END AS authors FROM n""",
    "articles_from_xml": """WITH l AS (SELECT l_orderkey, string_agg(s_name || ', F ' || l_linenumber, ';' ORDER BY l_linenumber, s_name) AS authors, string_agg(p_name || '/' || p_type || '/true', ';' ORDER BY l_linenumber, p_name, p_type) AS mesh,
  array_to_string(list_sort(list(DISTINCT p_type)), ';') AS qualifiers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey AS pmid, 'On ' || o_orderpriority || ' orders' AS title, 'AIM: p < 1' || chr(10) || o_orderstatus AS abstract, coalesce(authors, '') AS authors, coalesce(mesh, '') AS mesh, coalesce(qualifiers, '') AS qualifiers,
  'J & K' AS journal, '7' AS volume, '10.1/' || o_orderkey AS doi, 'eng' AS language, strftime(o_orderdate, '%Y-%m') AS pub_date FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "upsert_records": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders WHERE -1 - o_orderkey > -11",
    "merge_batches": """SELECT o_custkey AS pmid, coalesce(min(o_orderkey) FILTER (o_orderkey % 2 = 0), min(o_orderkey)) AS row_ord, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > 0 THEN 'first' ELSE 'second' END AS batch FROM orders GROUP BY 1""",
    "dimension_insert": "SELECT DISTINCT p_name, p_type, 1::BIGINT AS n FROM part",
    "link_terms": """WITH b AS (SELECT p_name AS item, min(p_brand) AS brand FROM part GROUP BY 1) SELECT DISTINCT l_orderkey AS doc, p_name AS item, brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b ON item = p_name""",
    "json_arrays": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 10 <> 0 THEN (props::JSON ->> 'k')::INT END AS k FROM events",
    "run_log": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "vector_set": "SELECT vec_id FROM embeddings WHERE label % 2 = 0",
    "kpi_row": """SELECT * FROM (SELECT count(*) AS n_records, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year FROM orders),
(SELECT count(DISTINCT CASE WHEN l_linenumber = 1 THEN l_suppkey END) AS n_first_authors, count(DISTINCT p_name) AS n_keywords FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "table_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "percentiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1",
    "any_field_filter": "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%'",
    "layout_table": """WITH w AS (SELECT l_suppkey, count(*) AS weight FROM lineitem GROUP BY 1), s AS (SELECT min(weight) AS low, max(weight) AS high, quantile_cont(weight, 0.5) AS p50, quantile_cont(weight, 0.75) AS p75 FROM w)
SELECT l_suppkey, round(10 + sqrt((weight - low) / (high - low + 1e-9)) * 40, 5) AS size, round(1 + ln(1 + weight - low) / ln(1 + high - low + 1e-9) * 7, 5) AS width, CASE WHEN weight >= p75 THEN 1 WHEN weight >= p50 THEN 2 ELSE 3 END AS tier FROM w, s""",
    "community_palette": "SELECT n_nationkey, ((dense_rank() OVER (ORDER BY n_nationkey) - 1) % 16)::INT AS colour FROM nation",
}
