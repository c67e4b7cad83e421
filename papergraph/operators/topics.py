"""Topics: TF-IDF vectors, clusters, topic words, assignments, sizes and their course over time."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.functions.text import without_accents, topic_label
from papergraph.operators.storage import forget, written

# Words of any study that tell nothing of its topic, beside the English stop words.
STUDY_WORDS = """study studies result results method methods conclusion conclusions background objective objectives
purpose introduction discussion abstract paper aim aims finding findings patient patients analysis data used using based significantly
significant showed shown found reported compared associated respectively however therefore although including included total number group groups
control controls effect effects level levels increase increased decrease decreased high higher low lower similar different known novel
important role function type types sample samples case cases activity activities""".split()
OUTLIER = -1


def topic_count(n_docs: int, most: int = 10, size: int = 5) -> int:
    """How many topics: one for each `size` documents, two at least, `most` at most."""
    return min(most, max(2, n_docs // max(size, 1)))


def least_topic_size(n_docs: int, most: int = 5) -> int:
    return max(3, min(most, n_docs // 10))


#: The settings that are tried until one finds a term: stop words (all, English alone, none), least documents, words per term
#: (0: single characters), most terms.
SETTINGS = ((2, 2, 2, 10_000), (2, 1, 2, 10_000), (1, 1, 1, 5_000), (0, 1, 0, 2_000))


def terms(docs: DataFrame, doc: str, text: str, stop: int = 2, words: int = 2) -> DataFrame:
    """doc and terms (an array, with repeats) of each row: words of two characters at least and runs of as many as `words`.

    stop: 0 for none, 1 for English stop words, 2 for those and the words of any study. With words 0 a term is a character
    without its accent, each word having a blank on both sides. Null texts have no terms.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not words:
        plain = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(F.trim(without_accents(F.lower("text"))), r"(?U)\s+", "  "), F.lit(" ")), "^ +$", "")
        return rows.select("doc", F.filter(F.split(plain, ""), lambda c: c != "").alias("terms"))
    split = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(rows)
    unwanted = [[], StopWordsRemover.loadDefaultStopWords("english"), StopWordsRemover.loadDefaultStopWords("english") + STUDY_WORDS][stop]
    kept = StopWordsRemover(inputCol="words", outputCol="kept", stopWords=unwanted).transform(split)
    if words == 1:
        return kept.select("doc", F.col("kept").alias("terms"))
    return NGram(n=2, inputCol="kept", outputCol="pairs").transform(kept).select("doc", F.concat("kept", "pairs").alias("terms"))


def tf_idf(docs: DataFrame, doc: str, text: str, settings=SETTINGS) -> tuple[DataFrame, list[str]]:
    """doc and features (a sparse vector of length 1, or of zeros) of each row, and the terms, by the first settings that find any.

    The most frequent terms count, idf being ln((1 + n) / (1 + df)) + 1. The vectors stay sparse: nothing has the size of
    the vocabulary for each document. No term under any settings: vectors of one zero, and no terms.
    """
    for stop, least, words, most in settings:
        found = written(terms(docs, doc, text, stop, words), "topic-terms")
        counter = CountVectorizer(inputCol="terms", outputCol="counts", minDF=least, vocabSize=most).fit(found)
        if not counter.vocabulary:
            forget(found)
            continue
        counted = counter.transform(found).select("doc", "counts")
        idf = IDF(inputCol="counts", outputCol="w").fit(counted).idf
        weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1), inputCol="counts", outputCol="weighed").transform(counted)
        return Normalizer(inputCol="weighed", outputCol="features").transform(weighed).select("doc", "features"), counter.vocabulary
    return docs.select(F.col(doc).alias("doc"), array_to_vector(F.array(F.lit(0.0))).alias("features")), []


def fit_topics(vectors: DataFrame, k: int, seeds: int = 10, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """doc, topic_id and probability (1, as clusters are hard), and the centres: the best of several starts of k-means.

    vectors: doc and features (an ML vector).
    """
    vectors = written(vectors, "topic-vectors")
    best = None
    for i in range(seeds):
        model = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="topic_id").fit(vectors)
        if best is None or model.summary.trainingCost < best[0]:
            best = model.summary.trainingCost, model
    return best[1].transform(vectors).select("doc", "topic_id", F.lit(1.0).alias("probability")), [list(map(float, c)) for c in best[1].clusterCenters()]


def dense_topics(vectors: DataFrame, k: int, least_size: int = 5, dims: int = 5, reach: float = 2.0, seed: int = 42) -> DataFrame:
    """doc, topic_id, probability and distance of vectors (doc, features): reduced to `dims` components, then split into at most k topics.

    The clusters come from halving the largest ones again and again. Outliers have topic -1 and probability 0: documents
    whose distance from their cluster's centre is more than `reach` times the root mean square distance in it, and those
    of clusters with fewer than least_size other documents. The topics left are numbered by size, then by the old number.
    """
    width = vectors.first()
    if width is None:
        return vectors.select("doc", F.lit(0).alias("topic_id"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("distance"))
    reduced = PCA(k=min(dims, width["features"].size), inputCol="features", outputCol="reduced").fit(vectors).transform(vectors).select("doc", "reduced")
    reduced = written(reduced, "topic-reduced")
    model = BisectingKMeans(k=k, seed=seed, featuresCol="reduced", predictionCol="cluster").fit(reduced)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    square = F.aggregate(F.zip_with(vector_to_array("reduced"), "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)
    placed = written(model.transform(reduced).join(F.broadcast(centres), "cluster").select("doc", "cluster", F.sqrt(square).alias("distance")), "topic-placed")
    return cut_outliers(placed, least_size, reach)


def cut_outliers(placed: DataFrame, least_size: int, reach: float) -> DataFrame:
    """doc, topic_id, probability and distance of documents (doc, cluster, distance), by the rule of dense_topics."""
    spread = placed.groupBy("cluster").agg((reach * F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("most"))
    near = placed.join(F.broadcast(spread), "cluster").withColumn("near", F.col("distance") <= F.col("most"))  # a row for each cluster
    sizes = near.where("near").groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    numbers = sizes.select("cluster", (F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1).alias("number"))
    topic = F.when(F.col("near"), F.col("number"))
    return near.join(F.broadcast(numbers), "cluster", "left").select("doc", F.coalesce(topic, F.lit(OUTLIER)).cast("int").alias("topic_id"), F.when(topic.isNotNull(), 1.0).otherwise(0.0).alias("probability"), "distance")


def centre_words(spark, centres: list[list[float]], terms: list[str], k: int = 15) -> DataFrame:
    """topic_id, rank, word and score: the k largest weights of each centre, without digits and single letters."""
    rows = [(t, i + 1, terms[j], c[j]) for t, c in enumerate(centres) for i, j in enumerate(sorted(range(len(c)), key=lambda j: -c[j])[:k])]
    return spark.createDataFrame(rows, "topic_id int, rank int, word string, score double").where((F.length("word") > 1) & ~F.col("word").rlike(r"^\d+$"))


def class_words(docs: DataFrame, topic: str, text: str, k: int = 10) -> DataFrame:
    """topic, rank, word and score by class-based TF-IDF: tf in the topic times ln(1 + A / tf of all), A words per topic on average.

    Words are runs of letters and digits of two characters at least, in lower case. Ties go to the smaller word.
    """
    words = docs.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))).alias("word"))
    counts = words.groupBy("topic", "word").agg(F.count("*").alias("tf"))
    total = counts.groupBy("word").agg(F.sum("tf").alias("of_all"))
    mean = counts.agg((F.sum("tf") / F.countDistinct("topic")).alias("mean"))
    score = F.round(F.col("tf") * F.ln(1 + F.col("mean") / F.col("of_all")), 6)
    rows = counts.join(total, "word").join(F.broadcast(mean)).select("topic", "word", score.alias("score"))
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "word")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("topic", "rank", "word", "score")


def topic_summary(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """topic_id, label (five words) and paper_count, the largest first; outliers are left out.

    assigned: doc and topic_id; words: topic_id, rank, word. A topic without words is called by its number.
    """
    listed = words.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("words"))
    counts = assigned.where(F.col("topic_id") >= 0).groupBy("topic_id").agg(F.count("*").alias("paper_count"))
    label = F.coalesce(F.nullif(topic_label("words"), F.lit("")), F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    return counts.join(listed, "topic_id", "left").select("topic_id", label.alias("label"), "paper_count").orderBy(F.desc("paper_count"), "topic_id")


def topics_over_time(assigned: DataFrame, years: DataFrame, words: DataFrame | None = None, bins: int | None = None, shown: int = 5) -> DataFrame:
    """topic_id, period and n: a topic's documents by year (doc, year), or by the start of one of so many equal ranges of years.

    With words (topic_id, rank, word) also the topic's first words, joined by commas. Null years are left out.
    """
    rows = assigned.join(years.where("year IS NOT NULL"), "doc")
    if bins:
        span = years.agg(F.min("year").alias("low"), (F.max("year") - F.min("year") + 1).alias("span"))
        rows = rows.join(F.broadcast(span)).withColumn("year", F.floor(F.col("low") + F.floor((F.col("year") - F.col("low")) * bins / F.col("span")) * F.col("span") / bins).cast("int"))
    counts = rows.groupBy("topic_id", F.col("year").alias("period")).agg(F.count("*").alias("n"))
    if words is None:
        return counts
    listed = words.where(F.col("rank") <= shown).groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"], ", ").alias("words"))
    return counts.join(listed, "topic_id", "left").select("topic_id", "words", "period", "n")


def topic_network(assigned: DataFrame, words: DataFrame) -> DataFrame:
    """src < dst and weight of topics: documents that both have, or, where no two share any, words that both have.

    assigned: doc and topic_id (several rows for a document if it has several topics); words: topic_id, word. Only topics
    with words count, outliers never.
    """
    def meet(rows, by):
        rows = rows.distinct()
        other = rows.select(by, F.col("topic_id").alias("dst"))
        return rows.select(by, F.col("topic_id").alias("src")).join(other, by).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))

    words = words.where(F.col("topic_id") >= 0)
    valid = words.select("topic_id").distinct()
    shared = meet(assigned.join(valid, "topic_id", "left_semi").select("doc", "topic_id"), "doc")
    if not shared.isEmpty():
        return shared
    return meet(words.where(F.length("word") > 1).select(F.lower("word").alias("word"), "topic_id"), "word")
