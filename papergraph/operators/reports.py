"""Report tables: trends, shares, productivity, corpus figures, and rows kept by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; null keys are keys too."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def trend(df: DataFrame, period: str) -> DataFrame:
    """period, n, cumulative, mean and direction (up, down, neutral against the period before). A row per period is small."""
    counts = df.where(F.col(period).isNotNull()).groupBy(F.col(period).alias("period")).agg(F.count("*").alias("n"))
    order = Window.orderBy("period")
    before = F.lag("n").over(order)
    return counts.select(
        "period",
        "n",
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        F.round(F.avg("n").over(Window.partitionBy()), 6).alias("mean"),
        F.when(F.col("n") > before, "up").when(F.col("n") < before, "down").otherwise("neutral").alias("direction"),
    )


def momentum(df: DataFrame, period: str) -> DataFrame:
    """One row: recent and prior mean of three periods each, and rising, falling or stable at a tenth of difference."""
    counts = df.where(F.col(period).isNotNull()).groupBy(F.col(period).alias("period")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("back", F.row_number().over(Window.orderBy(F.desc("period"))))
    means = ranked.agg(F.avg(F.when(F.col("back") <= 3, F.col("n"))).alias("recent"), F.avg(F.when(F.col("back").between(4, 6), F.col("n"))).alias("prior"), F.count("*").alias("n_periods"))
    ratio = F.col("recent") / F.col("prior")
    word = F.when((F.col("n_periods") < 6) | (F.col("prior") <= 0), "unknown").when(ratio > 1.1, "rising").when(ratio < 0.9, "falling").otherwise("stable")
    return means.select(F.round("recent", 6).alias("recent"), F.round("prior", 6).alias("prior"), word.alias("momentum"))


def topic_evolution(df: DataFrame, topic: str, period: str) -> DataFrame:
    """topic, period, n and share: percent of the period's rows."""
    counts = df.where(F.col(topic).isNotNull() & F.col(period).isNotNull()).groupBy(F.col(topic).alias("topic"), F.col(period).alias("period")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("period"))
    return counts.select("topic", "period", "n", F.round(100 * F.col("n") / total, 6).alias("share"))


def author_productivity(links: DataFrame, author: str, position: str, k: int = 15) -> DataFrame:
    """The k authors with the most entries: n_first (position 1), n_co and n."""
    counted = links.where(F.col(author).isNotNull()).groupBy(F.col(author).alias("author")).agg(
        F.count_if(F.col(position) == 1).alias("n_first"), F.count_if(F.col(position) > 1).alias("n_co"), F.count("*").alias("n")
    )
    return counted.orderBy(F.desc("n"), "author").limit(k)


def last_turns(turns: DataFrame, k: int = 4, chars: int = 400) -> DataFrame:
    """conv_id and history: the last k turns, oldest first, as `ROLE: text` lines of that many characters at most.

    A null role counts as user, a null text as empty.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    last = turns.select("conv_id", "turn", F.upper(F.coalesce("role", F.lit("user"))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = last.withColumn("back", F.row_number().over(order)).where(F.col("back") <= k)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, chars))
    rows = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))).alias("rows"))
    return rows.select("conv_id", F.array_join("rows.line", "\n").alias("history"))


def text_search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in one of the columns, whatever the case; % and _ in it stand for any characters."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return df.where(found)


def auto_trend(df: DataFrame, date: str, years: int = 3, share: float = 0.5) -> DataFrame:
    """period and n, by month if the years span fewer than `years` and that share of all rows has a month, else by year.

    date is a partial ISO date. Missing periods are not filled; rows without a year, or in months without one, count nowhere.
    """
    rows = df.select(F.when(F.col(date).rlike(r"^\d{4}"), F.col(date)).alias("date"))
    year = F.substring("date", 1, 4)
    figures = rows.agg((F.max(year.cast("int")) - F.min(year.cast("int"))).alias("span"), F.avg((F.coalesce(F.length("date"), F.lit(0)) >= 7).cast("int")).alias("dated"))
    monthly = (F.col("span") < years) & (F.col("dated") >= share)
    period = F.when(monthly, F.when(F.length("date") >= 7, F.substring("date", 1, 7))).otherwise(year)
    return rows.join(F.broadcast(figures)).select(period.alias("period")).where("period IS NOT NULL").groupBy("period").agg(F.count("*").alias("n"))


def topic_pivot(df: DataFrame, topic: str, period: str, label: str, chars: int = 30) -> DataFrame:
    """period and topic (its label's first characters) with n, 0 where a period has none; the topic -1 is left out.

    Long form: a row for each period and topic, so that the number of topics may grow.
    """
    rows = df.where(F.col(topic) != -1).select(F.col(period).alias("period"), F.substring(F.col(label), 1, chars).alias("topic"))
    counts = rows.groupBy("period", "topic").agg(F.count("*").alias("n"))
    grid = rows.select("period").distinct().join(rows.select("topic").distinct())  # periods times topics, a report's size
    return grid.join(counts, ["period", "topic"], "left").select("period", "topic", F.coalesce("n", F.lit(0)).alias("n"))


def most_common(df: DataFrame, item: str, order: str, k: int = 20) -> DataFrame:
    """item and n of the k most frequent items, ties to the one seen first by order."""
    counts = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first", "item").limit(k).select("item", "n")


def records_by_topic(df: DataFrame, topic: str, year: str, title: str, doc: str, k: int = 5) -> DataFrame:
    """topic, rank, doc and title: each topic's k latest records with a title; ties by doc, null years last."""
    order = Window.partitionBy("topic").orderBy(F.desc_nulls_last("year"), "doc")
    rows = df.where(F.trim(title) != "").select(F.col(topic).alias("topic"), F.col(year).alias("year"), F.col(title).alias("title"), F.col(doc).alias("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("topic", "rank", "doc", "title")


def cluster_panel(nodes: DataFrame, community: str = "community") -> DataFrame:
    """One row: number of communities, and name and size of the largest (the least of equal ones)."""
    sizes = nodes.where(F.col(community).isNotNull()).groupBy(F.col(community).alias("c")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_communities"), F.max("n").alias("largest_size"), F.min_by("c", F.struct(-F.col("n"), F.col("c"))).alias("largest"))
