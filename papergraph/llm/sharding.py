"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papergraph.llm.common import partitions, saved


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in order of their id, into n_shards runs of nearly equal bytes.

    The rows are dealt into ranges of ids, the ranges' totals summed up, and each row's place in all bytes is its
    range's offset plus the sum inside the range. A row goes to the shard that holds the middle of its bytes, so a
    shard differs from the mean by less than one document. Only ids, sizes and checksums move, never texts.

    A null text counts one byte (as an empty one) and has checksum 0. Null ids come first. Rows with one id, repeated
    rows too, stay and are ordered by checksum and size. An empty table gives an empty result; other columns are
    neither read nor returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = sized.repartitionByRange(partitions(docs), *order).withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "shard-ranges")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        .join(F.broadcast(totals), "part")  # a row for each shuffle partition
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .select(
            *order,
            F.least(F.lit(n_shards - 1), F.expr(f"(middle * {n_shards}) div (2 * all_bytes)")).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
        )
    )
    placed = saved(placed, "shard-places")
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row for each shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The checksum is worked out from its polynomial: a table of 256 values, then one step for each byte.
BYTE_SHARDS_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc_table),
summed AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS nth, sum(size) OVER () AS total
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
dealt AS (
  SELECT *, least(15, ((2 * upto - size)::BIGINT * 16) // (2 * total::BIGINT))::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM dealt
"""
