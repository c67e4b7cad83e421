"""Tables that are changed in place: rows in buckets of their key, of which a batch rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.operators.records import upsert

BUCKET = "_bucket"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _files(spark, path)
    return files.exists(found)


def _delete(spark: SparkSession, path: str) -> None:
    found, files = _files(spark, path)
    files.delete(found, True)


def create_table(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Writes df as a table of so many buckets of its key. An existing table is replaced."""
    df.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_table(batch: DataFrame, path: str, key: list[str], buckets: int = 64) -> int:
    """Replaces rows whose key the batch has and adds the others; returns how many buckets were rewritten.

    Only buckets that the batch touches are read and written. What they become is first written beside the table and then put
    in its place, so a run that ends in between is made good by the next (or by `recover`), and a batch may come twice. The
    batch must have one row for a key and the columns of the table; buckets must be as the table has them.
    """
    spark = batch.sparkSession
    recover(spark, path)
    new = batch.withColumn(BUCKET, _bucket(key, buckets))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return 0
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    upsert(old, new.select(*old.columns), key).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}-pending")
    recover(spark, path)
    return len(touched)


def recover(spark: SparkSession, path: str) -> None:
    """Puts buckets that were written beside the table, whole, in their place."""
    pending = f"{path}-pending"
    if _exists(spark, f"{pending}/_SUCCESS"):
        spark.read.parquet(pending).repartition(BUCKET).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(path)
    _delete(spark, pending)
