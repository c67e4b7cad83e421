"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions on one machine that name no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/papergraph"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINTS


#: Spark deletes the shuffle files of a step when it has ended: what follows reads the table that it wrote.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to Python at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Parts that a shuffle deals rows into, and whether small ones are merged.
PARTITIONS, MERGED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"


def written(df: DataFrame, name: str, batch: int | None = None, parts: int | None = None) -> DataFrame:
    """Writes df to the folder that the cluster shares, and reads it again.

    batch: rows that go to Python at a time, where they are large; parts: into how many its shuffles deal rows, none being merged.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {}) | ({PARTITIONS: str(parts), MERGED: "false"} if parts else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a written table. Nothing may read it any more, plans that have not run yet included."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
