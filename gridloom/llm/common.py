"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can read: spark.checkpoint.dir of the session.

    Only a local master (tests) may leave that unset: then a folder of our own is made and set. Elsewhere it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: by sorting and merging. The planner would send a compressed table to the driver
    and to all executors as long as it looks small."""
    return left.join(right.hint("merge"), on, how)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, that no column of df has (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df stored with a number of its own for each row, and the number's column name. Stored, so that every use sees the same numbers."""
    row = free_name(df, "_row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), name), row


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column number `text` holds about `limit` bytes at most (one row at least)."""
    for batch in batches:
        begin, held = 0, 0
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def next_in_order(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df with next_key: the key after its own in descending order; after the last: the first. df has a row for each key, none null.

    The rows are range-partitioned, so df is to be small beside the data (keys and numbers): each range finds its successors
    in a window of its own, and the largest key of the range below, from a table with a row a range, closes the gap.
    """
    keys = checkpointed(df.repartitionByRange(F.col(key).desc()).withColumn("_part", F.spark_partition_id()))
    inside = keys.withColumn("_next", F.lead(key).over(W.partitionBy("_part").orderBy(F.col(key).desc())))
    heads = keys.groupBy("_part").agg(F.max(key).alias("_head"))
    # One row for each range: its size follows the number of partitions, not the rows.
    ring = W.orderBy("_part")
    heads = heads.select(
        F.col("_part"),
        F.coalesce(F.lead("_head").over(ring), F.first("_head").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_after"),
    )
    return inside.join(heads, "_part").withColumn(f"next_{key}", F.coalesce("_next", "_after")).drop("_part", "_next", "_after")
