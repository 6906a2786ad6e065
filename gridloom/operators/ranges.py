"""Global orders without one task: range partitions are stored, and a row for each range says what lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Rows before a row's own range, up to the row before it.
_BEFORE = (W.unboundedPreceding, -1)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df in ranges of an order, with its range's number, _part. Stored, so that counts and rows are of one partitioning."""
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """df with _place, each row's place (from 1) in the order."""
    ranges = in_ranges(df, *order)
    # A row for each range: its size follows the number of partitions, not the rows.
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranges.join(before, "_part").withColumn("_place", place).drop("_part", "_before")


def running_sums(df: DataFrame, group: str, order: Column, sums: list[str]) -> DataFrame:
    """df with each sum's running total inside its group, in the order; a group may span many ranges."""
    ranges = in_ranges(df, F.col(group), order)
    totals = ranges.groupBy("_part", group).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    ring = W.partitionBy(group).orderBy("_part").rowsBetween(*_BEFORE)
    before = totals.select("_part", group, *(F.coalesce(F.sum(f"_t_{c}").over(ring), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = W.partitionBy("_part", group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = ranges.withColumns({f"_w_{c}": F.sum(c).over(inside) for c in sums})
    before = before.select(F.col("_part").alias("_before_part"), F.col(group).alias("_before_group"), *(f"_b_{c}" for c in sums))
    met = out.join(before, (F.col("_part") == F.col("_before_part")) & F.col(group).eqNullSafe(F.col("_before_group")))
    return met.select(*df.columns, *((F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"running_{c}") for c in sums))


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the exact percentile at its share, linear between neighbours; null without values."""
    # Equal values are one row with their number, so that a frequent one is no range of its own; a value has the places up to its running total.
    counts = df.select(F.col(value).cast("double").alias("_v"), F.lit(0).alias("_all")).where("_v is not null").groupBy("_all", "_v").agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, "_all", F.col("_v"), ["_n"]).select("_v", F.col("running__n").alias("_to"), (F.col("running__n") - F.col("_n")).alias("_from"))
    n = ranks.agg(F.coalesce(F.max("_to"), F.lit(0))).first()[0]
    out = []
    for name, share in shares.items():
        at = share * max(n - 1, 0)
        low, high = (F.max(F.when((F.col("_from") < k) & (F.col("_to") >= k), F.col("_v"))) for k in (int(at) + 1, min(int(at) + 2, max(n, 1))))
        out.append((low + (high - low) * (at - int(at))).alias(name))
    return ranks.agg(*out)
