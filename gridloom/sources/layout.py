"""Indexes laid out in space: rows that lie near each other lie in the same files, row groups and pages.

Rows are put in ranges of their place on a Hilbert curve. Parquet keeps the least and largest bounds of every row group and page, and Spark
pushes comparisons of bounds into the scan, so a box reads the row groups that may meet it, without an index of its own.

Defined results: boxes with a null bound come first in their folder and are never in a read box. One place that holds a third of all rows is cut
by a hash of the whole row, so no range depends on it; rows equal in all columns stay together. Empty tables are written and read as such.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ["minx", "miny", "maxx", "maxy"]
#: Cells of the curve a side: 2 ** BITS.
BITS = 16


def hilbert(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve, from 0 on; x and y are whole numbers from 0 to 2 ** bits - 1, or null."""
    top = (1 << bits) - 1

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        u, v = a[known].to_numpy(np.int64), b[known].to_numpy(np.int64)
        d = np.zeros(len(u), np.int64)
        for s in (1 << k for k in reversed(range(bits))):
            rx, ry = (u & s) > 0, (v & s) > 0
            d += s * s * ((3 * rx) ^ ry)
            p, q = np.where(rx, top - u, u), np.where(rx, top - v, v)
            u, v = np.where(ry, u, q), np.where(ry, v, p)
        out = pd.Series(pd.array(np.zeros(len(a), np.int64), "Int64"))
        out[~known] = pd.NA
        out[known] = d
        return out

    return place(x.cast("long"), y.cast("long"))


def with_curve(df: DataFrame, extent: tuple[float, float, float, float] | None = None, name: str = "_curve") -> DataFrame:
    """The boxes' centres on the curve over an extent; without one, over that of all rows. Centres outside are put on the border."""
    if extent is None:
        extent = df.agg(*(F.min(c) for c in BOX[:2]), *(F.max(c) for c in BOX[2:])).first()
    top = (1 << BITS) - 1

    def cell(low: str, high: str, a: float | None, b: float | None) -> Column:
        span = (b - a) if a is not None and b is not None and b > a else 1.0
        at = F.floor(((F.col(low) + F.col(high)) / 2 - F.lit(float(a or 0))) / F.lit(float(span)) * top)
        return F.when(at.isNotNull(), F.least(F.lit(top), F.greatest(F.lit(0), at)))

    return df.withColumn(name, hilbert(cell("minx", "maxx", extent[0], extent[2]), cell("miny", "maxy", extent[1], extent[3])))


def write_spatial_index(df: DataFrame, path: str, folders: list[str] | None = None, files: int | None = None, extent: tuple[float, float, float, float] | None = None, row_group: int = 16 << 20, page_rows: int = 2000) -> None:
    """Written in ranges of the curve, inside folders by the named columns. files: ranges in all (default: the session's shuffle partitions)."""
    order = [*(F.col(c) for c in folders or []), F.col("_curve"), F.xxhash64(*df.columns)]
    placed = with_curve(df, extent)
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    out = ranged.sortWithinPartitions(*order).drop("_curve").write.mode("overwrite").option("parquet.block.size", row_group).option("parquet.page.row.count.limit", page_rows)
    (out.partitionBy(*folders) if folders else out).parquet(path)


def meets(box: tuple[float, float, float, float]) -> Column:
    """Boxes that meet a box, borders included; in the form that scans can be pruned by."""
    return (F.col("minx") <= float(box[2])) & (F.col("maxx") >= float(box[0])) & (F.col("miny") <= float(box[3])) & (F.col("maxy") >= float(box[1]))


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of an index that meet the box."""
    return spark.read.parquet(path).where(meets(box))
