"""Label and land-cover tables: remapping, histograms, shares, coverage, masks, label windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .raster import resample_nearest

# Source land-cover codes to the six classes, and the classes' names.
SIX_CLASSES = {0: 0, 1: 4, 2: 3, 4: 4, 5: 2, 7: 1, 8: 5, 9: 0, 10: 0, 11: 5}
NAMES = {0: "background", 1: "built", 2: "crops", 3: "trees", 4: "water", 5: "rangeland_bare"}


def remap_classes(df: DataFrame, code: str = "code", mapping: dict[int, int] | None = None, keep_raw: bool = False) -> DataFrame:
    """Codes by a map literal; unknown ones become 0. keep_raw leaves them as they are."""
    if keep_raw:
        return df
    m = F.create_map(*(F.lit(x) for kv in (mapping or SIX_CLASSES).items() for x in kv))
    return df.withColumn(code, F.coalesce(F.try_element_at(m, F.col(code)), F.lit(0)))


def class_histogram(df: DataFrame, code: str = "code") -> DataFrame:
    return df.groupBy(code).agg(F.count("*").alias("pixels"))


def class_share_by_year(df: DataFrame, code: str = "code", year: str = "year") -> DataFrame:
    """year, class_id, class_name, pixels, share; classes that a year lacks have 0."""
    counts = df.groupBy(year, code).agg(F.count("*").alias("pixels"))
    totals = df.groupBy(year).agg(F.count("*").alias("_n"))
    names = F.array(*(F.struct(F.lit(k).alias("class_id"), F.lit(v).alias("class_name")) for k, v in NAMES.items()))
    every = totals.withColumn("c", F.explode(names)).select(year, "_n", "c.*")
    out = every.join(counts.withColumnRenamed(code, "class_id"), [year, "class_id"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))
    return out.select(year, "class_id", "class_name", "pixels", (F.col("pixels") / F.col("_n")).alias("share"))


def minority_classes(shares: DataFrame, min_share: float) -> DataFrame:
    return shares.where((F.col("share") < min_share) & (F.col("pixels") > 0))


def scene_coverage(patches: DataFrame, labels: DataFrame, years: list[int]) -> DataFrame:
    """scene_id, labelled patches and their percentage (3 digits, 0 without patches) for each year, n_patches."""
    expected = patches.groupBy("scene_id").agg(F.count("*").alias("n_patches"))
    found = labels.groupBy("scene_id").pivot("year", years).agg(F.count(F.lit(1)))
    out = found.join(expected, "scene_id", "full").na.fill(0)
    pct = lambda y: F.when(F.col("n_patches") == 0, 0.0).otherwise(F.bround(F.col(f"`{y}`") / F.col("n_patches") * 100, 3))
    return out.select("scene_id", *(F.col(f"`{y}`").alias(f"n_{y}") for y in years), "n_patches", *(pct(y).alias(f"pct_{y}") for y in years))


def class_delta(df: DataFrame, class_id: int, y0: int, y1: int, code: str = "code", year: str = "year") -> DataFrame:
    """Pixels of a class in two years, the difference, and its percentage (null from 0); no row unless both years are there."""
    n = lambda y: F.count_if((F.col(year) == y) & (F.col(code) == class_id))
    both = df.agg(n(y0).alias("pixels_0"), n(y1).alias("pixels_1"), F.count_if(F.col(year) == y0).alias("_0"), F.count_if(F.col(year) == y1).alias("_1"))
    d = F.col("pixels_1") - F.col("pixels_0")
    return both.where("_0 > 0 AND _1 > 0").select("pixels_0", "pixels_1", d.alias("delta"), (d / F.nullif(F.col("pixels_0"), F.lit(0)) * 100).alias("delta_pct"))


def threshold_mask(df: DataFrame, keys: list[str], limit: float = 140) -> DataFrame:
    """keys, px, mask: 1 where the mean over bands reaches the limit."""
    return df.groupBy(*keys, "px").agg(F.avg("v").alias("_m")).select(*keys, "px", (F.col("_m") >= limit).cast("int").alias("mask"))


def threshold_mask_bands(bands: Column | str, limit: float = 140) -> Column:
    """threshold_mask() of an array: a mask by pixel, inside the row."""
    b = S.col(bands)
    mean = lambda k: F.aggregate(b, F.lit(0.0), lambda a, p: a + F.get(p, k)) / F.size(b)
    return F.transform(b[0], lambda _, k: (mean(k) >= limit).cast("int"))


def positive_share_of(mask: Column | str) -> Column:
    """positive_share() of an array; null without pixels."""
    m = S.col(mask)
    return F.aggregate(m, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(m), F.lit(0))


def positive_share(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.groupBy(*keys).agg(F.avg("mask").alias("building_share"))


def slice_labels(patches: DataFrame, labels: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """Each patch's window of the label grid of its tile, by nearest cell: (patch_path, px, v). patches has tile, labels (tile, px, v)."""
    window = resample_nearest(labels, ["tile"], width, height, size, size)
    return patches.select("patch_path", "tile").join(window, "tile").select("patch_path", "px", "v")


def slice_labels_by_bounds(patches: DataFrame, mosaic: DataFrame, cell: float, tile: int, size: int) -> DataFrame:
    """(patch_path, px, v): each patch's window of a label mosaic, cut at the patch's own bounds; a window cell takes the mosaic cell that holds its centre.

    mosaic: (tile_x, tile_y, codes), codes a flat array of tile x tile cells of side `cell`, rows from the top; tile (i, j) lies at
    x = i * tile * cell, y = j * tile * cell. A patch meets the tiles under it by their numbers, and each gives the window cells that fall
    in it, so tiles move once for each patch over them, and cells outside the mosaic are left out.
    """
    side = tile * cell
    n = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side).cast("int"), F.greatest(F.ceil(F.col(hi) / side).cast("int") - 1, F.floor(F.col(lo) / side).cast("int")))
    met = patches.select("patch_path", "minx", "miny", "maxx", "maxy", F.explode(n("minx", "maxx")).alias("tile_x"), n("miny", "maxy").alias("_y")).withColumn("tile_y", F.explode("_y"))
    met = met.drop("_y").join(mosaic.select("tile_x", "tile_y", "codes"), ["tile_x", "tile_y"])
    x = lambda px: F.col("minx") + (px % size + 0.5) * (F.col("maxx") - F.col("minx")) / size
    y = lambda px: F.col("maxy") - (F.floor(px / size) + 0.5) * (F.col("maxy") - F.col("miny")) / size
    cells = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda px: F.struct(px.alias("px"), F.floor(x(px) / cell).cast("int").alias("cx"), F.floor(y(px) / cell).cast("int").alias("cy")))
    col, row = (lambda c: c["cx"] - F.col("tile_x") * tile), (lambda c: (F.col("tile_y") + 1) * tile - 1 - c["cy"])
    own = F.filter(cells, lambda c: (col(c) >= 0) & (col(c) < tile) & (row(c) >= 0) & (row(c) < tile))
    return met.select("patch_path", F.explode(F.transform(own, lambda c: F.struct(c["px"].alias("px"), F.get("codes", row(c) * tile + col(c)).alias("v")))).alias("c")).select("patch_path", "c.px", "c.v")


def scene_stats(scenes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """By quarter, by satellite, satellites against resolution buckets, and by bucket."""
    quarter = scenes.groupBy("quarter").agg(F.count("*").alias("n"), (F.sum("file_size_mb") / 1024).alias("gb"), F.array_join(F.sort_array(F.collect_set("satellite")), ",").alias("satellites"))
    satellite = scenes.groupBy("satellite").agg(F.count("*").alias("n"), F.avg("gsd_m").alias("mean_gsd"))
    cross = scenes.groupBy("satellite").pivot("gsd_bucket", ["sub_meter", "sub_1p5m", "around_2m", "coarse"]).agg(F.count(F.lit(1))).na.fill(0)
    bucket = scenes.groupBy("gsd_bucket").agg(F.count("*").alias("n"), F.min("gsd_m").alias("min_gsd"), F.max("gsd_m").alias("max_gsd"))
    return quarter, satellite, cross, bucket


def coverage_holes(qc: DataFrame, key: str, limit: float = 0.1, rows: int = 30) -> DataFrame:
    return qc.where(F.col("center_dark_ratio") > limit).orderBy(F.desc("center_dark_ratio"), key).limit(rows)
