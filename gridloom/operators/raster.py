"""Rasters as tables. Cell form: rows (tile, band, px, v), px = row * width + col. Array form: array<array<double>> by band.

Functions of columns work on the array form, inside a row: nothing is shuffled. Those of DataFrames are for pixels that lie in cell form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Bands of each preset by place, and the channels a model takes; null keeps all.
PRESETS = {
    "s2_full": (list(range(10)), 10),
    "rgb": ([3, 2, 1], 3),
    "rgb_3band": (None, 3),
    "rgb_sar": ([3, 2, 1], 4),
    "gf2": ([3, 2, 1, 7], 4),
    "sar_only": (None, 2),
    "s2_floods": (list(range(13)), 13),
}


def explode_pixels(df: DataFrame, keys: list[str], bands: str = "bands") -> DataFrame:
    b = df.select(*keys, F.posexplode(bands).alias("band", "_p"))
    return b.select(*keys, "band", F.posexplode("_p").alias("px", "v"))


def assemble(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and bands, from cell form; a pixel is placed by its order."""
    flat = df.groupBy(*keys, "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("px", "v"))), lambda s: s["v"]).alias("_p"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "_p"))), lambda s: s["_p"]).alias("bands"))


def select_bands(bands: Column | str, indices: list[int] | None) -> Column:
    """Bands by place in the given order; all where no places are given."""
    b = S.col(bands)
    return b if indices is None else F.array(*(b[i] for i in indices))


def preset_bands(bands: Column | str, preset: str) -> Column:
    """A preset's bands, filled with zeros up to its number of channels."""
    indices, n = PRESETS[preset]
    return fit_channels(select_bands(bands, indices), n)


def fit_channels(bands: Column | str, n: int) -> Column:
    """The first n bands, with bands of zeros where there are fewer."""
    b = S.col(bands)
    zeros = F.transform(b[0], lambda x: x * 0)
    return F.slice(F.concat(b, F.array_repeat(zeros, n)), 1, n)


def fit_size(df: DataFrame, width: int, height: int, to_width: int, to_height: int, keys: list[str]) -> DataFrame:
    """Cell form cropped or filled with zeros to another width and height."""
    rows = df.select(*keys, "band").distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(to_width * to_height - 1))))
    r, c = F.floor(F.col("px") / width), F.col("px") % width
    moved = df.where((r < to_height) & (c < to_width)).withColumn("px", (r * to_width + c).cast("int"))
    return rows.join(moved, [*keys, "band", "px"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def zscore(df: DataFrame, keys: list[str], ddof: int = 1, log1p: bool = False, eps: float = 1e-6) -> DataFrame:
    """(v - mean) / (std + eps) in each group; ddof picks the sample or the population deviation."""
    if log1p:
        df = df.withColumn("v", S.log1p_scale("v"))
    stats = df.groupBy(*keys).agg(F.avg("v").alias("_m"), (F.stddev_samp if ddof else F.stddev_pop)("v").alias("_s"))
    return df.join(stats, keys).withColumn("v", (F.col("v") - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def drop_empty_tiles(df: DataFrame, tile: list[str], max_zero: float = 0.5) -> DataFrame:
    """Without tiles of which more than max_zero of all values are 0."""
    bad = df.groupBy(*tile).agg(F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0)).alias("_z")).where(F.col("_z") > max_zero)
    return df.join(bad.select(*tile), tile, "left_anti")


def thumb_stats(df: DataFrame, keys: list[str], width: int, height: int, dark: float = 5, share: float = 0.5) -> DataFrame:
    """Ratio of dark pixels (all bands dark), that of the centre window, mean and population deviation of the others over all bands."""
    px = df.groupBy(*keys, "px").agg(F.max("v").alias("_top"), F.sum("v").alias("_s"), F.sum(F.col("v") * F.col("v")).alias("_q"), F.count("*").alias("_n"))
    r, c = F.floor(F.col("px") / width), F.col("px") % width
    w0, h0 = int(width * (1 - share) / 2), int(height * (1 - share) / 2)
    centre = (r >= h0) & (r < height - h0) & (c >= w0) & (c < width - w0)
    black = F.col("_top") <= dark
    light = lambda x: F.sum(F.when(~black, F.col(x)))
    out = px.groupBy(*keys).agg(F.avg(black.cast("double")).alias("black_edge_ratio"), F.avg(F.when(centre, black.cast("double"))).alias("center_dark_ratio"), light("_s").alias("_s"), light("_q").alias("_q"), light("_n").alias("_n"))
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    return out.select(*keys, "black_edge_ratio", "center_dark_ratio", mean.alias("brightness_mean"), F.sqrt(F.greatest(F.col("_q") / F.nullif(F.col("_n"), F.lit(0)) - mean * mean, F.lit(0.0))).alias("brightness_std"))


def resample_average(df: DataFrame, keys: list[str], width: int, factor: int) -> DataFrame:
    r, c = F.floor(F.floor(F.col("px") / width) / factor), F.floor((F.col("px") % width) / factor)
    return df.groupBy(*keys, (r * (width // factor) + c).cast("int").alias("px")).agg(F.avg("v").alias("v"))


def _destination(df: DataFrame, keys: list[str], to_width: int, to_height: int) -> DataFrame:
    return df.select(*keys).distinct().withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(to_width * to_height - 1))))


def resample_nearest(df: DataFrame, keys: list[str], width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each destination cell takes the source cell that holds its centre."""
    d = _destination(df, keys, to_width, to_height)
    r = F.floor((F.floor(F.col("px") / to_width) + 0.5) * height / to_height)
    c = F.floor((F.col("px") % to_width + 0.5) * width / to_width)
    d = d.withColumn("_src", (r * width + c).cast("int"))
    return d.join(df.withColumnRenamed("px", "_src"), [*keys, "_src"]).drop("_src")


def resample_bilinear(df: DataFrame, keys: list[str], width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """From the four source cells around each destination centre, borders repeated."""
    d = _destination(df, keys, to_width, to_height)
    y = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), (F.floor(F.col("px") / to_width) + 0.5) * height / to_height - 0.5))
    x = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), (F.col("px") % to_width + 0.5) * width / to_width - 0.5))
    y0, x0 = F.floor(y), F.floor(x)
    near = [(F.least(y0 + i, F.lit(height - 1)), F.least(x0 + j, F.lit(width - 1)), (y - y0 if i else 1 - (y - y0)) * (x - x0 if j else 1 - (x - x0))) for i in (0, 1) for j in (0, 1)]
    d = d.withColumn("_n", F.explode(F.array(*(F.struct((r * width + c).cast("int").alias("src"), w.alias("w")) for r, c, w in near))))
    met = d.select(*keys, "px", F.col("_n.src").alias("_src"), F.col("_n.w").alias("_w")).join(df.withColumnRenamed("px", "_src"), [*keys, "_src"])
    return met.groupBy(*keys, "px").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def stack_sources(sources: list[DataFrame], channels: list[int], keys: list[str]) -> DataFrame:
    """Sources on one grid as one raster: each one's bands follow the ones before; only cells that all have are kept."""
    out, before = None, 0
    for df, n in zip(sources, channels, strict=True):
        part = df.select(*keys, "px", (F.col("band") + before).alias("band"), "v")
        out, before = part if out is None else out.unionByName(part), before + n
    whole = out.groupBy(*keys, "px").agg(F.count("*").alias("_n")).where(F.col("_n") == before)
    return out.join(whole.drop("_n"), [*keys, "px"])


def clip_to_box(df: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centre is in the box; none where the raster is elsewhere."""
    return df.where((x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3]))


def composite(df: DataFrame, keys: list[str], order: str, method: str) -> DataFrame:
    """One value for each cell over time: the first, the latest, or the median."""
    how = {"first": F.min_by("v", order), "latest": F.max_by("v", order), "median": F.percentile("v", 0.5)}[method]
    return df.groupBy(*keys).agg(how.alias("v"))


def scale_01(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """v / 255; with keys, only in groups that go beyond 1."""
    if keys is None:
        return df.withColumn("v", F.col("v") / 255)
    top = df.groupBy(*keys).agg(F.max("v").alias("_t"))
    return df.join(top, keys).withColumn("v", F.when(F.col("_t") > 1, F.col("v") / 255).otherwise(F.col("v").cast("double"))).drop("_t")


def _let(value: Column, use) -> Column:
    """use(value), the value computed once for each row or element."""
    return F.transform(F.array(value), use)[0]


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def zscore_bands(bands: Column | str, ddof: int = 1, log1p: bool = False, eps: float = 1e-6) -> Column:
    """Each band of an array: (v - mean) / (std + eps), as zscore()."""

    def one(b: Column) -> Column:
        v = F.transform(b, S.log1p_scale) if log1p else b
        spread = lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(v) - ddof, F.lit(0)))
        return _let(mean_of(v), lambda m: _let(spread(m), lambda s: F.transform(v, lambda x: (x - m) / (s + eps))))

    return F.transform(S.col(bands), one)


def zero_share(bands: Column | str) -> Column:
    """The share of zeros among all values of all bands."""
    return _let(F.flatten(S.col(bands)), lambda v: F.size(F.filter(v, lambda x: x == 0)) / F.size(v))


def without_empty_tiles(df: DataFrame, bands: str = "bands", max_zero: float = 0.5) -> DataFrame:
    """drop_empty_tiles() for arrays: a filter."""
    return df.where(zero_share(bands) <= max_zero)


def thumb_stats_bands(bands: Column | str, width: int, height: int, dark: float = 5, share: float = 0.5) -> Column:
    """thumb_stats() of an array: struct<black_edge_ratio, center_dark_ratio, brightness_mean, brightness_std>."""
    b = S.col(bands)
    w0, h0 = int(width * (1 - share) / 2), int(height * (1 - share) / 2)
    black = F.transform(b[0], lambda _, k: F.forall(b, lambda p: F.get(p, k) <= dark))
    centre = lambda k: (F.floor(k / width) >= h0) & (F.floor(k / width) < height - h0) & (k % width >= w0) & (k % width < width - w0)

    def stats(of: Column) -> Column:
        middle = F.filter(of, lambda _, k: centre(k))
        part = lambda x: F.size(F.filter(x, lambda y: y)) / F.nullif(F.size(x), F.lit(0))
        light = F.flatten(F.transform(b, lambda p: F.filter(p, lambda _, k: ~F.get(of, k))))
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v), F.lit(0))
        both = _let(light, lambda v: _let(mean(v), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(v), F.lit(0))).alias("std"))))
        return F.struct(part(of).alias("black_edge_ratio"), part(middle).alias("center_dark_ratio"), both["mean"].alias("brightness_mean"), both["std"].alias("brightness_std"))

    return _let(black, stats)


def _resampled(bands: Column | str, n: int, place, value) -> Column:
    """Bands of n pixels, each value(band, place(px)); places are made once for all bands of a row."""
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), place)
    return _let(places, lambda at: F.transform(S.col(bands), lambda b: F.transform(at, lambda p: value(b, p))))


def average_bands(bands: Column | str, width: int, height: int, factor: int) -> Column:
    """resample_average() of an array whose width and height are multiples of the factor."""
    to = width // factor
    near = [i * width + j for i in range(factor) for j in range(factor)]
    first = lambda px: F.floor(px / to).cast("int") * factor * width + (px % to) * factor
    return _resampled(bands, to * (height // factor), first, lambda b, p: sum((F.get(b, p + k) for k in near), F.lit(0.0)) / len(near))


def nearest_bands(bands: Column | str, width: int, height: int, to_width: int, to_height: int) -> Column:
    """resample_nearest() of an array."""
    r = lambda px: F.floor((F.floor(px / to_width) + 0.5) * height / to_height)
    c = lambda px: F.floor((px % to_width + 0.5) * width / to_width)
    return _resampled(bands, to_width * to_height, lambda px: (r(px) * width + c(px)).cast("int"), lambda b, p: F.get(b, p))


def bilinear_bands(bands: Column | str, width: int, height: int, to_width: int, to_height: int) -> Column:
    """resample_bilinear() of an array."""

    def place(px: Column) -> Column:
        y = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), (F.floor(px / to_width) + 0.5) * height / to_height - 0.5))
        x = F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), (px % to_width + 0.5) * width / to_width - 0.5))
        at = F.floor(y) * width + F.floor(x)
        right, below = F.when(F.floor(x) < width - 1, 1).otherwise(0), F.when(F.floor(y) < height - 1, width).otherwise(0)
        return F.struct(at.cast("int").alias("at"), right.alias("right"), below.alias("below"), (x - F.floor(x)).alias("dx"), (y - F.floor(y)).alias("dy"))

    def value(b: Column, p: Column) -> Column:
        top = (1 - p["dx"]) * F.get(b, p["at"]) + p["dx"] * F.get(b, p["at"] + p["right"])
        return (1 - p["dy"]) * top + p["dy"] * ((1 - p["dx"]) * F.get(b, p["at"] + p["below"]) + p["dx"] * F.get(b, p["at"] + p["below"] + p["right"]))

    return _resampled(bands, to_width * to_height, place, value)


def stack_bands(sources: list[DataFrame], keys: list[str], bands: str = "bands") -> DataFrame:
    """stack_sources() for arrays on one grid: tiles that all sources have, each one's bands after those before. Tiles move, not pixels."""
    out = sources[0].select(*keys, F.col(bands).alias("_b0"))
    for k, df in enumerate(sources[1:], 1):
        out = out.join(df.select(*keys, F.col(bands).alias(f"_b{k}")), keys)
    return out.select(*keys, F.concat(*(F.col(f"_b{k}") for k in range(len(sources)))).alias(bands))


def scale_01_bands(bands: Column | str, always: bool = True) -> Column:
    """v / 255 of an array; without `always`, only where a value is beyond 1."""
    b = S.col(bands)
    scaled = lambda by: F.transform(b, lambda p: F.transform(p, lambda x: x / by))
    return scaled(F.lit(255.0)) if always else F.when(F.exists(b, lambda p: F.exists(p, lambda x: x > 1)), scaled(F.lit(255.0))).otherwise(scaled(F.lit(1.0)))
