"""Queries: rasters as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators import tiles as TI
from .registry import query, r6

KEYS = ["patch_id"]


def arrays(t):
    """The pixels of fx_pixels in array form: cut from each embedding, nothing is moved."""
    e = t["embeddings"].select(F.col("vec_id").alias("patch_id"), F.col("label").alias("class_id"), F.col("embedding").cast("array<double>").alias("e"))
    value = lambda x: F.floor((x + 0.6) * 200).cast("int")
    return e.select("patch_id", "class_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.transform(F.slice("e", b * 16 + 1, 16), value)).alias("bands"))


def cells(t):
    return t["fx_pixels"].select("patch_id", "band", "px", "v")


def exploded(df):
    """patch_id, band, px, v to 6 digits."""
    return R.explode_pixels(df, KEYS).withColumn("v", r6("v"))


@query("d1_explode_pixels", "SELECT patch_id, band, px, v FROM fx_pixels")
def _(t):
    return R.explode_pixels(arrays(t), KEYS)


@query("d2_assemble_patch", "SELECT patch_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY band, px) AS vs FROM fx_pixels GROUP BY 1")
def _(t):
    return R.assemble(t["fx_pixels"], KEYS).select("patch_id", F.array_join(F.flatten("bands"), ",").alias("vs"))


@query("d3_select_bands", "SELECT patch_id, CAST(3-band AS INTEGER) AS band, px, v FROM fx_pixels WHERE band>0")
def _(t):
    return R.explode_pixels(arrays(t).select("patch_id", R.select_bands("bands", [3, 2, 1]).alias("bands")), KEYS)


@query("d4_fit_channels", "SELECT patch_id, band, px, v FROM fx_pixels UNION ALL SELECT patch_id, CAST(band+4 AS INTEGER), px, 0 FROM fx_pixels WHERE band<2")
def _(t):
    return R.explode_pixels(arrays(t).select("patch_id", R.fit_channels("bands", 6).alias("bands")), KEYS)


@query("d5_zscore", "SELECT patch_id, band, px, round((v-m)/(s+1e-6),6)+0.0 AS v FROM fx_pixels JOIN (SELECT patch_id, band, avg(v) AS m, stddev_samp(v) AS s FROM fx_pixels GROUP BY ALL) USING(patch_id,band)")
def _(t):
    return exploded(arrays(t).select("patch_id", R.zscore_bands("bands").alias("bands")))


@query("d6_drop_empty_tiles", "WITH z AS (SELECT patch_id, band, px, CASE WHEN v<100+patch_id%30 THEN 0 ELSE v END AS v FROM fx_pixels) SELECT * FROM z WHERE patch_id IN (SELECT patch_id FROM z GROUP BY 1 HAVING avg((v=0)::INT)<=0.5)")
def _(t):
    dim = F.transform("bands", lambda b: F.transform(b, lambda v: F.when(v < 100 + F.col("patch_id") % 30, 0).otherwise(v)))
    return R.explode_pixels(R.without_empty_tiles(arrays(t).withColumn("bands", dim)), KEYS)


@query(
    "d7_thumb_stats",
    """WITH z AS (SELECT patch_id, band, px, greatest(v-130,0) AS v FROM fx_pixels), p AS (SELECT patch_id, px, max(v)<=5 AS b FROM z GROUP BY ALL)
    SELECT patch_id, round(avg(CASE WHEN band=0 THEN b::INT END),6)+0.0 AS black_edge_ratio, round(avg(CASE WHEN band=0 AND px IN (5,6,9,10) THEN b::INT END),6)+0.0 AS center_dark_ratio,
    round(avg(CASE WHEN NOT b THEN v END),6)+0.0 AS brightness_mean, round(stddev_pop(CASE WHEN NOT b THEN v END),6)+0.0 AS brightness_std FROM z JOIN p USING(patch_id,px) GROUP BY 1""",
)
def _(t):
    dim = F.transform("bands", lambda b: F.transform(b, lambda v: F.greatest(v - 130, F.lit(0))))
    s = arrays(t).withColumn("bands", dim).select("patch_id", R.thumb_stats_bands("bands", 4, 4).alias("s"))
    return s.select("patch_id", *(r6(F.col("s")[c]).alias(c) for c in ("black_edge_ratio", "center_dark_ratio", "brightness_mean", "brightness_std")))


@query("d8_resample_average", "SELECT patch_id, band, CAST((px//8)*2+(px%4)//2 AS INTEGER) AS px, round(avg(v),6)+0.0 AS v FROM fx_pixels GROUP BY ALL")
def _(t):
    return exploded(arrays(t).select("patch_id", R.average_bands("bands", 4, 4, 2).alias("bands")))


@query(
    "d8_resample_nearest",
    "SELECT s.patch_id, s.band, CAST(d.px AS INTEGER) AS px, s.v FROM fx_pixels s JOIN (SELECT px, CAST(floor((px//6+0.5)*4/6) AS INTEGER)*4+CAST(floor((px%6+0.5)*4/6) AS INTEGER) AS src FROM range(36) r(px)) d ON d.src=s.px",
)
def _(t):
    return R.explode_pixels(arrays(t).select("patch_id", R.nearest_bands("bands", 4, 4, 6, 6).alias("bands")), KEYS)


@query(
    "d8_resample_bilinear",
    """WITH d AS (SELECT px, greatest(0,least(3,(px//6+0.5)*4/6-0.5)) AS y, greatest(0,least(3,(px%6+0.5)*4/6-0.5)) AS x FROM range(36) r(px)),
    n AS (SELECT px, least(floor(y)+i,3)*4+least(floor(x)+j,3) AS src, (CASE WHEN i=1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN j=1 THEN x-floor(x) ELSE 1-(x-floor(x)) END) AS w FROM d, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j))
    SELECT patch_id, band, CAST(n.px AS INTEGER) AS px, round(sum(w*v),5)+0.0 AS v FROM fx_pixels s JOIN n ON n.src=s.px GROUP BY ALL""",
)
def _(t):
    return R.explode_pixels(arrays(t).select("patch_id", R.bilinear_bands("bands", 4, 4, 6, 6).alias("bands")), KEYS).withColumn("v", F.round("v", 5) + 0.0)


def scene_tiles(t):
    """Scenes of 2 x 3 patches, each patch a tile of 4 x 4; one patch of seventeen is missing."""
    p = arrays(t).where("patch_id % 17 <> 5")
    return p.select(F.floor(F.col("patch_id") / 6).alias("scene"), F.floor(F.col("patch_id") % 6 / 3).cast("int").alias("tile_row"), (F.col("patch_id") % 3).cast("int").alias("tile_col"), "bands")


def _tiled_sql(y: str, x: str, value: str, of: tuple[int, int], to: tuple[int, int], size: int) -> str:
    """Every destination pixel of the whole scene from its four source pixels; missing ones as in operators.tiles."""
    h, w = to
    return f"""WITH s AS (SELECT patch_id//6 AS scene, band, (patch_id%6//3)*4+px//4 AS y, (patch_id%3)*4+px%4 AS x, v FROM fx_pixels WHERE patch_id%17<>5),
    d AS (SELECT i, j, {y.format(i="(i+0.5::DOUBLE)", a=of[0], b=h)} AS cy, {x.format(i="(j+0.5::DOUBLE)", a=of[1], b=w)} AS cx FROM range({h}) r(i), range({w}) c(j)),
    n AS (SELECT scene, band, i, j, cy-floor(cy) AS dy, cx-floor(cx) AS dx, CAST(floor(cy) AS BIGINT) AS y, CAST(floor(cx) AS BIGINT) AS x FROM (SELECT DISTINCT scene, band FROM s), d),
    q AS (SELECT n.*, a.v AS a, b.v AS b, c.v AS c, e.v AS e FROM n LEFT JOIN s a ON a.scene=n.scene AND a.band=n.band AND a.y=n.y AND a.x=n.x LEFT JOIN s b ON b.scene=n.scene AND b.band=n.band AND b.y=n.y AND b.x=n.x+1
     LEFT JOIN s c ON c.scene=n.scene AND c.band=n.band AND c.y=n.y+1 AND c.x=n.x LEFT JOIN s e ON e.scene=n.scene AND e.band=n.band AND e.y=n.y+1 AND e.x=n.x+1)
    SELECT scene, CAST(i//{size} AS INTEGER) AS tile_row, CAST(j//{size} AS INTEGER) AS tile_col, band, CAST((i%{size})*least({size},{w}-(j//{size})*{size})+j%{size} AS INTEGER) AS px, round(coalesce({value},0),5)+0.0 AS v
    FROM q QUALIFY max(a) OVER (PARTITION BY scene, band, i//{size}, j//{size}) IS NOT NULL"""


_CLAMPED, _HELD = "greatest(0,least({a}-1,{i}*{a}/{b}-0.5))", "floor({i}*{a}/{b})"
_BLEND = "CASE WHEN a IS NOT NULL THEN (1-dy)*((1-dx)*a+dx*coalesce(b,a))+dy*((1-dx)*coalesce(c,a)+dx*coalesce(e,c,b,a)) END"


def _tile_pixels(df):
    return R.explode_pixels(df, ["scene", "tile_row", "tile_col"]).withColumn("v", F.round("v", 5) + 0.0)


@query("d8_resample_tiles", _tiled_sql(_CLAMPED, _CLAMPED, _BLEND, (8, 12), (11, 17), 5))
def _(t):
    """Scenes that no row holds whole, resampled over the borders of their tiles."""
    return _tile_pixels(TI.resample_tiles(scene_tiles(t), ["scene"], 4, 8, 12, 5, 11, 17))


@query("d8_resample_tiles_nearest", _tiled_sql(_HELD, _HELD, "a", (8, 12), (5, 7), 3))
def _(t):
    return _tile_pixels(TI.resample_tiles(scene_tiles(t), ["scene"], 4, 8, 12, 3, 5, 7, "nearest"))


@query("d9_stack_sources", "SELECT patch_id, px, CAST(band AS INTEGER) AS band, v FROM fx_pixels WHERE patch_id%5<>0")
def _(t):
    b = arrays(t)
    first, second = b.select("patch_id", F.slice("bands", 1, 2).alias("bands")), b.where("patch_id % 5 <> 0").select("patch_id", F.slice("bands", 3, 2).alias("bands"))
    return R.explode_pixels(R.stack_bands([first, second], KEYS), KEYS).select("patch_id", "px", "band", "v")


@query("d10_clip_to_box", "SELECT patch_id, band, px, v FROM fx_pixels WHERE px%4+0.5 BETWEEN 1 AND 3 AND px//4+0.5 BETWEEN 0 AND 2")
def _(t):
    return R.clip_to_box(cells(t), F.col("px") % 4 + 0.5, F.floor(F.col("px") / 4) + 0.5, (1, 0, 3, 2))


@query(
    "d11_composite",
    "SELECT class_id, band, px, arg_min(v,patch_id) AS first, arg_max(v,patch_id) AS latest, round(quantile_cont(v,0.5),6)+0.0 AS median FROM fx_pixels GROUP BY ALL",
)
def _(t):
    keys = ["class_id", "band", "px"]
    p = t["fx_pixels"]
    parts = [R.composite(p, keys, "patch_id", m).withColumnRenamed("v", m) for m in ("first", "latest", "median")]
    return parts[0].join(parts[1], keys).join(parts[2], keys).withColumn("median", r6("median"))


@query("d12_scale_01", "SELECT patch_id, band, px, round(CASE WHEN patch_id%2=0 THEN (v%2)::DOUBLE ELSE v/255 END,6)+0.0 AS v FROM fx_pixels")
def _(t):
    odd = F.transform("bands", lambda b: F.transform(b, lambda v: F.when(F.col("patch_id") % 2 == 0, v % 2).otherwise(v)))
    return exploded(arrays(t).withColumn("bands", odd).select("patch_id", R.scale_01_bands("bands", always=False).alias("bands")))
