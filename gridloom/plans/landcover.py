"""Queries: labels and land cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import landcover as L
from ..operators import raster as R
from .catalogue import _BUCKET, _SAT, scene_qc
from .pixels import arrays
from .registry import query, r6


def codes(t):
    """Band 3 as class codes 0..11, the patch's parity as year."""
    return t["fx_pixels"].where("band = 3").select("patch_id", "px", (F.col("v") % 12).alias("code"), (F.lit(2022) + F.col("patch_id") % 2).cast("int").alias("year"))


_SIX = "CASE code " + " ".join(f"WHEN {k} THEN {v}" for k, v in L.SIX_CLASSES.items()) + " ELSE 0 END"
_CODES = f"raw AS (SELECT patch_id, px, v%12 AS code, CAST(2022+patch_id%2 AS INTEGER) AS year FROM fx_pixels WHERE band=3), c AS (SELECT patch_id, px, year, {_SIX} AS code FROM raw)"
_NAMES = "(VALUES " + ",".join(f"({k},'{v}')" for k, v in L.NAMES.items()) + ") n(class_id,class_name)"
_SHARES = f"{_CODES}, s AS (SELECT y.year, n.class_id, n.class_name, count(c.px) AS pixels, count(c.px)/any_value(y.n) AS share FROM (SELECT year, count(*) AS n FROM c GROUP BY 1) y CROSS JOIN {_NAMES} LEFT JOIN c ON c.year=y.year AND c.code=n.class_id GROUP BY ALL)"


@query("f1_remap_classes", f"WITH {_CODES} SELECT patch_id, px, CAST(code AS INTEGER) AS code FROM c")
def _(t):
    return L.remap_classes(codes(t)).select("patch_id", "px", "code")


@query("f2_class_histogram", f"WITH {_CODES} SELECT code, count(*) AS pixels FROM raw GROUP BY 1")
def _(t):
    return L.class_histogram(codes(t))


@query("f3_class_share_by_year", f"WITH {_SHARES} SELECT year, class_id, class_name, pixels, round(share,6)+0.0 AS share FROM s")
def _(t):
    return L.class_share_by_year(L.remap_classes(codes(t))).withColumn("share", r6("share"))


@query("f4_minority_classes", f"WITH {_SHARES} SELECT year, class_id, pixels, round(share,6)+0.0 AS share FROM s WHERE share<0.1 AND pixels>0")
def _(t):
    return L.minority_classes(L.class_share_by_year(L.remap_classes(codes(t))), 0.1).select("year", "class_id", "pixels", r6("share").alias("share"))


@query(
    "f5_scene_coverage",
    """WITH e AS (SELECT scene_id, count(*) AS n FROM fx_patches WHERE scene_key%10<>0 GROUP BY 1), l AS (SELECT scene_id, count(*) FILTER (WHERE row%256=0) AS a, count(*) FILTER (WHERE row%256<>0) AS b FROM fx_patches WHERE scene_key%7<>0 GROUP BY 1)
    SELECT scene_id, coalesce(a,0) AS n_2022, coalesce(b,0) AS n_2023, coalesce(n,0) AS n_patches, CASE WHEN n IS NULL THEN 0.0 ELSE round_even(coalesce(a,0)/n*100,3) END::DOUBLE AS pct_2022, CASE WHEN n IS NULL THEN 0.0 ELSE round_even(coalesce(b,0)/n*100,3) END::DOUBLE AS pct_2023 FROM e FULL JOIN l USING(scene_id)""",
)
def _(t):
    p = t["fx_patches"]
    lab = p.where("scene_key % 7 <> 0").select("scene_id", F.when(F.col("row") % 256 == 0, 2022).otherwise(2023).alias("year"))
    return L.scene_coverage(p.where("scene_key % 10 <> 0"), lab, [2022, 2023])


@query("f6_class_delta", f"WITH {_CODES}, k AS (SELECT count(*) FILTER (WHERE year=2022 AND code=2) AS a, count(*) FILTER (WHERE year=2023 AND code=2) AS b FROM c) SELECT a AS pixels_0, b AS pixels_1, b-a AS delta, round((b-a)/a*100,6)+0.0 AS delta_pct FROM k")
def _(t):
    return L.class_delta(L.remap_classes(codes(t)), 2, 2022, 2023).withColumn("delta_pct", r6("delta_pct"))


@query("f7_threshold_mask", "SELECT patch_id, round(avg((m>=120)::INT),6)+0.0 AS building_share FROM (SELECT patch_id, px, avg(v) AS m FROM fx_pixels WHERE band<3 GROUP BY ALL) GROUP BY 1")
def _(t):
    mask = L.threshold_mask_bands(F.slice("bands", 1, 3), 120)
    return arrays(t).select("patch_id", mask.alias("mask")).select("patch_id", r6(L.positive_share_of("mask")).alias("building_share"))


@query(
    "f8_slice_labels",
    f"WITH {_CODES} SELECT patch_path, CAST(d.px AS INTEGER) AS px, CAST(code AS INTEGER) AS v FROM fx_patches p JOIN c ON c.patch_id=p.scene_key%(SELECT count(*) FROM embeddings) JOIN (SELECT px, CAST(floor((px//3+0.5)*4/3) AS INTEGER)*4+CAST(floor((px%3+0.5)*4/3) AS INTEGER) AS src FROM range(9) r(px)) d ON d.src=c.px",
)
def _(t):
    grid = L.remap_classes(codes(t)).select(F.col("patch_id").alias("tile"), "px", F.col("code").alias("v"))
    return L.slice_labels(t["fx_patches"].select("patch_path", (F.col("scene_key") % t["embeddings"].count()).alias("tile")), grid, 4, 4, 3)


# The mosaic: tiles of 4 x 4 cells of 640 m; tile (i, j) has the codes of grid (i * 31 + j) modulo their number.
_MOSAIC = f"""{_CODES}, w AS (SELECT patch_path, px, CAST(floor((minx+(px%5+0.5)*256)/640) AS BIGINT) AS cx, CAST(floor((maxy-(px//5+0.5)*256)/640) AS BIGINT) AS cy FROM fx_patches, range(25) r(px))
SELECT patch_path, CAST(px AS INTEGER) AS px, CAST(code AS INTEGER) AS v FROM (SELECT patch_path, px, (cx//4)*31+cy//4 AS grid, (3-cy%4)*4+cx%4 AS src FROM w) w JOIN (SELECT patch_id, px AS src, code FROM c) c ON c.patch_id=w.grid%(SELECT count(*) FROM embeddings) AND c.src=w.src"""


@query("f8_label_windows_by_bounds", f"WITH {_MOSAIC}")
def _(t):
    grids = L.remap_classes(codes(t)).groupBy("patch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("px", "code"))), lambda c: c["code"]).alias("codes"))
    used = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 2560).cast("int"), F.ceil(F.col(hi) / 2560).cast("int") - 1))
    tiles = t["fx_patches"].select(used("minx", "maxx").alias("tile_x"), "miny", "maxy").select("tile_x", used("miny", "maxy").alias("tile_y")).distinct()
    mosaic = tiles.withColumn("patch_id", (F.col("tile_x").cast("long") * 31 + F.col("tile_y")) % t["embeddings"].count()).join(grids, "patch_id")
    return L.slice_labels_by_bounds(t["fx_patches"], mosaic, 640.0, 4, 5)


def _stats(t, k):
    s = t["fx_scenes"].withColumns({"satellite": S.parse_satellite("scene_id"), "gsd_bucket": S.gsd_bucket("gsd_m")})
    return L.scene_stats(s)[k]


_ST = f"(SELECT *, {_SAT} AS satellite, {_BUCKET} AS gsd_bucket FROM fx_scenes)"


@query("f9_stats_by_quarter", f"SELECT quarter, count(*) AS n, round(sum(file_size_mb)/1024,4)+0.0 AS gb, string_agg(DISTINCT satellite, ',' ORDER BY satellite) AS satellites FROM {_ST} GROUP BY 1")
def _(t):
    return _stats(t, 0).withColumn("gb", F.round("gb", 4) + 0.0)


@query("f9_stats_by_satellite", f"SELECT satellite, count(*) AS n, round(avg(gsd_m),6)+0.0 AS mean_gsd FROM {_ST} GROUP BY 1")
def _(t):
    return _stats(t, 1).withColumn("mean_gsd", r6("mean_gsd"))


@query("f9_satellite_buckets", f"SELECT satellite, " + ", ".join(f"count(*) FILTER (WHERE gsd_bucket='{b}') AS {b}" for b in ("sub_meter", "sub_1p5m", "around_2m", "coarse")) + f" FROM {_ST} GROUP BY 1")
def _(t):
    return _stats(t, 2)


@query("f9_stats_by_bucket", f"SELECT gsd_bucket, count(*) AS n, min(gsd_m) AS min_gsd, max(gsd_m) AS max_gsd FROM {_ST} GROUP BY 1")
def _(t):
    return _stats(t, 3)


@query("f10_coverage_holes", "SELECT scene_key, round((scene_key%40)/100.0,6)+0.0 AS center_dark_ratio FROM fx_scenes WHERE scene_key%5<>0 AND (scene_key%40)/100.0>0.1 ORDER BY (scene_key%40) DESC, scene_key LIMIT 30")
def _(t):
    return L.coverage_holes(scene_qc(t), "scene_key").select("scene_key", r6("center_dark_ratio").alias("center_dark_ratio"))
