"""Queries: datasets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from .registry import query, r6


def labels(t):
    """Labels of two thirds of the patches, in one of two years."""
    p = t["fx_patches"]
    return p.where("row % 384 <> 0").select("patch_path", (F.lit(2022) + F.col("scene_key") % 2).cast("int").alias("year"), ((F.col("scene_key") % 100) / 100.0).alias("building_share"))


_LABELS = "lab AS (SELECT patch_path, CAST(2022+scene_key%2 AS INTEGER) AS year, (scene_key%100)/100.0 AS building_share FROM fx_patches WHERE row%384<>0)"


@query("e4_paired_dataset", f"WITH {_LABELS} SELECT patch_path, quarter, CAST(building_share AS DOUBLE) AS building_share FROM fx_patches JOIN lab USING(patch_path) WHERE year=2022 AND building_share>=0.5")
def _(t):
    return D.paired_dataset(t["fx_patches"], labels(t), 2022, 0.5).select("patch_path", "quarter", "building_share")


@query("e5_scene_split", "WITH s AS (SELECT scene_id, row_number() OVER (ORDER BY scene_id DESC)<=(SELECT greatest(1,CAST(floor(count(DISTINCT scene_id)*0.2) AS INTEGER)) FROM fx_patches) AS v FROM (SELECT DISTINCT scene_id FROM fx_patches)) SELECT patch_path, CASE WHEN v THEN 'val' ELSE 'train' END AS split FROM fx_patches JOIN s USING(scene_id)")
def _(t):
    return D.scene_split(t["fx_patches"], 0.2).select("patch_path", "split")


@query("e6_patch_split", f"SELECT patch_path, CASE WHEN md5(patch_path||'|42')[1:8]<'{int(0.2 * 16**8):08x}' THEN 'val' ELSE 'train' END AS split FROM fx_patches")
def _(t):
    return D.patch_split(t["fx_patches"], "patch_path", 0.2, 42).select("patch_path", "split")


@query("e7_cap_samples", "SELECT patch_path FROM fx_patches ORDER BY md5(patch_path||'|7'), patch_path LIMIT 500")
def _(t):
    return D.cap_samples(t["fx_patches"], "patch_path", 500, 7).select("patch_path")


@query("e8_resume_todo", "SELECT scene_key, quarter FROM fx_scenes WHERE scene_key NOT IN (SELECT scene_key FROM fx_patches WHERE row<500)")
def _(t):
    return D.resume_todo(t["fx_scenes"], t["fx_patches"].where("row < 500"), "scene_key").select("scene_key", "quarter")


@query("e9_missing_labels", f"WITH {_LABELS} SELECT patch_path, y AS year FROM fx_patches, (SELECT unnest([2022,2023]) AS y) WHERE (patch_path,y) NOT IN (SELECT (patch_path,year) FROM lab)")
def _(t):
    return D.missing_labels(t["fx_patches"], labels(t), [2022, 2023])


@query("e10_subset_by_quarter", f"WITH {_LABELS} SELECT patch_path, year FROM lab WHERE patch_path IN (SELECT patch_path FROM fx_patches WHERE quarter IN ('1997Q1','1998Q2'))")
def _(t):
    return D.subset_by_quarter(t["fx_patches"], labels(t), ["1997Q1", "1998Q2"])[1].select("patch_path", "year")


@query("e11_merge_indexes", "SELECT patch_path, CASE WHEN row%256=0 THEN 'first' ELSE 'second' END AS origin FROM fx_patches WHERE row%256=0 OR row>300")
def _(t):
    p = t["fx_patches"]
    first = p.where("row % 256 = 0").select(F.translate("patch_path", "/", "\\").alias("patch_path"), F.lit("first").alias("origin"))
    return D.merge_indexes([first, p.where("row > 300").select("patch_path", F.lit("second").alias("origin"))])


@query("e13_best_feature", "SELECT patch_id, patch_path, score FROM (SELECT regexp_extract(patch_path,'p_([0-9]+_[0-9]+)$',1) AS patch_id, patch_path, CAST((scene_key*37)%1000 AS DOUBLE)/1000 AS score FROM fx_patches) QUALIFY row_number() OVER (PARTITION BY patch_id ORDER BY score DESC, patch_path)=1")
def _(t):
    f = t["fx_patches"].select("patch_path", (((F.col("scene_key") * 37) % 1000).cast("double") / 1000).alias("score"))
    return D.best_feature_per_patch(f, r"p_(\d+_\d+)$", "patch_path", "score").select("patch_id", "patch_path", "score")


@query(
    "e14_experiment_matrix",
    "SELECT m AS method, o AS modality, s AS seed FROM (SELECT DISTINCT o_orderpriority AS m FROM orders), (SELECT DISTINCT o_orderstatus AS o FROM orders), (SELECT unnest([0,1,2,3]) AS s) WHERE (m,o,s) NOT IN (SELECT (method,modality,seed) FROM fx_runs)",
)
def _(t):
    runs = t["fx_runs"]
    return D.experiment_matrix(runs.select("method"), runs.select("modality"), [0, 1, 2, 3], runs).select("method", "modality", F.col("seed").cast("int").alias("seed"))
