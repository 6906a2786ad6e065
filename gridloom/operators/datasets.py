"""Datasets from indexes: labelled pairs, splits, caps, resumption, merges, top lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranges import placed


def hash_order(key: str, seed: int) -> Column:
    """An order by seed that any engine can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def paired_dataset(patches: DataFrame, labels: DataFrame, year: int | None = None, min_share: float | None = None) -> DataFrame:
    """Patches with their label, by path; of one year, and with a share of positives from min_share on."""
    if year is not None:
        labels = labels.where(F.col("year") == year)
    if min_share is not None:
        labels = labels.where(F.col("building_share") >= min_share)
    return patches.join(labels, "patch_path", "inner")


def scene_split(df: DataFrame, val_frac: float = 0.2, scene: str = "scene_id") -> DataFrame:
    """split: `val` in the last max(1, n * val_frac) scenes in order, so that no scene is on both sides.

    Scenes are ranked among themselves, far fewer rows than patches; each gets its place by range partitions' counts. The ranges
    are stored, so that their counts and their rows are of one partitioning.
    """
    scenes = placed(df.select(scene).distinct(), F.desc(scene))
    cut = max(1, int(scenes.count() * val_frac))
    last = scenes.where(F.col("_place") <= cut).select(scene, F.lit("val").alias("split"))
    return df.join(last, scene, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def patch_split(df: DataFrame, key: str, val_frac: float, seed: int) -> DataFrame:
    """split: `val` for the share of rows that come first by hash; a threshold on the hash, so nothing is sorted."""
    limit = F.lit(f"{min(math.floor(val_frac * 16**8), 16**8 - 1):08x}")
    return df.withColumn("split", F.when(F.substring(hash_order(key, seed), 1, 8) < limit, "val").otherwise("train"))


def cap_samples(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key).limit(n)


def resume_todo(catalog: DataFrame, done: DataFrame, key: str = "scene_id") -> DataFrame:
    return catalog.join(done.select(key).distinct(), key, "left_anti")


def missing_labels(patches: DataFrame, labels: DataFrame, years: list[int]) -> DataFrame:
    """patch_path, year of every patch without a label of that year."""
    want = patches.select("patch_path", F.explode(F.array(*map(F.lit, years))).alias("year"))
    return want.join(labels.select("patch_path", "year"), ["patch_path", "year"], "left_anti")


def subset_by_quarter(patches: DataFrame, labels: DataFrame, quarters: list[str]) -> tuple[DataFrame, DataFrame]:
    """The patches of some quarters, and the labels of those patches."""
    own = patches.where(F.col("quarter").isin(quarters))
    return own, labels.join(own.select("patch_path"), "patch_path", "left_semi")


def merge_indexes(parts: list[DataFrame]) -> DataFrame:
    """Indexes together, paths normalised; of equal paths the one from the first index counts."""
    out = None
    for k, df in enumerate(parts):
        df = df.withColumns({"patch_path": S.normalize_path("patch_path"), "_source": F.lit(k)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("patch_path", "_source")]
    first = out.groupBy("patch_path").agg(F.min(F.struct("_source", *rest)).alias("_r"))
    return first.select("patch_path", *(F.col(f"_r.{c}").alias(c) for c in rest))


def top_k(df: DataFrame, score: str, k: int, *tie: str) -> DataFrame:
    """The k largest scores, missing ones as 0; ties by the given columns."""
    if not 1 <= k <= 10_000:
        raise ValueError("k is 1 to 10000")
    return df.withColumn(score, F.coalesce(score, F.lit(0.0))).orderBy(F.desc(score), *tie).limit(k)


def best_feature_per_patch(features: DataFrame, pattern: str, path: str, score: str) -> DataFrame:
    """Of the features whose path has the same grid id, the one with the largest score, and the id."""
    named = features.withColumn("patch_id", S.first_group(path, pattern)).where("patch_id IS NOT NULL").withColumn("_s", F.coalesce(score, F.lit(0.0)))
    best = named.groupBy("patch_id").agg(F.max("_s").alias("_s"))
    rest = [c for c in features.columns if c != path]
    return named.join(best, ["patch_id", "_s"]).groupBy("patch_id").agg(F.min(F.struct(path, *rest)).alias("r")).select("patch_id", "r.*")


def experiment_matrix(methods: DataFrame, modalities: DataFrame, seeds: list[int], done: DataFrame | None = None) -> DataFrame:
    """Every combination of the distinct names in methods and modalities (one column each) with the seeds that isn't done."""
    keys = ["method", "modality", "seed"]
    # All combinations are the result itself.
    every = methods.toDF("method").distinct().crossJoin(modalities.toDF("modality").distinct()).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return every if done is None else every.join(done.select(*keys), keys, "left_anti")
