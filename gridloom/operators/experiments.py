"""Analysis of experiment results: (method, modality, seed, metric, trainable_params) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import running_sums


def aggregate_runs(runs: DataFrame, metric: str) -> DataFrame:
    """Mean, sample deviation (0 of one run), number of runs and the first seed's parameters of each method and modality."""
    return runs.groupBy("method", "modality").agg(
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count(metric).alias("n"), F.min_by("trainable_params", "seed").alias("trainable_params")
    )


def pivot_runs(runs: DataFrame, metric: str, modalities: list[str]) -> DataFrame:
    return runs.groupBy("method").pivot("modality", modalities).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"))


def delta_vs_baseline(means: DataFrame, baseline: str) -> DataFrame:
    """Absolute and relative gain over a method in the same modality."""
    base = means.where(F.col("method") == baseline).select("modality", F.col("mean").alias("_b"))
    d = F.col("mean") - F.col("_b")
    return means.join(base, "modality").select("method", "modality", d.alias("delta"), (d / F.nullif(F.col("_b"), F.lit(0.0))).alias("relative"))


def pareto_front(points: DataFrame, cost: str, score: str, by: list[str]) -> DataFrame:
    """on_front: no other point costs no more and scores higher, or costs less and scores as high."""
    cheaper = W.partitionBy(*by).orderBy(F.asc(cost)).rangeBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(*by, cost)
    before = F.max(score).over(cheaper)
    return points.withColumn("on_front", (before.isNull() | (F.col(score) > before)) & (F.col(score) >= F.max(score).over(same)))


def rank_sensitivity(runs: DataFrame, ranks: dict[int, int] | DataFrame, metric: str, params: str = "trainable_params") -> DataFrame:
    """Mean and sample deviation of each rank, known by its number of parameters; ranks may be a table (params, rank)."""
    if isinstance(ranks, DataFrame):
        named = runs.join(ranks.select(params, "rank").distinct(), params)
    else:
        m = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))
        named = runs.withColumn("rank", F.try_element_at(m, F.col(params).cast("int"))).where("rank IS NOT NULL")
    return named.groupBy("rank").agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def ordered_methods(means: DataFrame, order: list[str]) -> DataFrame:
    """A row for each method in a fixed order, with nulls for those without results."""
    dim = means.sparkSession.createDataFrame(list(enumerate(order)), "place int, method string")
    return dim.join(means, "method", "left").orderBy("place")


def mean_time_by_method(runs: DataFrame, time: str = "train_time_sec") -> DataFrame:
    return runs.groupBy("method").agg(F.avg(time).alias("mean_time"))


def training_curves(lines: DataFrame) -> DataFrame:
    """(method, modality, seed) with arrays of epochs and losses in order of epoch; runs of any length are rather curve_points()."""
    s = F.array_sort(F.collect_list(F.struct("epoch", "loss")))
    return lines.groupBy("method", "modality", "seed").agg(s.alias("_s")).select("method", "modality", "seed", F.transform("_s", lambda x: x["epoch"]).alias("epochs"), F.transform("_s", lambda x: x["loss"]).alias("losses"))


def curve_points(lines: DataFrame) -> DataFrame:
    """(method, modality, seed, place, epoch, loss): each point of a run with its place, from 1, in order of epoch and loss. A long run is spread over tasks."""
    keys = ["method", "modality", "seed"]
    points = lines.select(*keys, "epoch", "loss", F.to_json(F.struct(*keys)).alias("_run"), F.struct("epoch", "loss").alias("_at"), F.lit(1).alias("_one"))
    return running_sums(points, "_run", F.col("_at"), ["_one"]).select(*keys, F.col("running__one").alias("place"), "epoch", "loss")
