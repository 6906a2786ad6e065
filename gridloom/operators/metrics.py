"""Evaluation metrics as aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranges import running_sums


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def overall_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("overall_accuracy"))


def per_class(c: DataFrame, ignore: int | None = None) -> DataFrame:
    """class, tp, fp, fn from a confusion table, over the labels of either side."""
    if ignore is not None:
        c = c.where(F.col("y_true") != ignore)
    side = F.explode(F.array_distinct(F.array(F.col("y_true"), F.col("y_pred")))).alias("class")
    parts = c.select("y_true", "y_pred", "n", side)
    hit = F.col("y_true") == F.col("y_pred")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return parts.groupBy("class").agg(total(hit).alias("tp"), total(~hit & (F.col("y_pred") == F.col("class"))).alias("fp"), total(~hit & (F.col("y_true") == F.col("class"))).alias("fn"))


def macro_f1(df: DataFrame) -> DataFrame:
    """Mean F1, an undefined one as 0."""
    k = per_class(confusion(df))
    return k.agg(F.avg(F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))).alias("macro_f1"))


def iou_per_class(df: DataFrame, ignore_index: int | None = None) -> DataFrame:
    k = per_class(confusion(df), ignore_index)
    return k.select("class", (F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).alias("iou"))


def mean_iou(df: DataFrame, ignore_index: int | None = None) -> DataFrame:
    return iou_per_class(df, ignore_index).agg(F.avg("iou").alias("miou"))


def average_precision(df: DataFrame, label: str = "class", truth: str = "y_bin", score: str = "score") -> DataFrame:
    """AP of each class; equal scores count together, a class without positives has 0.

    Rows are summed by (class, score) first; the running sums over distinct scores go by ranges of (class, score), so that a class with
    very many scores is spread over tasks.
    """
    s = df.groupBy(label, score).agg(F.sum(truth).alias("_p"), F.count("*").alias("_n"))
    s = running_sums(s, label, F.desc(score), ["_p", "_n"]).withColumn("_precision", F.col("running__p") / F.col("running__n"))
    return s.groupBy(label).agg(F.coalesce(F.sum(F.col("_p") * F.col("_precision")) / F.nullif(F.sum("_p"), F.lit(0)), F.lit(0.0)).alias("ap"))


def mean_average_precision(df: DataFrame, label: str = "class") -> DataFrame:
    return average_precision(df, label).agg(F.avg("ap").alias("map"))


def _log_p(logits: str, target: str) -> Column:
    return F.element_at(S.log_softmax(logits), F.least(F.col(target), F.size(logits) - 1).cast("int") + 1)


def cross_entropy(df: DataFrame, logits: str = "logits", target: str = "target", weights: list[float] | None = None, ignore: int = 255) -> DataFrame:
    """Weighted sum of -log p over the sum of weights; ignored rows have no weight."""
    w = F.lit(1.0) if weights is None else F.coalesce(F.get(F.array(*map(F.lit, weights)), F.col(target).cast("int")), F.lit(0.0))
    w = F.when(F.col(target) == ignore, 0.0).otherwise(w)
    return df.select((-_log_p(logits, target) * w).alias("l"), w.alias("w")).agg((F.sum("l") / F.sum("w")).alias("cross_entropy"))


def focal_loss(df: DataFrame, logits: str = "logits", target: str = "target", gamma: float = 2.0, alpha: list[float] | None = None, ignore: int = 255) -> DataFrame:
    """The plain mean over all rows, ignored ones as 0."""
    a = F.lit(1.0) if alpha is None else F.coalesce(F.get(F.array(*map(F.lit, alpha)), F.col(target).cast("int")), F.lit(0.0))
    ce = F.when(F.col(target) == ignore, 0.0).otherwise(-_log_p(logits, target) * a)
    return df.select(ce.alias("ce")).agg(F.avg(F.pow(1 - F.exp(-F.col("ce")), gamma) * F.col("ce")).alias("focal_loss"))


def bce_with_logits(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    v, t = F.col(x), F.col(y)
    return df.agg(F.avg(F.greatest(v, F.lit(0.0)) - v * t + F.log1p(F.exp(-F.abs(v)))).alias("bce"))


def reconstruction_mse(df: DataFrame, batch: str, x: str, rec: str) -> DataFrame:
    """The mean of batches' means."""
    return df.groupBy(batch).agg(F.avg(F.pow(F.col(x) - F.col(rec), 2)).alias("_m")).agg(F.avg("_m").alias("mse"))


def constant_baseline(df: DataFrame) -> DataFrame:
    """Accuracy and mean IoU of always predicting the most frequent class."""
    n = df.groupBy("y_true").agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n") / F.count("*")).alias("miou"))
