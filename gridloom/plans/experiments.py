"""Queries: experiment results and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as X
from ..sources import catalogue as C
from ..sources.scratch import scratch
from .registry import query, r6

MODALITIES = ["F", "O", "P"]
_MEANS = "m AS (SELECT method, modality, avg(overall_accuracy) AS mean, coalesce(stddev_samp(overall_accuracy),0.0) AS std, count(*) AS n, arg_min(trainable_params,seed) AS trainable_params FROM fx_runs GROUP BY ALL)"


def means(t):
    return X.aggregate_runs(t["fx_runs"], "overall_accuracy")


@query(
    "a7_read_results",
    """SELECT method, modality, CAST(seed AS BIGINT) AS seed, CASE WHEN modality<>'P' THEN round(overall_accuracy,6)+0.0 END AS overall_accuracy, CASE WHEN modality='O' THEN round(overall_accuracy/2,6)+0.0 END AS mAP,
    CASE WHEN modality<>'P' THEN CAST(trainable_params AS BIGINT) END AS trainable_params FROM fx_runs""",
)
def _(t):
    """A file for each modality and seed: one kind has the accuracy as a number, one as text beside a field of its own, one has none, and an object for the parameters."""
    path, key = scratch(t.spark, "results"), ["method", "modality", "seed"]
    as_text = F.when(F.col("modality") == "F", F.to_json(F.struct(*key, "overall_accuracy", "trainable_params")))
    as_text = as_text.when(F.col("modality") == "O", F.to_json(F.struct(*key, F.col("overall_accuracy").cast("string").alias("overall_accuracy"), (F.col("overall_accuracy") / 2).alias("mAP"), "trainable_params")))
    as_text = as_text.otherwise(F.to_json(F.struct(*key, F.struct(F.col("trainable_params").alias("total")).alias("trainable_params"))))
    files = t["fx_runs"].groupBy("modality", "seed").agg(F.concat(F.lit("["), F.array_join(F.collect_list(as_text), ", "), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = C.read_results(t.spark, path, {"method": "string", "modality": "string", "seed": "bigint", "overall_accuracy": "double", "mAP": "double", "trainable_params": "bigint"})
    return back.select(*key, r6("overall_accuracy").alias("overall_accuracy"), r6("mAP").alias("mAP"), "trainable_params")


@query("i1_aggregate_runs", f"WITH {_MEANS} SELECT method, modality, round(mean,6)+0.0 AS mean, round(std,6)+0.0 AS std, n, trainable_params FROM m")
def _(t):
    return means(t).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("i2_pivot_runs", f"WITH {_MEANS} SELECT method, " + ", ".join(f"round(max(mean) FILTER (WHERE modality='{m}'),6)+0.0 AS {m}_mean, round(max(std) FILTER (WHERE modality='{m}'),6)+0.0 AS {m}_std" for m in MODALITIES) + " FROM m GROUP BY 1")
def _(t):
    out = X.pivot_runs(t["fx_runs"], "overall_accuracy", MODALITIES)
    return out.select("method", *(r6(f"{m}_{s}").alias(f"{m}_{s}") for m in MODALITIES for s in ("mean", "std")))


@query("i3_delta_vs_baseline", f"WITH {_MEANS} SELECT a.method, a.modality, round(a.mean-b.mean,6)+0.0 AS delta, round((a.mean-b.mean)/b.mean,6)+0.0 AS relative FROM m a JOIN m b ON a.modality=b.modality AND b.method='5-LOW'")
def _(t):
    return X.delta_vs_baseline(means(t), "5-LOW").withColumns({"delta": r6("delta"), "relative": r6("relative")})


@query(
    "i4_pareto_front",
    f"WITH {_MEANS} SELECT method, modality, NOT EXISTS (SELECT 1 FROM m b WHERE b.modality=a.modality AND ((b.trainable_params<=a.trainable_params AND b.mean>a.mean) OR (b.trainable_params<a.trainable_params AND b.mean>=a.mean))) AS on_front FROM m a",
)
def _(t):
    return X.pareto_front(means(t), "trainable_params", "mean", ["modality"]).select("method", "modality", "on_front")


@query("i5_rank_sensitivity", "SELECT CAST(4*((trainable_params-7690)%4+1) AS INTEGER) AS rank, round(avg(overall_accuracy),6)+0.0 AS mean, round(coalesce(stddev_samp(overall_accuracy),0.0),6)+0.0 AS std, count(*) AS n FROM fx_runs GROUP BY 1")
def _(t):
    # Every number of parameters in the table has a rank, so that every run counts.
    rank = (4 * ((F.col("trainable_params") - 7690) % 4 + 1)).cast("int").alias("rank")
    return X.rank_sensitivity(t["fx_runs"], t["fx_runs"].select("trainable_params", rank), "overall_accuracy").withColumns({"mean": r6("mean"), "std": r6("std")})


_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "pending", "2-HIGH", "1-URGENT"]


@query("i6_ordered_methods", f"WITH {_MEANS}, o AS (SELECT unnest(range({len(_ORDER)})) AS k, unnest({_ORDER}) AS method) SELECT CAST(k AS INTEGER) AS place, method, round(mean,6)+0.0 AS mean FROM o LEFT JOIN (SELECT * FROM m WHERE modality='O') USING(method)")
def _(t):
    return X.ordered_methods(means(t).where("modality = 'O'"), _ORDER).select("place", "method", r6("mean").alias("mean"))


@query("i7_mean_time", "SELECT method, round(avg(trainable_params/7.0),6)+0.0 AS mean_time FROM fx_runs GROUP BY 1")
def _(t):
    return X.mean_time_by_method(t["fx_runs"].withColumn("train_time_sec", F.col("trainable_params") / 7.0)).withColumn("mean_time", r6("mean_time"))


@query(
    "i8_training_curves",
    r"""WITH l AS (SELECT regexp_extract(line,'\[([^|]+)\|',1) AS method, regexp_extract(line,'\|(m[0-9])\|',1) AS modality, CAST(regexp_extract(line,'seed=(\d+)',1) AS INTEGER) AS seed, CAST(regexp_extract(line,'Epoch (\d+)/',1) AS INTEGER) AS epoch, CAST(regexp_extract(line,'loss=([\d.]+)',1) AS DOUBLE) AS loss FROM fx_logs WHERE regexp_matches(line,'loss=[\d.]+'))
    SELECT method, modality, seed, string_agg(CAST(epoch AS VARCHAR), ',' ORDER BY epoch, loss) AS epochs, round(sum(loss),6)+0.0 AS total, count(*) AS n FROM l GROUP BY ALL""",
)
def _(t):
    c = X.training_curves(C.parse_training_logs(t["fx_logs"]))
    return c.select("method", "modality", "seed", F.array_join("epochs", ",").alias("epochs"), r6(F.aggregate("losses", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("losses").cast("long").alias("n"))


@query(
    "i8_curve_points",
    r"""WITH l AS (SELECT regexp_extract(line,'\[([^|]+)\|',1) AS method, regexp_extract(line,'\|(m[0-9])\|',1) AS modality, CAST(regexp_extract(line,'seed=(\d+)',1) AS INTEGER) AS seed, CAST(regexp_extract(line,'Epoch (\d+)/',1) AS INTEGER) AS epoch, CAST(regexp_extract(line,'loss=([\d.]+)',1) AS DOUBLE) AS loss FROM fx_logs WHERE regexp_matches(line,'loss=[\d.]+'))
    SELECT method, modality, seed, row_number() OVER (PARTITION BY method, modality, seed ORDER BY epoch, loss) AS place, epoch, loss FROM l""",
)
def _(t):
    return X.curve_points(C.parse_training_logs(t["fx_logs"]))
