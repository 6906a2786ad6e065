"""Queries: registry tables (K1-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registries as K
from .registry import query


def models(t):
    m = t["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("score"), F.min("l_shipdate").cast("date").alias("created_at"))
    return m.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("model_id"), F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linenumber") > 1, F.col("score") / 8).alias("score"), "created_at")


_MODELS = "m AS (SELECT l_orderkey*10+l_linenumber AS model_id, l_orderkey AS job_id, CASE WHEN l_linenumber>1 THEN min(l_quantity)/8 END AS score, CAST(min(l_shipdate) AS DATE) AS created_at FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("k1_list_models", f"WITH {_MODELS} SELECT model_id, job_id, created_at, coalesce(c_name, 'Dataset-'||CAST(o_custkey AS VARCHAR)[1:6]) AS dataset_name, coalesce(round_even(score,2),0.0)::DOUBLE AS score FROM m LEFT JOIN orders ON o_orderkey=job_id LEFT JOIN (SELECT * FROM customer WHERE c_custkey%4<>0) ON c_custkey=o_custkey")
def _(t):
    jobs = t["orders"].select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("dataset_id"))
    sets = t["customer"].where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("dataset_name"))
    return K.list_models(models(t), jobs, sets).select("model_id", "job_id", "created_at", "dataset_name", "score")


@query("k2_activate_model", "SELECT o_orderkey AS model_id, o_orderkey=7 AS is_active FROM orders")
def _(t):
    return K.activate_model(t["orders"].select(F.col("o_orderkey").alias("model_id"), (F.col("o_orderkey") == 3).alias("is_active")), 7)


@query(
    "k3_job_progress",
    """WITH e AS (SELECT user_id, event_id, CAST(json_extract(props,'$.k') AS INTEGER) AS k FROM events) SELECT user_id, CAST(arg_max(k,event_id) AS INTEGER) AS current_epoch, arg_max(k,event_id)+0.5::DOUBLE AS last_loss, CAST(count(*) AS INTEGER) AS n_entries FROM e GROUP BY 1""",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return K.entry_progress(t["events"].select("user_id", "event_id", k.alias("k"), (k + 0.5).cast("double").alias("loss")), "user_id", "event_id", "k", "loss")


# Jobs of drifting shape: arrays, a list of entries, single values, a field of another type, no JSON.
_SHAPES = ["'{\"epoch\": [1, ' || {k} || '], \"loss\": [0.5, ' || {k} || '.25]}'", "'[{\"epoch\": 1, \"loss\": 2.5}, {\"epoch\": ' || {k} || ', \"loss\": 0.125, \"lr\": 1}]'", "'{\"epoch\": ' || {k} || ', \"loss\": \"none\", \"note\": {\"a\": 1}}'", "'Epoch ' || {k}"]


@query(
    "k3_job_progress_json",
    """SELECT event_id, CAST(CASE event_id%4 WHEN 3 THEN 0 ELSE event_id%50 END AS INTEGER) AS current_epoch, CASE event_id%4 WHEN 0 THEN event_id%50+0.25::DOUBLE WHEN 1 THEN 0.125::DOUBLE END AS last_loss, CAST(CASE WHEN event_id%4<2 THEN 2 ELSE 0 END AS INTEGER) AS n_entries FROM events""",
)
def _(t):
    k = "CAST(event_id % 50 AS STRING)"
    shapes = " ".join(f"WHEN {i} THEN {s.replace('{k}', k)}" for i, s in enumerate(_SHAPES))
    jobs = t["events"].select("event_id", F.expr(f"CASE event_id % 4 {shapes} END").alias("metrics"))
    return K.job_progress(jobs).select("event_id", "current_epoch", "last_loss", "n_entries")


@query("k4_register_result", "SELECT o_orderkey AS model_id, CASE WHEN o_orderkey%3=0 THEN o_totalprice*2 ELSE o_totalprice END AS score FROM orders")
def _(t):
    o = t["orders"].select(F.col("o_orderkey").alias("model_id"), F.col("o_orderdate").alias("written"), F.col("o_totalprice").alias("score"))
    return K.register_result(o, o.where("model_id % 3 = 0").withColumn("score", F.col("score") * 2), "model_id", "written").select("model_id", "score")
