"""Queries: incremental work (L1-L3); their sources are tables written as several files to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators import spatial as G
from ..sources.scratch import scratch
from ..streaming import incremental as I
from .registry import query, r6

_WINDOWS = "SELECT scene_key, CAST(row AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM (SELECT scene_key, c, unnest(range(0, CAST((maxy-miny)/10 AS INTEGER)-127, 128)) AS row FROM (SELECT *, unnest(range(0, CAST((maxx-minx)/10 AS INTEGER)-127, 128)) AS c FROM fx_scenes))"


@query("l1_incremental_index", _WINDOWS)
def _(t):
    s = t["fx_scenes"].select("scene_key", ((F.col("maxx") - F.col("minx")) / 10).cast("int").alias("width"), ((F.col("maxy") - F.col("miny")) / 10).cast("int").alias("height"))
    source, out, state = (scratch(t.spark, n) for n in ("scenes", "index", "state"))
    rows = lambda df: G.tile_windows(df, 128).select("scene_key", "row", "col")
    # Two arrivals, the second with some scenes of the first again.
    s.where("scene_key % 3 <> 0").repartition(4).write.mode("append").parquet(source)
    I.incremental_index(t.spark, source, s.schema, rows, ["scene_key", "row", "col"], out, state, 2)
    s.where("scene_key % 3 = 0 OR scene_key % 5 = 0").repartition(2).write.mode("append").parquet(source)
    return I.incremental_index(t.spark, source, s.schema, rows, ["scene_key", "row", "col"], out, state, 2)


def _metrics(t):
    """The metric stream of all events, which arrive in four lots in the order of their time."""
    ts = F.col("ts").cast("timestamp")
    e = t["events"].select(F.col("user_id").alias("job"), (F.col("event_id") % 10).cast("int").alias("epoch"), F.sqrt(F.abs("value")).alias("rec"), F.sqrt(F.abs("value") / 3).alias("uni"), ts.alias("ts"))
    source, out, state = (scratch(t.spark, n) for n in ("metrics", "means", "state"))
    first, last = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    lot = F.least(F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1)), F.lit(3))
    made = None
    for k in range(4):
        e.where(lot == k).write.mode("append").parquet(source)
        made = I.metrics_stream(t.spark, source, e.schema, out, state)
    return made


@query(
    "l2_metrics_stream",
    "SELECT user_id AS job, CAST(event_id%10 AS INTEGER) AS epoch, round(avg(sqrt(abs(value))),6)+0.0 AS rec, round(avg(sqrt(abs(value)))+0.1*avg(sqrt(abs(value)/3)),6)+0.0 AS total, count(*) AS steps FROM events GROUP BY ALL",
)
def _(t):
    return _metrics(t).select("job", "epoch", r6("rec").alias("rec"), r6("total").alias("total"), "steps")


@query(
    "l2_remaining_time",
    "SELECT job, epoch, round((12-epoch)*n*0.25,6)+0.0 AS seconds_left FROM (SELECT job, max(epoch) AS epoch, avg(steps) AS n FROM (SELECT user_id AS job, CAST(event_id%10 AS INTEGER) AS epoch, count(*) AS steps FROM events GROUP BY ALL) GROUP BY 1)",
)
def _(t):
    return I.remaining_time(_metrics(t), 12, 0.25).withColumn("seconds_left", r6("seconds_left"))


@query(
    "l3_resume_matrix",
    "SELECT m AS method, o AS modality, s AS seed FROM (SELECT DISTINCT o_orderpriority AS m FROM orders), (SELECT DISTINCT o_orderstatus AS o FROM orders), (SELECT unnest([0,1,2]) AS s) WHERE (m,o,s) NOT IN (SELECT (method,modality,seed) FROM fx_runs WHERE seed<2)",
)
def _(t):
    runs = t["fx_runs"].select("method", "modality", F.col("seed").cast("long").alias("seed"), "overall_accuracy")
    source, out, state = (scratch(t.spark, n) for n in ("runs", "done", "state"))
    for k in (0, 1):
        runs.where(F.col("seed") == k).write.mode("append").parquet(source)
        done = I.incremental_index(t.spark, source, runs.schema, lambda df: df, ["method", "modality", "seed"], out, state)
    names = t["fx_runs"]
    return D.experiment_matrix(names.select("method"), names.select("modality"), [0, 1, 2], done).select("method", "modality", F.col("seed").cast("int").alias("seed"))
