"""Queries: evaluation metrics (H1-H9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query, r6

_PC = """k AS (SELECT y_true, y_pred, count(*) AS n FROM fx_preds {w} GROUP BY ALL),
c AS (SELECT c, coalesce(sum(n) FILTER (WHERE y_true=c AND y_pred=c),0) AS tp, coalesce(sum(n) FILTER (WHERE y_true<>c AND y_pred=c),0) AS fp, coalesce(sum(n) FILTER (WHERE y_true=c AND y_pred<>c),0) AS fn
 FROM k, (SELECT y_true AS c FROM k UNION SELECT y_pred FROM k) GROUP BY c)"""


@query("h1_confusion", "SELECT y_true, y_pred, count(*) AS n FROM fx_preds GROUP BY ALL")
def _(t):
    return M.confusion(t["fx_preds"])


@query("h2_overall_accuracy", "SELECT round(avg((y_true=y_pred)::INT),6)+0.0 AS overall_accuracy FROM fx_preds")
def _(t):
    return M.overall_accuracy(t["fx_preds"]).select(r6("overall_accuracy").alias("overall_accuracy"))


@query("h3_macro_f1", f"WITH {_PC.format(w='')} SELECT round(avg(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END),6)+0.0 AS macro_f1 FROM c")
def _(t):
    return M.macro_f1(t["fx_preds"]).select(r6("macro_f1").alias("macro_f1"))


_AP = """s AS (SELECT y_true AS class, score, sum(y_bin) AS p, count(*) AS n FROM fx_preds GROUP BY ALL), r AS (SELECT class, p, sum(p) OVER w / sum(n) OVER w AS prec FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT class, CASE WHEN sum(p)=0 THEN 0.0 ELSE sum(p*prec)/sum(p) END AS ap FROM r GROUP BY 1)"""


@query("h4_average_precision", f"WITH {_AP} SELECT class, round(ap,6)+0.0 AS ap FROM ap")
def _(t):
    return M.average_precision(t["fx_preds"].withColumnRenamed("y_true", "class")).withColumn("ap", r6("ap"))


@query("h4_map", f"WITH {_AP} SELECT round(avg(ap),6)+0.0 AS map FROM ap")
def _(t):
    return M.mean_average_precision(t["fx_preds"].withColumnRenamed("y_true", "class")).withColumn("map", r6("map"))


@query("h5_iou_per_class", f"WITH {_PC.format(w='')} SELECT c AS class, round(tp/(tp+fp+fn),6)+0.0 AS iou FROM c")
def _(t):
    return M.iou_per_class(t["fx_preds"]).withColumn("iou", r6("iou"))


@query("h5_miou_ignore", f"WITH {_PC.format(w='WHERE y_true<>3')} SELECT round(avg(tp/(tp+fp+fn)),6)+0.0 AS miou FROM c")
def _(t):
    return M.mean_iou(t["fx_preds"], 3).withColumn("miou", r6("miou"))


def logits(t):
    """Four mean bands as logits of a patch, its class as target, every eleventh to be ignored."""
    e = t["fx_pixels"].groupBy("patch_id", "class_id", "band").agg((F.avg("v") / 25.0).alias("x"))
    a = e.groupBy("patch_id", "class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "x"))), lambda s: s["x"]).alias("logits"))
    return a.select("patch_id", "logits", F.when(F.col("patch_id") % 11 == 0, 255).otherwise(F.col("class_id") % 4).cast("int").alias("target"))


_W = [1.0, 2.0, 0.5, 1.5]
_CE = """e AS (SELECT patch_id, class_id, band, avg(v)/25.0 AS x FROM fx_pixels GROUP BY ALL), l AS (SELECT patch_id, CASE WHEN patch_id%11=0 THEN 255 ELSE class_id%4 END AS target, ln(sum(exp(x)))-max(x) FILTER (WHERE band=class_id%4) AS ce FROM e GROUP BY patch_id, class_id),
m AS (SELECT CASE WHEN target=255 THEN 0 ELSE ce END AS ce, CASE target WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.5 ELSE 0 END::DOUBLE AS w FROM l)"""


@query("h6_cross_entropy", f"WITH {_CE} SELECT round(sum(ce*w)/sum(w),6)+0.0 AS cross_entropy FROM m")
def _(t):
    return M.cross_entropy(logits(t), weights=_W).select(r6("cross_entropy").alias("cross_entropy"))


@query("h6_focal_loss", f"WITH {_CE} SELECT round(avg(pow(1-exp(-ce*w),2)*ce*w),6)+0.0 AS focal_loss FROM m")
def _(t):
    return M.focal_loss(logits(t), alpha=_W).select(r6("focal_loss").alias("focal_loss"))


@query("h7_bce_with_logits", "SELECT round(avg(greatest(x,0)-x*y_bin+ln(1+exp(-abs(x)))),6)+0.0 AS bce FROM (SELECT score*4-2 AS x, y_bin FROM fx_preds)")
def _(t):
    return M.bce_with_logits(t["fx_preds"].select((F.col("score") * 4 - 2).alias("x"), F.col("y_bin").alias("y"))).select(r6("bce").alias("bce"))


@query("h8_reconstruction_mse", "SELECT round(avg(m),6)+0.0 AS mse FROM (SELECT patch_id%20 AS b, avg((v/255.0-0.5)*(v/255.0-0.5)) AS m FROM fx_pixels GROUP BY 1)")
def _(t):
    p = t["fx_pixels"].select((F.col("patch_id") % 20).alias("b"), (F.col("v") / 255.0).alias("x"), F.lit(0.5).alias("rec"))
    return M.reconstruction_mse(p, "b", "x", "rec").select(r6("mse").alias("mse"))


@query("h9_constant_baseline", "SELECT round(max(n)/sum(n),6)+0.0 AS accuracy, round(max(n)/sum(n)/count(*),6)+0.0 AS miou FROM (SELECT count(*) AS n FROM fx_preds GROUP BY y_true)")
def _(t):
    return M.constant_baseline(t["fx_preds"]).select(r6("accuracy").alias("accuracy"), r6("miou").alias("miou"))
