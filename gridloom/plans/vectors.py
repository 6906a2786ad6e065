"""Queries: embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as E
from ..operators import metrics as M
from .registry import query, r6

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def vectors(t):
    return t["embeddings"].select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("j1_pca_project")
def _(t):
    return E.pca_project(vectors(t), "vec_id", "e").select("vec_id", r6(F.abs(F.col("projected")[0])).alias("c0"), r6(F.abs(F.col("projected")[1])).alias("c1"))


@query("j1_pca_norms", f"WITH {_V}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e,1) AS i FROM v), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1) SELECT vec_id, round(sum((x-m)*(x-m)),5)+0.0 AS squared_norm FROM x JOIN m USING(i) GROUP BY 1")
def _(t):
    """All components together only turn the centred vectors, so their lengths stay."""
    return E.pca_project(vectors(t), "vec_id", "e", 64).select("vec_id", (F.round(E.dot("projected", "projected"), 5) + 0.0).alias("squared_norm"))


@query("j2_kmeans")
def _(t):
    return E.kmeans_labels(vectors(t), "vec_id", "e")


@query(
    "j2_kmeans_inertia",
    f"WITH {_V}, x AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e,1) AS i FROM v), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1) SELECT (SELECT count(*) FROM v) AS n, CAST(least(5,(SELECT count(*) FROM v)-1) AS BIGINT) AS n_clusters, round(sum((x-m)*(x-m)),3)+0.0 AS total, true AS less FROM x JOIN m USING(i)",
)
def _(t):
    """Of the labels: rows, clusters, the sum of squares around the common mean, and whether that around the clusters' own means is less."""
    v = vectors(t)
    named = v.join(E.kmeans_labels(v, "vec_id", "e"), "vec_id").select("cluster", F.posexplode("e").alias("i", "x"))
    part = named.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.var_pop("x").alias("v"))
    one = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("v")).alias("inner"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.countDistinct("cluster").alias("k"))
    total = F.sum(F.col("inner") + F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return one.agg(F.max("n").alias("n"), F.max("k").alias("n_clusters"), (F.round(total, 3) + 0.0).alias("total"), (F.sum("inner") < total).alias("less"))


_SIL = f"""{_V}, n AS (SELECT label, count(*) AS n FROM v GROUP BY 1), d AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.e,b.e)) AS s FROM v a, v b GROUP BY ALL),
m AS (SELECT vec_id, d.label, o, CASE WHEN o=d.label THEN s/nullif(n-1,0) ELSE s/n END AS m FROM d JOIN n ON n.label=d.o), ab AS (SELECT vec_id, label, max(m) FILTER (WHERE o=label) AS a, min(m) FILTER (WHERE o<>label) AS b FROM m GROUP BY ALL),
sil AS (SELECT vec_id, label, coalesce((b-a)/greatest(a,b),0.0) AS s FROM ab)"""


@query("j3_silhouette", f"WITH {_SIL} SELECT vec_id, round(s,5)+0.0 AS silhouette FROM sil")
def _(t):
    return E.silhouette(vectors(t), "vec_id", "e", "label").select("vec_id", (F.round("silhouette", 5) + 0.0).alias("silhouette"))


@query("j3_separability", f"WITH {_SIL} SELECT round(avg(s),5)+0.0 AS silhouette, round(least(greatest(50+90*avg(s),0),99.9),4)+0.0 AS estimate FROM sil")
def _(t):
    s = E.separability(E.silhouette(vectors(t), "vec_id", "e", "label"))
    return s.select((F.round("silhouette", 5) + 0.0).alias("silhouette"), (F.round("estimate", 4) + 0.0).alias("estimate"))


_SIL2 = _SIL.replace("sum(list_distance(a.e,b.e))", "sum(list_distance(a.e,b.e)*list_distance(a.e,b.e))")


@query("j3_silhouette_squared", f"WITH {_SIL2} SELECT vec_id, round(s,5)+0.0 AS silhouette FROM sil")
def _(t):
    return E.silhouette_squared(vectors(t), "vec_id", "e", "label").select("vec_id", (F.round("silhouette", 5) + 0.0).alias("silhouette"))


@query(
    "j4_uniformity",
    f"WITH {_V}, u AS (SELECT vec_id, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) AS e FROM v) SELECT round(ln(sum(exp(-2*list_distance(a.e,b.e))))/count(*)*1000,6)+0.0 AS uniformity_k, round(2*sum(abs(list_dot_product(a.e,b.e)))/pow((SELECT count(*) FROM u),2),6)+0.0 AS mean_abs_cosine FROM u a JOIN u b ON a.vec_id<b.vec_id",
)
def _(t):
    u = E.uniformity(vectors(t), "vec_id", "e")
    return u.select(r6(F.col("uniformity") * 1000).alias("uniformity_k"), r6("mean_abs_cosine").alias("mean_abs_cosine"))


@query("j4_uniformity_features")
def _(t):
    u = E.uniformity_features(vectors(t), "vec_id", "e")
    return u.select(r6(F.col("uniformity") * 1000).alias("uniformity_k"), r6("mean_kernel").alias("mean_kernel"), "error", "n")


@query("j5_distances", f"WITH {_V} SELECT a.vec_id, round(list_cosine_similarity(a.e,b.e),6)+0.0 AS cosine, round(list_distance(a.e,b.e),6)+0.0 AS euclidean FROM v a JOIN v b ON b.vec_id=a.vec_id+1")
def _(t):
    v = vectors(t)
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(n, "vec_id").select("vec_id", r6(E.cosine("e", "f")).alias("cosine"), r6(E.euclidean("e", "f")).alias("euclidean"))


@query("j6_linear_probe")
def _(t):
    v = vectors(t)
    out = E.linear_probe(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "e", "label")
    return M.overall_accuracy(out.withColumnRenamed("label", "y_true"))


@query("j6_probe_against_majority", f"WITH {_V} SELECT (SELECT count(*) FROM v) AS n, round(max(n)/sum(n),6)+0.0 AS majority, true AS as_good FROM (SELECT count(*) AS n FROM v GROUP BY label)")
def _(t):
    """Rows, the accuracy of always saying their most frequent class, and whether the probe is as good or better on what it learnt from."""
    v = vectors(t)
    out = E.linear_probe(v, v, "e", "label").withColumnRenamed("label", "y_true")
    return M.overall_accuracy(out).crossJoin(M.constant_baseline(out)).crossJoin(out.agg(F.count("*").alias("n"))).select("n", r6("accuracy").alias("majority"), (F.col("overall_accuracy") >= F.col("accuracy")).alias("as_good"))


_WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 10 for i in range(64)] for j in range(4)]
_BIAS = [0.0, 0.1, -0.1, 0.05]


@query("j7_linear_head", f"WITH {_V}, s AS (SELECT vec_id, " + ", ".join(f"list_dot_product(e,{w}::DOUBLE[])+({b}) AS s{k}" for k, (w, b) in enumerate(zip(_WEIGHTS, _BIAS, strict=True))) + ") SELECT vec_id, round(greatest(s0,s1,s2,s3),6)+0.0 AS top, CAST(list_position([s0,s1,s2,s3],greatest(s0,s1,s2,s3))-1 AS INTEGER) AS y_pred FROM s".replace(") SELECT", " FROM v) SELECT", 1))
def _(t):
    from ..functions.scalars import argmax

    return vectors(t).select("vec_id", E.apply_linear_head("e", _WEIGHTS, _BIAS).alias("s")).select("vec_id", r6(F.array_max("s")).alias("top"), argmax("s").alias("y_pred"))
