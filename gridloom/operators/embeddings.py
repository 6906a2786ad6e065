"""Analysis of embeddings: array<double> columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Points of a block; two blocks meet in one task. More points make larger blocks once there are BLOCKS of them, so that a point is moved BLOCKS times at most, up to LARGEST points.
BLOCK, BLOCKS, LARGEST = 1000, 32, 32_768
#: Distances that are held at once.
STRIP = 2_000_000
#: Pairs of near points that are looked at together.
NEAR = 16_384


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(S.col(a), S.col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column | str) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(S.col(a), lambda x: x / F.greatest(norm, F.lit(1e-12)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(S.col(a), S.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pca_project(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """The first k principal components' coordinates, centred."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).select(key, vector_to_array("_p").alias("projected"))


def kmeans_labels(df: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster; without k, min(5, n - 1) clusters, and one where that is under 2."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = k or min(5, v.count() - 1)
    if k < 2:
        return v.select(key, F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))


def _met_blocks(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """Every point in each of the pairs of blocks (p <= q) that its block is in: p, q, b."""
    blocks = max(1, min(-(-n // BLOCK), BLOCKS), -(-n // LARGEST))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    return df.select(key, *columns, own.alias("b"), other.alias("o")).withColumns({"p": F.least("b", "o"), "q": F.greatest("b", "o")})


def _distances(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of u to all of w by one matrix product; those of near rows, which that leaves few digits, are taken from the differences."""
    middle = u.mean(axis=0)
    u, w = u - middle, w - middle
    norms = (u * u).sum(1)[:, None] + (w * w).sum(1)[None]
    out = norms - 2 * (u @ w.T)
    near_u, near_w = np.nonzero(out < 1e-4 * norms)
    for k in range(0, len(near_u), NEAR):
        a, b = near_u[k : k + NEAR], near_w[k : k + NEAR]
        d = u[a] - w[b]
        out[a, b] = (d * d).sum(1)
    return np.sqrt(np.maximum(out, 0))


def silhouette_squared(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """Each point's silhouette by squared Euclidean distances; a cluster of one has 0. For any number of points.

    The mean squared distance to a cluster follows from its mean vector and its mean squared norm, so only clusters are moved
    (a row each), never pairs of points. It is another number than silhouette().
    """
    v = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(cluster).cast("long").alias("c"))
    at = v.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    clusters = at.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"), F.sum("q").alias("q"), F.max("n").alias("n"))
    other = clusters.select(F.col("c").alias("o"), "m", "q", "n")
    # Points beside clusters: the result of the definition has as many terms.
    met = v.join(other, F.lit(True))
    d = F.greatest(dot("v", "v") - 2 * dot("v", "m") + F.col("q"), F.lit(0.0))
    own = F.col("c") == F.col("o")
    mean = met.select("k", "c", "o", "n", own.alias("own"), d.alias("d")).withColumn("d", F.when(F.col("own"), F.col("d") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("d")))
    ab = mean.groupBy("k", "c").agg(F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    return ab.select(F.col("k").alias(key), F.col("c").alias(cluster), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """Each point's exact Euclidean silhouette, by distances between blocks of points; a cluster of one has 0.

    Quadratic by definition, in time: what is moved follows the points (see BLOCKS). For many points see silhouette_squared().
    """
    df = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(cluster).cast("long").alias("c"))

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        p, q = g["p"].iloc[0], g["q"].iloc[0]
        a, b = g[g["b"] == p], g[g["b"] == q]
        out = []
        for x, y in ((a, b),) if p == q else ((a, b), (b, a)):
            if len(x) and len(y):
                y = y.sort_values("c", kind="stable")
                u, w = np.stack(x["v"]), np.stack(y["v"])
                kinds, first = np.unique(y["c"], return_index=True)
                strip = max(1, STRIP // len(w))
                d = np.concatenate([np.add.reduceat(_distances(u[k : k + strip], w), first, axis=1) for k in range(0, len(u), strip)])
                out.append(pd.DataFrame({"k": np.repeat(x["k"].to_numpy(), len(kinds)), "c": np.repeat(x["c"].to_numpy(), len(kinds)), "other": np.tile(kinds, len(x)), "d": d.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"k": [], "c": [], "other": [], "d": []})

    met = _met_blocks(df, "k", ["v", "c"], df.count())
    total = met.groupBy("p", "q").applyInPandas(sums, "k long, c long, other long, d double").groupBy("k", "c", "other").agg(F.sum("d").alias("d"))
    sizes = df.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n"))
    mean = total.join(sizes, "other").withColumn("m", F.when(F.col("c") == F.col("other"), F.col("d") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("d") / F.col("n")))
    ab = mean.groupBy("k", "c").agg(F.max(F.when(F.col("c") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("other"), F.col("m"))).alias("b"))
    return ab.select(F.col("k").alias(key), F.col("c").alias(cluster), F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def separability(scores: DataFrame) -> DataFrame:
    """The mean silhouette and the estimate made from it: 50 + 90 s, within 0 and 99.9."""
    s = F.avg("silhouette")
    return scores.agg(s.alias("silhouette"), F.least(F.greatest(50 + 90 * s, F.lit(0.0)), F.lit(99.9)).alias("estimate"))


def uniformity(df: DataFrame, key: str, vector: str, t: float = 2.0) -> DataFrame:
    """log(sum(exp(-t d))) / pairs over distances of normalised vectors (0 without pairs), and mean |cosine| with a zero diagonal over n^2."""
    df = df.select(F.col(key).alias("k"), l2_normalize(F.col(vector).cast("array<double>")).alias("v"))

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        p, q = g["p"].iloc[0], g["q"].iloc[0]
        a, b = g[g["b"] == p], g[g["b"] == q]
        if not len(a) or not len(b):
            return pd.DataFrame({"e": [], "c": [], "n": []})
        u, w = np.stack(a["v"]), np.stack(b["v"])
        e, total, n = 0.0, 0.0, 0
        strip = max(1, STRIP // len(w))
        for k in range(0, len(u), strip):
            x = u[k : k + strip]
            c = x @ w.T
            # Of a block with itself, each point beside those after it.
            at = np.arange(len(w)) > np.arange(k, k + len(x))[:, None] if p == q else np.ones(c.shape, bool)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (w**2).sum(1)[None] - 2 * c, 0))
            e, total, n = e + np.exp(-t * d[at]).sum(), total + np.abs(c[at]).sum(), n + int(at.sum())
        return pd.DataFrame({"e": [e], "c": [total], "n": [n]})

    n = df.count()
    total = _met_blocks(df, "k", ["v"], n).groupBy("p", "q").applyInPandas(sums, "e double, c double, n long").agg(F.sum("e").alias("e"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    u = F.log("e") / F.col("n")
    return total.select(F.when((F.col("n") > 0) & (F.col("e") > 0), u).otherwise(0.0).alias("uniformity"), F.coalesce(2 * F.col("c") / F.lit(max(1, n)) / F.lit(max(1, n)), F.lit(0.0)).alias("mean_abs_cosine"))


def uniformity_features(df: DataFrame, key: str, vector: str, t: float = 2.0, draws: int = 4096, seed: int = 42, risk: float = 0.05) -> DataFrame:
    """uniformity() for any number of points: (uniformity, mean_kernel, error, n), one row, from one pass of sums.

    exp(-t d) is the characteristic function of a Cauchy distribution, so its sum over all ordered pairs is the mean, over draws w from that,
    of |sum exp(i w x)|^2. A draw's share of n^2 is between 0 and 1, so by Hoeffding mean_kernel, the mean of exp(-t d) over ordered pairs with
    each point beside itself, is off by more than `error` with a probability of `risk` at most. Null vectors are left out; under
    two points, or where the estimate leaves nothing for pairs, uniformity is 0.
    """
    v = df.where(F.col(vector).isNotNull()).select(l2_normalize(F.col(vector).cast("array<double>")).alias("v"))

    def sums(batches):
        total, n, w = np.zeros((2, draws)), 0, None
        for g in batches:
            if len(g):
                x = np.stack(g["v"])
                if w is None:
                    rng = np.random.default_rng(seed)
                    w = t * rng.normal(size=(x.shape[1], draws)) / np.abs(rng.normal(size=draws))
                for k in range(0, len(x), BLOCK):
                    a = x[k : k + BLOCK] @ w
                    total += np.cos(a).sum(0), np.sin(a).sum(0)
                n += len(x)
        if n:
            yield pd.DataFrame({"draw": np.arange(draws), "c": total[0], "s": total[1], "n": n})

    each = v.mapInPandas(sums, "draw int, c double, s double, n long").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("c", "s", "n")))
    n = F.coalesce(F.max("n"), F.lit(0))
    one = each.agg(n.alias("n"), F.avg((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.col("n").cast("double") * F.col("n"))).alias("mean_kernel"))
    pairs, size = F.col("n") * (F.col("n") - 1) / 2, F.col("n").cast("double")
    e = (F.col("mean_kernel") * size * size - size) / 2
    return one.select(F.when((F.col("n") > 1) & (e > 0), F.log(e) / pairs).otherwise(0.0).alias("uniformity"), "mean_kernel", F.lit(float(np.sqrt(np.log(2 / risk) / (2 * draws)))).alias("error"), "n")


def linear_probe(train: DataFrame, val: DataFrame, vector: str, label: str, one_vs_rest: bool = False) -> DataFrame:
    """val with y_pred of a linear classifier on frozen features."""
    prepared = [d.withColumns({"_features": array_to_vector(F.col(vector).cast("array<double>")), "_label": F.col(label).cast("double")}) for d in (train, val)]
    model = LogisticRegression(maxIter=100, regParam=1e-3, featuresCol="_features", labelCol="_label", predictionCol="_predicted", rawPredictionCol="_raw", probabilityCol="_probability")
    many = OneVsRest(classifier=model, featuresCol="_features", labelCol="_label", predictionCol="_predicted", rawPredictionCol="_raw")
    fitted = (many if one_vs_rest else model).fit(prepared[0])
    return fitted.transform(prepared[1]).withColumn("y_pred", F.col("_predicted").cast("int")).drop("_features", "_label", "_raw", "_probability", "_predicted")


def linear_probe_multilabel(train: DataFrame, val: DataFrame, vector: str, labels: list[str]) -> DataFrame:
    """val with a score for each label column, a binary classifier each."""
    prep = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    train, val = prep(train), prep(val)
    for c in labels:
        m = LogisticRegression(maxIter=100, regParam=1e-3, labelCol=c, featuresCol="features", probabilityCol=f"_p_{c}", rawPredictionCol=f"_r_{c}", predictionCol=f"_y_{c}").fit(train)
        val = m.transform(val).withColumn(f"score_{c}", vector_to_array(f"_p_{c}")[1]).drop(f"_p_{c}", f"_r_{c}", f"_y_{c}")
    return val.drop("features")


def apply_linear_head(vector: Column | str, weights: list[list[float]], bias: list[float]) -> Column:
    """Scores x W + b, an array."""
    v = S.col(vector)
    return F.array(*(dot(v, F.array(*map(F.lit, w))) + b for w, b in zip(weights, bias, strict=True)))
