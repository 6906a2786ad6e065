"""Registered queries whose rows SQL can't say, against numpy on the whole of the smallest tables."""

import duckdb
import numpy as np
import pytest

from gridloom.operators import embeddings
from gridloom.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def table():
    """vec_id, labels and vectors in ascending vec_id."""
    df = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{DIR}/embeddings.parquet' ORDER BY vec_id").df()
    return df["vec_id"].to_numpy(), df["label"].to_numpy(), np.stack(df["embedding"]).astype(float)


def rows(spark, name: str, key: str) -> dict:
    found = QUERIES[name](spark, DIR).collect()
    assert len({r[key] for r in found}) == len(found)
    return {r[key]: r for r in found}


def test_projection_is_that_of_the_singular_vectors(spark, table):
    ids, _, x = table
    c = x - x.mean(0)
    # Signs of components are free, so the query gives absolute coordinates.
    want = np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][:2].T)
    got = rows(spark, "j1_pca_project", "vec_id")
    assert np.allclose([[got[k]["c0"], got[k]["c1"]] for k in ids.tolist()], want, atol=2e-6)


def test_clusters_are_of_the_nearest_centre_and_as_tight_as_restarts(spark, table):
    ids, _, x = table
    got = rows(spark, "j2_kmeans", "vec_id")
    found = np.array([got[k]["cluster"] for k in ids.tolist()])
    assert set(found) == set(range(5))

    def squares(labels: np.ndarray) -> np.ndarray:
        centres = np.stack([x[labels == k].mean(0) for k in range(5)])
        return ((x[:, None] - centres[None]) ** 2).sum(-1)

    d = squares(found)
    own = d[np.arange(len(x)), found]
    # The last step may have moved a centre a little after points were dealt.
    assert (own <= d.min(1) * 1.02 + 1e-9).mean() > 0.97
    best, rng = np.inf, np.random.default_rng(1)
    for _ in range(8):
        labels = ((x[:, None] - x[rng.choice(len(x), 5, replace=False)][None]) ** 2).sum(-1).argmin(1)
        for _ in range(30):
            if len(set(labels)) < 5:
                break
            labels = squares(labels).argmin(1)
        else:
            best = min(best, squares(labels).min(1).sum())
    assert own.sum() <= 1.05 * best


def test_probe_on_held_out_rows_is_the_best_regularised_one(spark, table):
    ids, y, x = table
    held = ids % 5 == 0
    names, t = np.unique(y[~held], return_inverse=True)
    z = x / x[~held].std(0, ddof=1)
    a = np.hstack([z[~held], np.ones((int((~held).sum()), 1))])
    w, one = np.zeros((a.shape[1], len(names))), np.eye(len(names))[t]
    # Accelerated descent on the mean loss of the true classes with 1e-3 / 2 of the squared weights, intercepts free.
    free = np.vstack([np.full((z.shape[1], 1), 1e-3), [[0.0]]])
    step, before = 1 / (np.linalg.eigvalsh(a.T @ a / len(a))[-1] / 2 + 1e-3), w
    for k in range(6000):
        ahead = w + k / (k + 3) * (w - before)
        s = a @ ahead
        p = np.exp(s - s.max(1, keepdims=True))
        before, w = w, ahead - step * (a.T @ (p / p.sum(1, keepdims=True) - one) / len(a) + free * ahead)
    said = names[(np.hstack([z[held], np.ones((int(held.sum()), 1))]) @ w).argmax(1)]
    got = QUERIES["j6_linear_probe"](spark, DIR).first()["overall_accuracy"]
    assert got == pytest.approx((said == y[held]).mean(), abs=2.5 / held.sum())


def _rx(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Mean and largest score of a pair: squared lengths of the four leading whitened components, over their 99th percentile."""
    x = np.concatenate([a, b])
    x = x - x.mean(1, keepdims=True)
    _, values, right = np.linalg.svd(x, full_matrices=False)
    n = x.shape[1]
    variances = values[:4] ** 2 / (n - 1)
    score = ((values[:4, None] * right[:4]) ** 2 / (variances + 1e-6)[:, None]).sum(0)
    score = np.clip(score / np.percentile(score, 99), 0, 1)
    return float(score.mean()), float(score.max())


def test_rx_scores_of_all_pairs(spark, table):
    ids, _, x = table
    # Single precision, as the table has it, widened: the query's own rule for pixels.
    bands = np.floor((x + 0.6) * 200).reshape(len(x), 4, 16)[:, :3]
    at = {k: i for i, k in enumerate(ids.tolist())}
    got = rows(spark, "g3_pca_rx", "patch_a")
    assert set(got) == {k for k in at if k % 2 == 0 and k + 1 in at}
    want = np.array([_rx(bands[at[k]], bands[at[k + 1]]) for k in got])
    assert np.allclose([[r["mean_pca_score"], r["max_pca_score"]] for r in got.values()], want, atol=2e-5)


def test_distances_keep_their_digits_near_and_far():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(70, 9)) + 1e4
    w = np.vstack([u[:20] + 1e-9 * rng.normal(size=(20, 9)), u[20:30], rng.normal(size=(15, 9)) + 1e4])
    want = np.sqrt(((u[:, None] - w[None]) ** 2).sum(-1))
    old, embeddings.NEAR = embeddings.NEAR, 7
    try:
        assert np.allclose(embeddings._distances(u, w), want, rtol=1e-8, atol=1e-11)
    finally:
        embeddings.NEAR = old
