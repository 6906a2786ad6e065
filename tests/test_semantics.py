"""Small cases of the rules that are easy to get wrong, and properties."""

import gzip
import json
import re
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import change, datasets, embeddings, experiments, landcover, metrics, raster, registries, tiles
from gridloom.operators import spatial as G
from gridloom.plans import change as plan_change
from gridloom.plans.fixtures import Tables
from gridloom.sources import catalogue as C
from gridloom.sources import layout


def values(df, *cols):
    return [tuple(r) if len(cols) != 1 else r[0] for r in df.select(*cols).collect()]


def test_dates_take_the_first_match_only(spark):
    df = spark.createDataFrame([("GF100_0200_04400368_20191118120602_x",), ("ZY1F_20240102_x",), ("plain",)], "n string")
    assert [str(v) for v in values(df, S.reparse_date("n").alias("d"))] == ["None", "2024-01-02", "None"]
    assert [str(v) for v in values(df, S.parse_date_strict("n").alias("d"))] == ["2019-11-18", "None", "None"]
    assert values(df, S.parse_satellite("n").alias("s")) == ["GF100", "ZY1F", "plain"]


def test_empty_sensor_counts_as_missing(spark):
    df = spark.createDataFrame([("a_PMS1_b", "x"), ("a_b", ""), ("a_b", "MUX")], "n string, m string")
    assert values(df, S.parse_sensor("n", "m").alias("s")) == ["PMS1", None, "MUX"]


def test_ddof_and_constant_groups(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 2, 3, 4])], "g int, px int, v double")
    x = np.array([1, 2, 3, 4.0])
    for ddof in (0, 1):
        got = sorted(values(raster.zscore(df, ["g"], ddof), "v"))
        assert np.allclose(got, (x - x.mean()) / (x.std(ddof=ddof) + 1e-6))


def test_empty_tiles_are_dropped_only_above_the_share(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (2, 0), (2, 0), (2, 5)], "t int, v int")
    assert set(values(raster.drop_empty_tiles(df, ["t"]), "t")) == {1}


def test_thumb_stats_need_all_bands_dark_and_give_null_without_valid_pixels(spark):
    df = spark.createDataFrame([("a", b, p, v) for p in range(16) for b, v in ((0, 3), (1, 9 if p else 3))] + [("z", b, p, 0) for p in range(16) for b in (0, 1)], "k string, band int, px int, v int")
    r = {x["k"]: x for x in raster.thumb_stats(df, ["k"], 4, 4).collect()}
    assert r["a"]["black_edge_ratio"] == 1 / 16 and r["a"]["brightness_mean"] == 6 and r["a"]["brightness_std"] == 3
    assert r["z"]["brightness_mean"] is None and r["z"]["center_dark_ratio"] == 1


def test_pairs_inclusive_threshold_and_no_contacts(spark):
    p = spark.createDataFrame([("a", "s", "2025Q1", "2025-01-05", 0.0, 0.0, 2.0, 2.0), ("b", "s", "2025Q2", "2025-04-01", 0.0, 0.0, 2.0, 1.0), ("c", "s", "2025Q2", "2025-01-01", 2.0, 0.0, 4.0, 2.0)], "patch_path string, scene_id string, quarter string, date string, minx double, miny double, maxx double, maxy double").withColumn("date", F.col("date").cast("date"))
    pairs = G.spatial_pair(p, 0.5)
    assert values(pairs, "patch_path_a", "patch_path_b", "iou", "share_a", "share_b", "days_gap") == [("a", "b", 0.5, 0.5, 1.0, 86)]
    back = G.reoriented(pairs, "2025Q2", "2025Q1")
    assert values(back, "patch_path_a", "share_a", "share_b", "days_gap") == [("b", 1.0, 0.5, -86)]


def test_all_quarters_are_paired_and_far_quarters_pruned(spark):
    from gridloom.plans import geometry, registry

    # 1992Q1 and 1995Q3 cover one place; 1997Q2 covers ten more cells than they do, so its IoU with them is 1 / 11.
    d = geometry.CELL
    at = lambda q, k, dx=0.0: (f"{q}/{k}", "s", q, "2025-01-01", k * d + dx, 0.0, (k + 1) * d + dx, d)
    rows = [at("1992Q1", 0), at("1995Q3", 0), at("1995Q3", 0, d / 4), at("1997Q2", 0)]
    schema = "patch_path string, scene_id string, quarter string, date string, minx double, miny double, maxx double, maxy double"
    patches = spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))
    scenes = spark.createDataFrame([("1992Q1", 0.0, 0.0, d, d), ("1995Q3", 0.0, 0.0, d, d), ("1997Q2", 0.0, 0.0, 11 * d, d)], "quarter string, minx double, miny double, maxx double, maxy double")
    assert values(geometry.all_pairs({"fx_patches": patches, "fx_scenes": scenes}), "quarter_a", "quarter_b", "iou") == [("1992Q1", "1995Q3", 1.0)]
    made = registry.queries()["e2_pair_summary"](spark, "/root/testdata/sf0.001")
    assert made.where("quarter_a not like '1998%' or quarter_b not like '1998%'").count()


def test_every_run_has_a_rank_and_every_label_grid_can_be_named(spark):
    from gridloom.plans import registry
    from gridloom.plans.fixtures import Tables

    dir_ = "/root/testdata/sf0.001"
    t, q = Tables(spark, dir_), registry.queries()
    assert q["i5_rank_sensitivity"](spark, dir_).agg(F.sum("n")).first()[0] == t["fx_runs"].count()
    sf = "/root/testdata/sf0.1"  # the smallest tables with more than 500 label grids
    t = Tables(spark, sf)
    grids = t["embeddings"].count()
    assert grids > 500 and t["fx_patches"].select((F.col("scene_key") % grids).alias("g")).distinct().count() == grids
    assert q["f8_slice_labels"](spark, dir_).count() == 9 * Tables(spark, dir_)["fx_patches"].count()


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    boxes = [(f"p{k}", "s", f"q{k % 3}", "2025-01-01", float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(zip(rng.uniform(-20, 20, 150), rng.uniform(-20, 20, 150), rng.uniform(0.1, 9, 150), rng.uniform(0.1, 9, 150), strict=True))]
    p = spark.createDataFrame(boxes, "patch_path string, scene_id string, quarter string, date string, minx double, miny double, maxx double, maxy double").withColumn("date", F.col("date").cast("date"))
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[2] < b[2] and min(a[6], b[6]) > max(a[4], b[4]) and min(a[7], b[7]) > max(a[5], b[5])}
    made = values(G.spatial_pair(p, 0.0), "patch_path_a", "patch_path_b")
    assert len(made) == len(want) and set(made) == want


def test_places_are_found_in_one_pass_and_pairs_joined_by_their_numbers(spark, tmp_path):
    def seen(batches):
        tempfile.mkstemp(dir=tmp_path)
        yield from batches

    rows = [(f"{q}{k}", "s", q, k % 3 * 1.0, 0.0, k % 3 + 10.0, 10.0) for q in "xy" for k in range(12)]
    schema = "patch_path string, scene_id string, quarter string, minx double, miny double, maxx double, maxy double"
    p = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(seen, schema)
    assert len(G.near_places(p, 0.5).collect()) == 9
    assert len(list(tmp_path.iterdir())) == 1
    pairs = G.spatial_pair(p.withColumn("date", F.lit("2025-01-01").cast("date")), 0.8)
    assert len(list(tmp_path.iterdir())) == 2
    made = {tuple(r) for r in pairs.select("patch_path_a", "patch_path_b", F.round("iou", 9), F.round("share_a", 9)).collect()}
    shared = lambda j, k: 10 - abs(j % 3 - k % 3)
    assert made == {(f"x{j}", f"y{k}", round(shared(j, k) / (20 - shared(j, k)), 9), shared(j, k) / 10) for j in range(12) for k in range(12) if shared(j, k) >= 9}


def test_pairs_read_the_patches_once_and_move_them_once(spark, tmp_path):
    def seen(batches):
        tempfile.mkstemp(dir=tmp_path)
        yield from batches

    rows = [(f"{q}{k}", q, k % 3 * 1.0, 0.0, k % 3 + 10.0, 10.0) for q in "xy" for k in range(12)]
    schema = "patch_path string, quarter string, minx double, miny double, maxx double, maxy double"
    p = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(seen, schema).withColumns({"scene_id": F.lit("s"), "date": F.lit("2025-01-01").cast("date")})
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        pairs = G.spatial_pair(p, 0.8, quarter_iou=spark.createDataFrame([("x", "y", 0.5)], "quarter_a string, quarter_b string, iou double"))
        assert pairs.count() == 16 * 7
        assert len(list(tmp_path.iterdir())) == 1
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # A side of the join is the other's exchange.
    assert re.search(r"ReusedExchange .*hashpartitioning\(place", plan)


def test_pairs_of_unequally_crowded_places_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    # Places of several sizes, crowded by 1 to 30 patches; one so large that its area isn't a number, one without area, one without a bound.
    places = [(float(x), 0.0, float(x + w), 10.0) for x, w in ((0, 10), (1, 10), (2, 10), (0, 12), (4, 9), (30, 10), (31, 10), (60, 10))]
    places += [(-1e200, -1e200, 1e200, 1e200), (5.0, 5.0, 5.0, 9.0), (None, 0.0, 9.0, 9.0)]
    rows = [(f"p{k}-{j}", None if rng.random() < 0.05 else f"q{rng.integers(4)}", f"2025-01-{1 + int(rng.integers(28)):02d}", *box) for k, box in enumerate(places) for j in range([1, 30, 4][k % 3])]
    p = spark.createDataFrame(rows, "patch_path string, quarter string, date string, minx double, miny double, maxx double, maxy double").withColumn("date", F.col("date").cast("date"))
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    for least in (0.0, 0.5, 0.8):
        want = set()
        for a in rows:
            for b in rows:
                if a[1] is None or b[1] is None or a[1] >= b[1] or (a[1], b[1]) == ("q0", "q3") or None in (a[3], b[3]):
                    continue
                w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
                if w > 0 and h > 0 and (iou := w * h / (area(a) + area(b) - w * h)) >= least:
                    want.add((a[0], b[0], a[1], b[1], int(b[2][-2:]) - int(a[2][-2:]), iou, w * h / area(a), w * h / area(b)))
        pruned = spark.createDataFrame([("q0", "q3", 0.05), ("q3", "q0", 0.05), ("q1", "q2", 0.5)], "quarter_a string, quarter_b string, iou double")
        made = values(G.spatial_pair(p, least, quarter_iou=pruned), "patch_path_a", "patch_path_b", "quarter_a", "quarter_b", "days_gap", "iou", "share_a", "share_b")
        assert len(made) == len(want) > 500 and set(made) == want


def test_quarter_iou_is_symmetric_with_ones(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 0.0, 3.0, 2.0), ("c", 9.0, 9.0, 10.0, 10.0)], "quarter string, minx double, miny double, maxx double, maxy double")
    m = {(r[0], r[1]): r[2] for r in G.quarter_iou(s, 1.0).collect()}
    assert all(m[k] == m[k[::-1]] and 0 <= v <= 1 for k, v in m.items()) and all(m[q, q] == 1 for q in "abc") and m["a", "b"] == pytest.approx(1 / 3)


def test_rasterised_slanted_ring_equals_brute_force(spark):
    ring = [(12.0, 3.0), (71.0, 22.0), (40.0, 66.0), (12.0, 3.0)]
    poly = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "way_id int, ring array<struct<x:double,y:double>>")
    patch = spark.createDataFrame([("p", 0.0, 0.0, 80.0, 80.0)], "patch_path string, minx double, miny double, maxx double, maxy double")
    made = {tuple(r) for r in G.rasterize(poly, patch, 10.0, 8).select("row", "col").collect()}
    # Dense points of the triangle, as barycentric sums, and the cells they are in.
    u, v = np.meshgrid(np.linspace(0, 1, 1501), np.linspace(0, 1, 1501))
    keep = u + v <= 1
    a, b, c = (np.array(p) for p in ring[:3])
    pts = a + u[keep][:, None] * (b - a) + v[keep][:, None] * (c - a)
    want = {(7 - int(y // 10), int(x // 10)) for x, y in pts}
    assert made == want


def test_rasterised_polygons_with_holes_over_many_patches_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    spokes = lambda n, x, y, lo, hi: [(x + r * np.cos(a), y + r * np.sin(a)) for a, r in zip(np.linspace(0, 2 * np.pi, n, endpoint=False), rng.uniform(lo, hi, n), strict=True)]
    rings = [(1, spokes(90, 200.3, 190.1, 120, 160)), (1, spokes(11, 190.7, 200.2, 40, 70)), (None, spokes(7, 330.1, 60.4, 30, 50)), (3, spokes(3, 5.2, 5.1, 1, 2)), (4, spokes(5, 60.3, 330.9, 40, 60))]
    rings = [(w, [*map(tuple, np.round(r, 3).tolist()), tuple(np.round(r[0], 3).tolist())]) for w, r in rings]
    poly = spark.createDataFrame([(w, [{"x": x, "y": y} for x, y in r]) for w, r in rings], "way_id int, ring array<struct<x:double,y:double>>")
    size, gsd = 70, 1.5
    boxes = [(f"p{i}{j}{z}", i * 105.0 + z, j * 105.0 - z) for i in range(4) for j in range(4) for z in (0.0, 0.4)]
    patch = spark.createDataFrame([(n, x, y, x + size * gsd, y + size * gsd) for n, x, y in boxes], "patch_path string, minx double, miny double, maxx double, maxy double")
    made = {}
    for r in G.rasterize(poly, patch, gsd, size, 20.0).collect():
        assert (r["row"], r["col"]) not in made.setdefault(r["patch_path"], set())
        made[r["patch_path"]].add((r["row"], r["col"]))
    y_in, x_in = np.mgrid[0:size, 0:size] + 0.5
    for n, x0, y0 in boxes:
        x, y, want = x0 + x_in * gsd, y0 + size * gsd - y_in * gsd, np.zeros((size, size), bool)
        for way in (1, None, 4):
            inside = np.zeros((size, size), bool)
            for r in (r for w, r in rings if w == way):
                for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        inside ^= ((ay > y) != (by > y)) & (x >= (bx - ax) * (y - ay) / (by - ay) + ax)
                    # The places where the edge meets a line of the grid cut it; each piece's middle lies in one cell.
                    lines = [(x0 + np.arange(size + 1) * gsd - ax) / (bx - ax), (y0 + np.arange(size + 1) * gsd - ay) / (by - ay), [0.0, 1.0]]
                    f = np.unique(np.clip(np.concatenate(lines), 0, 1))
                    f = (f[1:] + f[:-1]) / 2
                    c, d = np.floor((ax + f * (bx - ax) - x0) / gsd).astype(int), np.floor((y0 + size * gsd - ay - f * (by - ay)) / gsd).astype(int)
                    ok = (c >= 0) & (c < size) & (d >= 0) & (d < size)
                    want[d[ok], c[ok]] = True
            want |= inside
        assert made.get(n, set()) == set(map(tuple, np.argwhere(want).tolist())), n


def test_ways_skip_missing_nodes_close_and_drop_short(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 9]), (3, [1, 2, 3, 1])], "way_id int, nodes array<int>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "node_id int, lon double, lat double")
    r = {x["way_id"]: len(x["ring"]) for x in G.assemble_ways(ways, nodes).collect()}
    assert r == {1: 4, 3: 4}


def test_remap_unknown_to_zero(spark):
    df = spark.createDataFrame([(7,), (3,), (11,)], "code int")
    assert values(landcover.remap_classes(df), "code") == [1, 0, 5]


def test_class_delta_needs_both_years(spark):
    df = spark.createDataFrame([(2022, 1), (2022, 2)], "year int, code int")
    assert landcover.class_delta(df, 1, 2022, 2023).count() == 0
    both = df.unionByName(spark.createDataFrame([(2023, 5)], "year int, code int"))
    assert values(landcover.class_delta(both, 5, 2022, 2023), "delta", "delta_pct") == [(1, None)]


def test_scene_split_keeps_scenes_apart_and_one_scene_is_validation(spark):
    df = spark.createDataFrame([(f"s{k % 5}", k) for k in range(20)], "scene_id string, k int")
    got = datasets.scene_split(df, 0.2).groupBy("split").agg(F.collect_set("scene_id").alias("s")).collect()
    sides = {r["split"]: set(r["s"]) for r in got}
    assert sides["val"] == {"s4"} and not sides["val"] & sides["train"]
    assert set(values(datasets.scene_split(df.where("scene_id = 's0'")), "split")) == {"val"}


def test_scene_split_ranks_by_ranges(spark):
    names = [f"s{k:04d}" for k in range(997)]
    df = spark.createDataFrame([(s, k) for s in names for k in range(2)] + [(None, 0)], "scene_id string, k int")
    got = datasets.scene_split(df, 0.2)
    assert set(values(got.where("split = 'val'"), "scene_id")) == set(names[-199:]) and got.count() == 1995
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_rx_mean_identity_and_range():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (3, 6, 256)).astype(float)
    c = x - x.mean(2, keepdims=True)
    assert c.shape == x.shape
    maps = change.rx_maps(x)
    assert maps.min() >= 0 and maps.max() <= 1
    # Before scaling, whitened scores of 4 components sum to 4 (N - 1) / N a pixel.
    vec = np.linalg.eigh(c @ c.transpose(0, 2, 1) / 255)[1][:, :, ::-1][:, :, :4]
    y = vec.transpose(0, 2, 1) @ c
    s = np.einsum("pin,pij,pjn->pn", y, np.linalg.pinv(y @ y.transpose(0, 2, 1) / 255), y)
    assert np.allclose(s.mean(1), 4 * 255 / 256)
    assert np.allclose(maps, np.clip(s / np.percentile(s, 99, axis=1, keepdims=True), 0, 1), atol=1e-6)


def test_pca_rx_column_equals_rx_maps(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 3, 64))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<int>>, b array<array<int>>")
    got = df.select(change.pca_rx("a", "b").alias("s")).select("s.*").first()
    want = change.rx_maps(np.concatenate([a, b])[None].astype(float))
    assert np.allclose(tuple(got), (want.mean(), want.max()))


def test_average_precision_groups_ties_and_gives_zero_without_positives(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.5), ("a", 1, 0.5), ("b", 0, 0.4)], "class string, y_bin int, score double")
    got = dict(values(metrics.average_precision(df), "class", "ap"))
    assert got["a"] == pytest.approx(0.5 + 0.5 * 2 / 3) and got["b"] == 0


def test_macro_f1_over_both_sides(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "y_true int, y_pred int")
    assert values(metrics.macro_f1(df), "macro_f1") == [pytest.approx(1 / 3)]


def test_losses_ignore_255(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 3.0], 255)], "logits array<double>, target int")
    ce = np.log(1 + np.exp(-1.0))
    assert values(metrics.cross_entropy(df), "cross_entropy") == [pytest.approx(ce)]
    assert values(metrics.focal_loss(df), "focal_loss") == [pytest.approx((1 - np.exp(-ce)) ** 2 * ce / 2)]


def test_silhouette_and_uniformity_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(x, c, strict=True))], "k long, v array<double>, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(60):
        own = (c == c[i]) & (np.arange(60) != i)
        a, b = d[i][own].mean(), min(d[i][c == o].mean() for o in set(c.tolist()) - {int(c[i])})
        want.append((b - a) / max(a, b))
    old, embeddings.BLOCK = embeddings.BLOCK, 25
    try:
        got = dict(values(embeddings.silhouette(df, "k", "v", "c"), "k", "silhouette"))
        u = embeddings.uniformity(df, "k", "v").first()
    finally:
        embeddings.BLOCK = old
    assert np.allclose([got[k] for k in range(60)], want)
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = np.triu_indices(60, 1)
    assert u["uniformity"] == pytest.approx(np.log(np.exp(-2 * np.sqrt(((z[at[0]] - z[at[1]]) ** 2).sum(1))).sum()) / len(at[0]))
    kernel = np.exp(-2 * np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))).mean()
    for draws in (256, 20000):
        f = embeddings.uniformity_features(df.repartition(5), "k", "v", draws=draws).first()
        assert f["n"] == 60 and abs(f["mean_kernel"] - kernel) <= f["error"] == pytest.approx(np.sqrt(np.log(40) / 2 / draws))
    assert f["uniformity"] == pytest.approx(u["uniformity"], rel=0.02)
    assert [embeddings.uniformity_features(df.where(w), "k", "v", draws=64).first()["uniformity"] for w in ("k < 0", "k = 1")] == [0.0, 0.0]


def test_pca_projection_has_the_leading_variances(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    p = np.array(values(embeddings.pca_project(df, "k", "v"), "projected"))
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(p.var(axis=0, ddof=1), want) and np.allclose(p.mean(axis=0), 0)


def test_linear_probes_learn(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 200)
    x = np.eye(3)[y] * 4 + rng.normal(size=(200, 3))
    df = spark.createDataFrame([(k, v.tolist(), int(c), int(c == 1)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "k int, v array<double>, label int, one int")
    train, val = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    for many in (False, True):
        out = embeddings.linear_probe(train, val, "v", "label", many)
        assert out.where("y_pred = label").count() > 0.85 * out.count()
    s = embeddings.linear_probe_multilabel(train, val, "v", ["one"])
    assert s.where("(score_one > 0.5) = (one = 1)").count() > 0.85 * s.count()


def test_reoriented_activation_and_registration(spark):
    m = spark.createDataFrame([(1, True), (2, False)], "model_id int, is_active boolean")
    assert dict(values(registries.activate_model(m, 2), "model_id", "is_active")) == {1: False, 2: True}
    with pytest.raises(KeyError):
        registries.activate_model(m, 9)
    old = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 1, "c")], "id int, at int, v string")
    assert sorted(values(registries.register_result(old, new, "id", "at"), "id", "v")) == [(1, "c"), (2, "b")]


def test_progress_of_json_and_of_rows(spark):
    jobs = spark.createDataFrame([(1, '{"epoch": [1, 2], "loss": [0.5, 0.25]}'), (2, '{"epoch": [], "loss": []}'), (3, None)], "job int, metrics string")
    assert sorted(values(registries.job_progress(jobs), "job", "current_epoch", "last_loss", "n_entries")) == [(1, 2, 0.25, 2), (2, 0, None, 0), (3, 0, None, 0)]
    other = ['[{"epoch": 4, "loss": 3}, {"epoch": 5, "loss": "x", "lr": 1}]', '{"epoch": 6, "loss": 0.5}', '{"epoch": [1, "a"], "loss": null}', "no json", "[]", "7", '{"epoch": [3], "loss": [[1], 0.25]}']
    got = sorted(values(registries.job_progress(spark.createDataFrame(list(enumerate(other)), "job int, metrics string")), "job", "current_epoch", "last_loss", "n_entries"))
    assert got == [(0, 5, None, 2), (1, 6, 0.5, 1), (2, 0, None, 0), (3, 0, None, 0), (4, 0, None, 0), (5, 0, None, 0), (6, 3, 0.25, 2)]
    rows = spark.createDataFrame([(1, 7, 1, 0.5), (1, 8, 2, 0.25), (2, 1, None, None)], "job int, at int, epoch int, loss double")
    assert sorted(values(registries.entry_progress(rows, "job", "at", "epoch", "loss"), "job", "current_epoch", "last_loss", "n_entries")) == [(1, 2, 0.25, 2), (2, 0, None, 1)]


def test_pareto_front_with_ties(spark):
    p = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6), ("c", 2, 0.6), ("d", 3, 0.7)], "m string, cost int, score double").withColumn("g", F.lit(1))
    assert sorted(values(experiments.pareto_front(p, "cost", "score", ["g"]).where("on_front"), "m")) == ["b", "d"]


def test_published_aggregates(spark):
    # Stored per-run accuracies of one configuration: population and sample deviation differ.
    runs = spark.createDataFrame([("linear", "rgb", k, v, 7690) for k, v in enumerate([0.5, 0.6, 0.7])], "method string, modality string, seed int, acc double, trainable_params int")
    r = experiments.aggregate_runs(runs, "acc").first()
    assert (r["mean"], r["std"], r["n"]) == (pytest.approx(0.6), pytest.approx(0.1), 3)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"quarter": q}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}} for q in ("a", "b")]}))
    g = C.read_geojson(spark, str(tmp_path / "g.geojson"))
    assert sorted(values(g, "quarter")) == ["a", "b"] and g.first()["geometry_type"] == "Polygon"
    for k, cols in enumerate(({"overall_accuracy": 0.5}, {"mAP": 0.2})):
        (tmp_path / f"run{k}.json").write_text(json.dumps([{"method": "m", "seed": k, **cols}]))
    r = C.read_results(spark, str(tmp_path / "run*.json"))
    assert sorted(values(r, "batch")) == ["run0", "run1"] and {"mAP", "overall_accuracy"} <= set(r.columns)
    patches = spark.createDataFrame([("s", "2025Q1", "p1", 128), ("s", "2025Q2", "标", 128)], "scene_id string, quarter string, patch_path string, patch_size int")
    C.write_patch_index(patches, str(tmp_path / "index"))
    back = C.read_patch_index(spark, str(tmp_path / "index"))
    assert sorted(values(back, "patch_path")) == ["p1", "标"]
    assert values(C.manifest(back), "n_patches", "quarters") == [(2, "2025Q1,2025Q2")]
    C.write_report(patches, str(tmp_path / "csv"))
    assert C.read_report(spark, str(tmp_path / "csv")).count() == 2
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfyear,pixels\n2022,5\n")
    assert C.read_report(spark, str(tmp_path / "bom.csv")).columns == ["year", "pixels"]
    C.write_geojson_points(spark.createDataFrame([(1.23456789, 2.0, 0.5)], "lon double, lat double, s double"), str(tmp_path / "pts"), "lon", "lat", ["s"])
    assert json.loads(spark.read.text(str(tmp_path / "pts")).first()[0])["geometry"]["coordinates"] == [1.234568, 2.0]
    assert C.load_labels(spark, str(tmp_path / "none")).columns == ["dataset_id", "patch_path", "label", "reviewer", "labeled_at"]
    assert C.files(spark, str(tmp_path), "*.geojson").select(F.sha2("content", 256)).count() == 1


def test_worldfile_needs_six_numbers(spark):
    df = spark.createDataFrame([("0.3\n0\n0\n-0.3\n5\n7\n",), ("1\n2",), (None,)], "t string")
    w = C.worldfile("t")
    assert values(df, *(v.alias(k) for k, v in w.items())) == [(0.3, -0.3, 5.0, 7.0), (None,) * 4, (None,) * 4]


def test_presets_and_channels(spark):
    df = spark.createDataFrame([([[float(b)] * 2 for b in range(8)],)], "bands array<array<double>>")
    assert values(df, raster.preset_bands("bands", "gf2").alias("b")) == [[[3.0, 3.0], [2.0, 2.0], [1.0, 1.0], [7.0, 7.0]]]
    assert values(df, raster.preset_bands("bands", "rgb_sar").alias("b"))[0][3] == [0.0, 0.0]


def test_fit_size_crops_and_pads(spark):
    df = spark.createDataFrame([(1, 0, p, p + 1) for p in range(4)], "k int, band int, px int, v int")
    assert sorted(values(raster.fit_size(df, 2, 2, 3, 1, ["k"]), "px", "v")) == [(0, 1), (1, 2), (2, 0)]


def test_ranges_give_exact_places_sums_and_percentiles(spark):
    from gridloom.operators import ranges

    rng = np.random.default_rng(9)
    x = rng.integers(0, 50, 400).astype(float)
    df = spark.createDataFrame([(k % 3 or None, float(v), int(k)) for k, v in enumerate(x)], "g int, v double, n int").repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = ranges.percentiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).first()
            assert np.allclose(tuple(got), [np.percentile(x, q) for q in (0, 50, 95, 100)])
            assert sorted(values(ranges.placed(df, F.col("n")), "n", "_place")) == [(k, k + 1) for k in range(400)]
            made = values(ranges.running_sums(df, "g", F.desc("n"), ["v"]), "g", "n", "running_v")
            assert len(made) == 400 and all(s == x[[k for k in range(n, 400) if (k % 3 or None) == g]].sum() for g, n, s in made)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tuple(ranges.percentiles(df.limit(0), "v", {"a": 0.5}).first()) == (None,)
    # A value of two thirds of all rows is one row of the ranges.
    often = np.concatenate([x, np.full(800, 7.0)])
    got = ranges.percentiles(df.select("v").union(spark.range(800).select(F.lit(7.0))), "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert np.allclose(tuple(got), [np.percentile(often, q) for q in (10, 50, 90)])
    assert tuple(ranges.percentiles(df.where("n = 5"), "v", {"a": 0.95}).first()) == (x[5],)


def test_cells_of_a_slanted_ring_are_those_with_their_centre_inside(spark):
    ring = [(12.0, 3.0), (71.0, 22.0), (40.0, 66.0), (30.0, 20.0), (12.0, 3.0)]
    df = spark.createDataFrame([("q", [{"x": x, "y": y} for x, y in ring])], "quarter string, ring array<struct<x:double,y:double>>")
    made = {tuple(r) for r in G.ring_cells(df, 4.0, "ring").select("gx", "gy").collect()}
    want = set()
    for i in range(30):
        for j in range(30):
            x, y, inside = i * 4 + 2, j * 4 + 2, False
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    inside = not inside
            if inside:
                want.add((i, j))
    assert made == want and len(made) > 40


def test_array_forms_equal_cell_forms(spark):
    rng = np.random.default_rng(11)
    bands = rng.integers(0, 9, (5, 3, 16)).astype(float)
    bands[0, 0] = 0
    df = spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(bands)], "t int, bands array<array<double>>")
    cells = raster.explode_pixels(df, ["t"])
    flat = lambda d: sorted((*map(int, r[:-1]), round(r[-1], 9)) for r in values(d, "t", "band", "px", "v"))
    held = lambda c: flat(raster.explode_pixels(df.select("t", c.alias("bands")), ["t"]))
    for ddof in (0, 1):
        assert held(raster.zscore_bands("bands", ddof, True)) == flat(raster.zscore(cells, ["t", "band"], ddof, True))
    for n in ((6, 6), (3, 5), (4, 4)):
        assert held(raster.bilinear_bands("bands", 4, 4, *n)) == flat(raster.resample_bilinear(cells, ["t", "band"], 4, 4, *n))
        assert held(raster.nearest_bands("bands", 4, 4, *n)) == flat(raster.resample_nearest(cells, ["t", "band"], 4, 4, *n))
    assert held(raster.average_bands("bands", 4, 4, 2)) == flat(raster.resample_average(cells, ["t", "band"], 4, 2))
    assert held(raster.scale_01_bands("bands", always=False)) == flat(raster.scale_01(cells, ["t"]))
    for share in (0.1, 0.2):
        assert set(values(raster.without_empty_tiles(df, max_zero=share), "t")) == set(values(raster.drop_empty_tiles(cells, ["t"], share), "t"))
    names = ["black_edge_ratio", "center_dark_ratio", "brightness_mean", "brightness_std"]
    want = {r["t"]: [r[c] for c in names] for r in raster.thumb_stats(cells, ["t"], 4, 4).collect()}
    for r in df.select("t", raster.thumb_stats_bands("bands", 4, 4).alias("s")).collect():
        assert [x if x is None else pytest.approx(x) for x in r["s"]] == want[r["t"]]


def test_index_reads_the_parts_that_filters_name_and_merges_its_folders(spark, tmp_path):
    from gridloom.streaming import incremental

    schema = spark.createDataFrame([], "k long, v string").schema
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    index = lambda: incremental.incremental_index(spark, source, schema, lambda df: df, ["k"], out, state, 1)
    add([(k, "a") for k in range(500)] + [(None, "a")])
    index()
    add([(k, "b") for k in range(1000, 1400)])
    index()
    # Keys that no filter holds: hardly any part is read; a key that is there: its part is.
    assert sum(incremental.LAST_READ[0].values()) <= 3
    add([(7, "c"), (None, "c"), (5000, "c")])
    made = index()
    assert incremental.LAST_READ[0].get("0-0", 0) in (2, 3) and made.where("k = 7 OR k IS NULL").count() == 2
    for k in range(14):
        add([(6000 + k, "d"), (k, "d")])
    made = index()
    assert all(r.get("0-0", 0) + r.get("0-3", 0) <= 3 for r in incremental.LAST_READ)
    want = {**{k: "a" for k in (*range(500), None)}, **{k: "b" for k in range(1000, 1400)}, 5000: "c", **{6000 + k: "d" for k in range(14)}}
    assert dict(values(made, "k", "v")) == want and made.count() == len(want)
    assert incremental.spans(spark, out) == [(0, 15), (16, 16)]
    assert incremental.vacuum(spark, out) == 16 + 4 and dict(values(index(), "k", "v")) == want and incremental.vacuum(spark, out) == 0
    assert incremental.table(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(Exception, match="nosuchstore"):
        incremental.table(spark, "nosuchstore://there/x", schema)


def test_a_stopped_compaction_or_a_batch_run_again_loses_and_doubles_nothing(spark, tmp_path):
    from gridloom.streaming import incremental

    schema = spark.createDataFrame([], "k long").schema
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    index = lambda: incremental.incremental_index(spark, str(source), schema, lambda df: df, ["k"], str(out), str(state), 1)
    for k in range(4):
        spark.createDataFrame([(k,), (k + 1,)], schema).coalesce(1).write.mode("append").parquet(str(source))
        made = index()
    assert incremental.spans(spark, str(out)) == [(0, 3)]
    # As if the merge had stopped before its filter was written: the four folders count again.
    (out / "filters" / "span=0-3" / "_SUCCESS").unlink()
    assert incremental.spans(spark, str(out)) == [(k, k) for k in range(4)]
    # As if the last batch had not been acknowledged: it is known by its number, and the merge is made up for.
    for name in ("3", ".3.crc"):
        if (state / "commits" / name).exists():
            (state / "commits" / name).unlink()
    made = index()
    assert incremental.spans(spark, str(out)) == [(0, 3)] and sorted(values(made, "k")) == list(range(5))


def test_overlaps_with_a_third_of_all_boxes_in_one_cell(spark):
    from gridloom.operators import quadtree

    rng = np.random.default_rng(31)
    n = 3000
    low = rng.uniform(0, 1000, (n, 2))
    low[: n // 3] = 500 + rng.uniform(0, 0.5, (n // 3, 2))
    low[n // 3 : n // 3 + 300] = (700.0, 700.0)  # one spot, which no tree can divide
    box = np.concatenate([low, low + rng.uniform(0.5, 3, (n, 2))], axis=1)
    box[n // 3 : n // 3 + 300, 2:] = 702.0
    q = rng.integers(0, 4, n)
    schema = "id long, q string, minx double, miny double, maxx double, maxy double"
    df = spark.createDataFrame([(k, f"q{q[k]}", *map(float, box[k])) for k in range(n)] + [(-1, None, 500.0, 500.0, 501.0, 501.0), (-2, "q0", None, 0.0, 1.0, 1.0), (-3, "q0", 5.0, 5.0, 5.0, 5.0)], schema)
    i, j = np.triu_indices(n, 1)
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    size = np.minimum(box[i, 2:], box[j, 2:]) - np.maximum(box[i, :2], box[j, :2])
    shared = size[:, 0] * size[:, 1]
    area = (box[:, 2:] - box[:, :2]).prod(axis=1)
    meet = (size > 0).all(axis=1) & (q[i] < q[j]) & (shared / (area[i] + area[j] - shared) >= 0.3)
    want = sorted(zip(i[meet].tolist(), j[meet].tolist(), strict=True))
    made = quadtree.overlaps(df, df, 0.3, "q", block=200)
    assert sorted((r.id_a, r.id_b) for r in made.select("id_a", "id_b").collect()) == want
    tree = quadtree.learnt(df)
    rows, leaves = tree.leaves(box)
    # A place in the tree for every box; the crowd, which no tree can divide, is dealt to blocks of about 200 rows a side.
    assert set(rows.tolist()) == set(range(n)) and np.bincount(leaves).max() > 900
    sizes = [r["count"] for r in quadtree.dealt(df, df, tree, 200).groupBy("leaf", "p", "q").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 520
    # Boxes outside of what was sampled, and an empty side.
    few = quadtree.QuadTree.fit(box[:40])
    assert quadtree.overlaps(df, df, 0.3, "q", few).count() == len(want)
    assert quadtree.overlaps(df, df.limit(0)).count() == 0 and quadtree.overlaps(df.limit(0), df.limit(0)).count() == 0
    both = quadtree.overlaps(df.select("id", *quadtree.BOX), df.select("q", *quadtree.BOX))
    assert both.columns == ["id_a", "minx_a", "miny_a", "maxx_a", "maxy_a", "q_b", "minx_b", "miny_b", "maxx_b", "maxy_b", "shared"]


def test_exact_areas_of_slanted_rings(spark):
    from gridloom.operators import overlay

    point = "struct<x:double,y:double>"
    frame = lambda rows: spark.createDataFrame([(g, [(float(x), float(y)) for x, y in r] if r else None) for g, r in rows], f"group string, ring array<{point}>")
    diamond = lambda cx, cy, r: [(cx - r, cy), (cx, cy - r), (cx + r, cy), (cx, cy + r), (cx - r, cy)]
    # Two diamonds whose centres are d apart along x have a diamond of half-diagonal r - d / 2 in common.
    rows = [("a", diamond(0, 0, 7)), ("b", diamond(3, 0, 7)), ("b", diamond(3, 0, 7)), ("c", diamond(100, 0, 2)), ("c", diamond(100.5, 0.5, 2)), (None, diamond(0, 0, 7)), ("d", None), ("d", [(0, 0), (1, 1)]), ("d", [(0, 0), (1, 1), (2, 2), (0, 0)])]
    got = {(r.group_a, r.group_b): r.area for r in overlay.union_areas(frame(rows), 2.5).collect()}
    common = 2 * 5.5**2
    assert set(got) == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "a")}
    assert abs(got["a", "a"] - 98) < 1e-9 and abs(got["b", "b"] - 98) < 1e-9 and abs(got["a", "b"] - common) < 1e-9
    # In c, the second is the first moved by (0.5, 0.5): along one side, whose strips of 1 / sqrt(2) each are not in common.
    assert abs(got["c", "c"] - (8 + 0.5 * 2**0.5 * 8**0.5)) < 1e-9
    iou = {(r.group_a, r.group_b): r.iou for r in overlay.union_iou(frame(rows), 3.0).collect()}
    assert abs(iou["a", "b"] - common / (196 - common)) < 1e-9 and iou["a", "c"] == 0 and iou["c", "c"] == 1
    # A ring with a hole cut in by one path, a ring that crosses itself, and random triangles on one cell and on many.
    holed = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (1, 3), (3, 3), (3, 1), (1, 1), (0, 0)]
    bow = [(10, 0), (12, 2), (12, 0), (10, 2), (10, 0)]
    got = {r.group_a: r.area for r in overlay.union_areas(frame([("h", holed), ("x", bow)]), 1.5).where("group_a = group_b").collect()}
    assert abs(got["h"] - 12) < 1e-9 and abs(got["x"] - 2) < 1e-9
    rng = np.random.default_rng(32)
    tri = [(f"g{k % 3}", [*(p := [tuple(v) for v in rng.uniform(0, 10, (3, 2)).tolist()]), p[0]]) for k in range(24)]
    sizes = [{(r.group_a, r.group_b): r.area for r in overlay.union_areas(frame(tri), c).collect()} for c in (1.7, 50.0)]
    assert set(sizes[0]) == set(sizes[1]) and all(abs(sizes[0][k] - sizes[1][k]) < 1e-9 for k in sizes[0])
    x = rng.uniform(0, 10, (200_000, 2))

    def inside(ring):
        out = np.zeros(len(x), bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            out ^= ((ay > x[:, 1]) != (by > x[:, 1])) & (x[:, 0] < (bx - ax) * (x[:, 1] - ay) / (by - ay + (by == ay)) + ax)
        return out

    cover = {g: np.any([inside(r) for h, r in tri if h == g], axis=0) for g in ("g0", "g1", "g2")}
    assert all(abs(sizes[0][a, b] - 100 * np.mean(cover[a] & cover[b])) < 0.6 for a, b in sizes[0])
    assert overlay.union_areas(frame(rows).limit(0), 2.5).count() == 0


def test_metric_state_ends_and_late_rows_are_counted(spark, tmp_path):
    from gridloom.streaming import incremental

    schema = "job long, epoch int, rec double, uni double, ts timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    steps = lambda day, *jobs: spark.createDataFrame([(j, e, float(j + e), 1.0, day) for j in jobs for e in (1, 2) for _ in range(3)], "job long, epoch int, rec double, uni double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    days = ["2020-01-01", "2021-01-01", "2022-01-01", "2019-01-01"]
    kind = steps(days[0], 1).schema
    assert kind.simpleString().startswith("struct<job:bigint") and schema
    rows, dropped = [], 0
    for k, day in enumerate(days):
        # Each year has jobs of its own; job 1 goes on, and in the last file it is three years late.
        steps(day, 1, 10 + k).coalesce(1).write.mode("append").parquet(source)
        made = incremental.metrics_stream(spark, source, kind, out, state)
        for p in incremental.LAST_PROGRESS:
            for s in p["stateOperators"]:
                rows.append(s["numRowsTotal"])
                dropped += s["numRowsDroppedByWatermark"]
    # Four keys a year; those of earlier years fall when the watermark has passed them.
    assert max(rows) <= 8 and rows[-1] <= 4 and dropped > 0
    got = {(r.job, r.epoch): (r.rec, r.uni, round(r.total, 6), r.steps) for r in made.collect()}
    assert got[1, 1] == (2.0, 1.0, 2.1, 9) and got[11, 2] == (13.0, 1.0, 13.1, 3) and (13, 1) not in got
    late = {(r.job, r.epoch): r.late for r in incremental.late_steps(spark, source, kind, made).collect()}
    assert late == {(1, 1): 3, (1, 2): 3, (13, 1): 3, (13, 2): 3}
    left = {r.job: r.seconds_left for r in incremental.remaining_time(made, 5, 0.5).collect()}
    assert left[1] == 3 * 9 * 0.5 and left[12] == 3 * 3 * 0.5
    # A restart goes on with what is stored, and nothing is counted twice.
    again = incremental.metrics_stream(spark, source, kind, out, state)
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect()))


def test_collections_are_read_by_many_tasks(spark, tmp_path):
    from gridloom.sources import geojson

    odd = ['a}b{c', 'q"{[', "back\\", 'x\\"}', "line\nfeed", "日本}", ""]
    features = [
        {"type": "Feature", "properties": {"k": k, "name": odd[k % 7] * (k % 3), "more": {"deep": [{"type": "Feature"}, {"a": [1, {"b": "}"}]}]}}, "geometry": None if k % 11 == 0 else {"type": "Polygon", "coordinates": [[[k + j / 7, 0.5] for j in range(1 + k % 40)]]}}
        for k in range(400)
    ]
    body = {"type": "FeatureCollection", "name": "t{[", "bbox": [0, 1, [2]], "links": [{"href": "x"}], "features": features, "after": {"z": [1]}}
    one = tmp_path / "one.geojson"
    one.write_text(json.dumps(body, indent=1, ensure_ascii=False))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        made = geojson.feature_texts(spark, str(one))
        parts = spark.read.option("lineSep", "}").text(str(one)).rdd.getNumPartitions()
        texts = [json.loads(r.feature) for r in made.collect()]
        assert parts > 40
        assert sorted((x for x in texts if x.get("type") == "Feature"), key=lambda x: x["properties"]["k"]) == features
        assert [x for x in texts if x.get("type") != "Feature"] == [{"href": "x"}]
        table = C.read_geojson(spark, str(one))
        whole = spark.read.option("multiLine", True).json(str(one)).select(F.explode("features").alias("f")).select("f.properties.k", "f.properties.name", "f.geometry.type")
        assert values(table.orderBy("k"), "k", "name", "geometry_type") == [tuple(r) for r in whole.orderBy("k").collect()]
        # Several files, one of them cut in the middle of a feature, an empty one, and one without features.
        text = json.dumps(body, ensure_ascii=False)
        cut = text.index('"k": 300')
        (tmp_path / "cut.geojson").write_text(text[:cut])
        (tmp_path / "empty.geojson").write_text("")
        (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}')
        got = [json.loads(r.feature) for r in geojson.feature_texts(spark, str(tmp_path / "*.geojson")).collect()]
        ks = sorted(x["properties"]["k"] for x in got if x.get("type") == "Feature")
        assert ks == sorted([*range(400), *range(300)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert C.read_geojson(spark, str(tmp_path / "none.geojson")).count() == 0


def test_written_collections_are_bounded_and_compressed(spark, tmp_path, monkeypatch):
    from gridloom.sources import geojson

    texts = [json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 1]}, "properties": {"k": k, "name": "a}{" * 40}}) for k in range(47)]
    table = spark.createDataFrame([(x,) for x in texts], "feature string").coalesce(1)
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    geojson.write_collections(table, plain)
    geojson.write_collections(table, small, most=10)
    files = sorted((tmp_path / "small").glob("part*"))
    bodies = [json.loads(gzip.decompress(f.read_bytes())) for f in files]
    assert [len(b["features"]) for b in bodies] == [10, 10, 10, 10, 7] and len(list((tmp_path / "plain").glob("part*"))) == 1
    assert [json.dumps(f) for b in bodies for f in b["features"]] == texts
    size = sum(f.stat().st_size for f in (tmp_path / "plain").glob("part*"))
    assert sum(f.stat().st_size for f in files) * 4 < size
    # Full collections alone, and no rows at all.
    geojson.write_collections(table.limit(20), str(tmp_path / "full"), most=10)
    geojson.write_collections(table.limit(0), str(tmp_path / "none"), most=10)
    assert len(list((tmp_path / "full").glob("part*"))) == 2
    for path, n in ((plain, 47), (small, 47), (str(tmp_path / "full"), 20), (str(tmp_path / "none"), 0)):
        made = geojson.feature_texts(spark, path)
        assert sorted(json.loads(r.feature)["properties"]["k"] for r in made.collect()) == list(range(n))
    # Nothing was cut by splits, so the text isn't looked through for it.
    assert "Union" not in made._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(C, "scratch", lambda spark, name: str(tmp_path / name))
    assert C.read_geojson(spark, small).count() == 47
    assert {f.suffix for f in (tmp_path / "features").glob("part*")} == {".gz"}


def test_results_of_drifting_and_conflicting_shape(spark, tmp_path):
    runs = {"a": [{"method": "m", "seed": 1, "acc": 0.5}, 7, None], "b": {"method": "n", "acc": "0.25", "ok": True, "odd.name": "x", "it's": 1}, "c": [{"method": {"name": "o"}, "acc": [1, 2], "ok": "no"}]}
    for name, x in runs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=2))
    (tmp_path / "d.json").write_text("{broken")
    r = C.read_results(spark, str(tmp_path / "*.json"), {"method": "string", "acc": "double", "seed": "int"})
    assert sorted(values(r, "batch", "method", "acc", "seed"), key=str) == sorted([("a", "m", 0.5, 1), ("b", "n", 0.25, None), ("c", '{"name":"o"}', None, None)], key=str)
    r = C.read_results(spark, str(tmp_path / "*.json"))
    assert dict(r.dtypes) == {"batch": "string", "acc": "string", "it's": "double", "method": "string", "odd.name": "string", "ok": "string", "seed": "double", "record": "variant"}
    assert sorted(map(str, values(r, "acc"))) == ["0.25", "0.5", "[1,2]"]
    assert values(r.where("batch = 'b'"), "`odd.name`", "ok", "`it's`") == [("x", "true", 1.0)]


def _whole(scene: np.ndarray, to: tuple[int, int], method: str) -> np.ndarray:
    """A band resampled with the whole scene at hand."""
    out = np.zeros(to)
    (h, w), (th, tw) = scene.shape, to
    for i in range(th):
        for j in range(tw):
            if method == "nearest":
                out[i, j] = scene[int((i + 0.5) * h / th), int((j + 0.5) * w / tw)]
                continue
            y, x = min(h - 1, max(0, (i + 0.5) * h / th - 0.5)), min(w - 1, max(0, (j + 0.5) * w / tw - 0.5))
            a, b = int(y), int(x)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            out[i, j] = (1 - (y - a)) * ((1 - (x - b)) * scene[a, b] + (x - b) * scene[a, d]) + (y - a) * ((1 - (x - b)) * scene[c, b] + (x - b) * scene[c, d])
    return out


def _cut(scene: np.ndarray, size: int) -> list[tuple]:
    """(tile_row, tile_col, bands) of a scene of bands x rows x columns."""
    _, h, w = scene.shape
    parts = {(r, c): scene[:, r * size : (r + 1) * size, c * size : (c + 1) * size] for r in range(-(-h // size)) for c in range(-(-w // size))}
    return [(r, c, [b.ravel().tolist() for b in p]) for (r, c), p in parts.items()]


TILE = "scene string, tile_row int, tile_col int, bands array<array<double>>, height int, width int, to_height int, to_width int"


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
def test_tiles_are_resampled_as_their_whole_scenes(spark, method):
    rng = np.random.default_rng(7)
    # Sizes of the scene and of its destination: both smaller and larger, one tile only, last tiles of one row, very unlike scales.
    sizes = {"up": (10, 7, 23, 31), "down": (13, 17, 5, 4), "one": (3, 2, 7, 5), "thin": (9, 13, 9, 13), "far": (5, 6, 60, 1)}
    scenes = {k: rng.normal(size=(2, h, w)) for k, (h, w, _, _) in sizes.items()}
    rows = [(k, r, c, b, *sizes[k]) for k, s in scenes.items() for r, c, b in _cut(s, 4)]
    got = tiles.resample_tiles(spark.createDataFrame(rows, TILE), ["scene"], 4, "height", "width", 6, "to_height", "to_width", method)
    got = {(t["scene"], t["tile_row"], t["tile_col"]): t["bands"] for t in got.collect()}
    want = {(k, r, c): b for k, s in scenes.items() for r, c, b in _cut(np.stack([_whole(x, sizes[k][2:], method) for x in s]), 6)}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-12), k


def test_tiles_with_missing_neighbours_nulls_and_none(spark):
    scene = np.arange(64.0).reshape(1, 8, 8)
    rows = [("s", r, c, None if (r, c) == (1, 1) else b, 8, 8, 16, 16) for r, c, b in _cut(scene, 4) if (r, c) != (0, 1)]
    got = tiles.resample_tiles(spark.createDataFrame(rows, TILE), ["scene"], 4, 8, 8, 8, 16, 16, fill=-1.0).collect()
    got = {(t["tile_row"], t["tile_col"]): np.array(t["bands"][0]) for t in got}
    # The left half is there; to the right of it the border is repeated, and what the missing tiles would have made is fill.
    left = np.hstack([scene[0][:, :4]] + [scene[0][:, 3:4]] * 4)
    want = _whole(left, (16, 16), "bilinear")
    want[:, 9:] = -1  # pixels from x = 4 on belong to the missing tiles
    assert got.keys() == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for (r, c), b in got.items():
        assert np.allclose(b.reshape(8, 8), want[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8]), (r, c)
    assert tiles.resample_tiles(spark.createDataFrame([], TILE), ["scene"], 4, 8, 8, 4, 3, 3).count() == 0
    with pytest.raises(ValueError):
        tiles.resample_tiles(spark.createDataFrame(rows, TILE), ["scene"], 4, 8, 8, 4, 3, 3, "cubic")


def test_neighbours_on_the_hilbert_curve_are_neighbours_in_the_plane(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    at = {r["d"]: (r["x"], r["y"]) for r in cells.select("x", "y", layout.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(at) == list(range(256)) and at[0] == (0, 0)
    assert all(abs(at[k][0] - at[k + 1][0]) + abs(at[k][1] - at[k + 1][1]) == 1 for k in range(255))
    assert cells.select(layout.hilbert(F.lit(None).cast("int"), F.col("y")).alias("d")).where("d IS NOT NULL").count() == 0


def _scanned(df) -> int:
    """Rows that the file scans of a query gave, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_box_reads_touch_few_rows_of_the_layout(spark, tmp_path):
    n = 40_000
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) / 10
    # A third of all boxes lie at one place.
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select("id", F.when(hot, 2500.0).otherwise(at(1)).alias("minx"), F.when(hot, 2500.0).otherwise(at(2)).alias("miny"))
    df = df.select("id", "minx", "miny", (F.col("minx") + 5).alias("maxx"), (F.col("miny") + 5).alias("maxy"), F.lit("q").alias("quarter"))
    odd = spark.createDataFrame([(-1, None, 1.0, 2.0, 2.0, None)], "id long, minx double, miny double, maxx double, maxy double, quarter string")
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    whole = df.unionByName(odd)
    whole.write.parquet(plain)
    layout.write_spatial_index(whole, laid, files=8, row_group=64 << 10, page_rows=250)
    box = (7000.0, 7000.0, 7400.0, 7400.0)
    found, want = layout.read_box(spark, laid, box), layout.read_box(spark, plain, box)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want.collect()) and found.count() > 20
    assert _scanned(want) > n * 0.9
    assert _scanned(found) < n * 0.05
    # No file holds much more than its share, whatever lies at the hot place.
    sizes = sorted(r["n"] for r in spark.read.parquet(laid).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * n / 8
    folders = str(tmp_path / "folders")
    layout.write_spatial_index(whole, folders, ["quarter"])
    assert spark.read.parquet(folders).count() == n + 1 and layout.read_box(spark, folders, box).count() == found.count()
    layout.write_spatial_index(df.limit(0), str(tmp_path / "none"))
    assert layout.read_box(spark, str(tmp_path / "none"), box).count() == 0


def test_iou_matrix_has_a_row_and_a_column_for_each_quarter(spark):
    boxes = [("2025Q1", 0.0, 0.0, 2.0, 1.0), ("2025Q2", 1.0, 0.0, 3.0, 1.0), ("2024Q1", 0.0, 0.0, 9.0, 9.0)]
    m = G.quarter_iou(spark.createDataFrame(boxes, "quarter string, minx double, miny double, maxx double, maxy double"), 1.0)
    got = G.iou_matrix(m, prefix="2025").orderBy("quarter")
    assert got.columns == ["quarter", "2025Q1", "2025Q2"]
    assert values(got, "2025Q1", "2025Q2") == [(1.0, 1 / 3), (1 / 3, 1.0)]
    assert len(G.iou_matrix(m).collect()) == 3


def test_masks_of_one_place_are_drawn_once(spark):
    slanted = [(0.0, 3.0), (14.0, 0.0), (40.0, 22.0), (17.0, 37.0), (0.0, 3.0)]
    ways = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in slanted])], "way_id long, ring array<struct<x: double, y: double>>")
    boxes = [(0.0, 0.0, 32.0, 32.0), (32.0, 0.0, 64.0, 32.0), (500.0, 0.0, 532.0, 32.0), (None, 0.0, 1.0, 1.0)]
    patches = spark.createDataFrame([(f"p{k}", *boxes[k % 4]) for k in range(40)], "patch_path string, minx double, miny double, maxx double, maxy double")
    drawn = G.rasterize_places(ways, patches, 1.0, 32)
    each = G.rasterize(ways, patches, 1.0, 32)
    assert drawn.count() * 10 == each.count() > 0
    made = {r[0]: r[1:] for r in values(G.mask_summary(drawn, patches, 32, G.BOX), "patch_path", "positive", "share")}
    assert made == {r[0]: r[1:] for r in values(G.mask_summary(each, patches, 32), "patch_path", "positive", "share")} and len(made) == 40


def test_pair_summary_counts_days_instead_of_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", "s", f"q{k % 3}", None if k % 41 == 0 else f"2025-01-{1 + int(rng.integers(9)):02d}", float(x), 0.0, float(x) + 10, 10.0) for k, x in enumerate(rng.choice([0.0, 1.0, 30.0], 300))]
    p = spark.createDataFrame(rows, "patch_path string, scene_id string, quarter string, date string, minx double, miny double, maxx double, maxy double").withColumn("date", F.col("date").cast("date"))
    iou = spark.createDataFrame([("q0", "q2", 0.05), ("q0", "q1", 0.5)], "quarter_a string, quarter_b string, iou double")
    for more in ({}, {"quarter_iou": iou}):
        want = G.pair_summary(G.spatial_pair(p, 0.8, **more)).orderBy("quarter_a", "quarter_b").toPandas()
        made = G.spatial_pair_summary(p, 0.8, **more).orderBy("quarter_a", "quarter_b").toPandas()
        assert len(made) == (2 if more else 3) and made.columns.tolist() == want.columns.tolist()
        assert made.drop(columns="mean_iou").equals(want.drop(columns="mean_iou")) and np.allclose(made["mean_iou"], want["mean_iou"], rtol=1e-12)


def test_two_quarters_are_paired_by_sides(spark):
    """A side is one quarter, so no pair is asked for its quarters, and pairs are made in as many tasks as are asked for, however few bytes their patches have."""
    rng = np.random.default_rng(4)
    rows = [(f"p{k}", f"q{k % 4}", f"2025-01-{1 + int(rng.integers(9)):02d}", float(x), 0.0, float(x) + 10, 10.0) for k, x in enumerate(rng.choice([0.0, 1.0, 30.0], 120))]
    p = spark.createDataFrame(rows, "patch_path string, quarter string, date string, minx double, miny double, maxx double, maxy double").withColumn("date", F.col("date").cast("date"))
    every = G.spatial_pair(p, 0.8)
    for names in (["q3", "q1"], ["q1", "q3", "q1"]):
        some = G.spatial_pair(p, 0.8, names)
        assert some.columns == every.columns and some.dtypes == every.dtypes
        assert sorted(map(str, some.collect())) == sorted(map(str, every.where("quarter_a = 'q1' AND quarter_b = 'q3'").collect())) != []
    join = next(line for line in some._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "place" in line and "guest" in line)
    assert "quarter" not in join
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert every.rdd.getNumPartitions() == some.rdd.getNumPartitions() == int(tasks)
    assert G.spatial_pair(p, 0.8, ["q1"]).count() == 0


def test_equal_footprints_are_divided_once(spark):
    ring = [{"x": x, "y": y} for x, y in [(0.0, 0.0), (4.0, 0.0), (5.0, 4.0), (1.0, 4.0), (0.0, 0.0)]]
    s = spark.createDataFrame([("a", 0.0, 0.0, 4.0, 4.0, ring)] * 50 + [("b", 1.0, 0.0, 3.0, 2.0, ring)], "quarter string, minx double, miny double, maxx double, maxy double, ring array<struct<x: double, y: double>>")
    for of in (None, "ring"):
        cover = G.cell_cover(s, 1.0, ["quarter"], of)
        assert cover.count() == len(set(cover.collect()))
        plan = cover._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("Aggregate") > plan.rindex("Generate")


@pytest.mark.parametrize("block", [7, 2048])
def test_scores_made_at_places_equal_those_of_joined_pairs(spark, block):
    rng = np.random.default_rng(11)
    place = lambda k: (float(k % 3), 0.0, float(k % 3) + 10, 10.0)
    rows = [(f"p{k:02d}", "ab"[k % 2], *place(int(rng.integers(3))), int(rng.integers(12))) for k in range(60)]
    p = spark.createDataFrame(rows, "patch_path string, quarter string, minx double, miny double, maxx double, maxy double, vec_id long")
    bands = [[rng.integers(0, 255, 16).tolist() for _ in range(4)] for _ in range(12)]
    bands[3][1][2] = None
    bands[5] = [b[:9] for b in bands[5]]
    arrays = spark.createDataFrame(list(enumerate(bands)), "vec_id long, bands array<array<int>>")
    near = G.near_places(p, 0.8)
    a, b = (p.where(F.col("quarter") == q).join(arrays, "vec_id").drop("quarter") for q in "ab")
    pairs = G.spatial_pair(p.withColumns({"scene_id": F.lit("s"), "date": F.lit("2025-01-01").cast("date")}), 0.8)
    v = p.select("patch_path", "vec_id")
    linked = pairs.join(v.toDF("patch_path_a", "vec_id_a"), "patch_path_a").join(v.toDF("patch_path_b", "vec_id_b"), "patch_path_b")
    rgb = {r[:2]: r[2] for r in values(change.change_scores(linked, arrays, rx=False), "patch_path_a", "patch_path_b", "mean_rgb_diff")}
    made = {r[:2]: r[2] for r in values(change.place_scores(near, a, b, rx=False, block=block), "patch_path_a", "patch_path_b", "mean_rgb_diff")}
    assert made.keys() == rgb.keys() and len(rgb) == linked.count() and any(x is None for x in rgb.values())
    assert all((x is None) == (rgb[k] is None) and (x is None or abs(x - rgb[k]) < 1e-12) for k, x in made.items())
    whole = ~F.col("vec_id").isin(3, 5)
    cols = ("patch_path_a", "patch_path_b", "mean_pca_score", "max_pca_score")
    want = {r[:2]: r[2:] for r in values(change.change_scores(linked.where("vec_id_a not in (3, 5) and vec_id_b not in (3, 5)"), arrays), *cols)}
    made = {r[:2]: r[2:] for r in values(change.place_scores(near, a.where(whole), b.where(whole), block=block), *cols)}
    assert made.keys() == want.keys() and all(np.allclose(made[k], want[k], atol=1e-9) for k in want)
    # The largest of each task hold the largest of all; ties by paths.
    order = lambda scores: sorted(((-np.floor((d or 0.0) * 1e6 + 0.5), *k) for k, d in scores.items()))
    top = {r[:2]: r[2] for r in values(change.place_scores(near, a, b, rx=False, top=5, block=block), "patch_path_a", "patch_path_b", "mean_rgb_diff")}
    assert order(top)[:5] == order(rgb)[:5] and len(top) < len(rgb)


@pytest.mark.parametrize("slots", [2048, 4, 1])
def test_scores_by_groups_of_arrays_equal_those_of_joined_arrays(spark, slots, monkeypatch):
    """Pixels aren't moved with patches where arrays are few (2048: one group; 4: three groups); 1: more arrays than groups hold, which are joined."""
    rng = np.random.default_rng(12)
    place = lambda k: (float(k % 3), 0.0, float(k % 3) + 10, 10.0)
    rows = [(f"p{k:02d}", "ab"[k % 2], *place(int(rng.integers(3))), None if k == 9 else int(rng.integers(14))) for k in range(80)]
    p = spark.createDataFrame(rows, "patch_path string, quarter string, minx double, miny double, maxx double, maxy double, vec_id long")
    bands = [[rng.integers(0, 255, 16).tolist() for _ in range(4)] for _ in range(12)]
    bands[3][1][2], bands[5], bands[7] = None, [b[:9] for b in bands[5]], None
    arrays = spark.createDataFrame(list(enumerate(bands)), "vec_id long, bands array<array<int>>")  # 12 and 13 have none
    near = G.near_places(p, 0.8)
    monkeypatch.setattr(change, "SLOTS", slots)
    a, b = (p.where(F.col("quarter") == q).drop("quarter") for q in "ab")
    found = change.place_scores(near, a, b, block=3, arrays=arrays, bounds=slots < 2048)
    assert ("task" in found._jdf.queryExecution().analyzed().toString()) == (slots > 1)
    want = change.place_scores(near, *(x.join(arrays, "vec_id") for x in (a, b))).select(*found.columns)
    order = lambda df: sorted(map(str, df.select(*(F.round(c, 9) if c.startswith("m") else c for c in df.columns)).collect()))
    assert order(found) == order(want) and ("maxy_a" in found.columns) == (slots < 2048)


def test_linked_patches_of_two_quarters_move_no_other_scenes(spark, tmp_path):
    """Their patches and arrays are those of the whole tables, also where a scene_key has orders of several quarters."""
    small = "/root/testdata/sf0.001"
    for name in ("lineitem", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet")
    again = orders.where("o_orderkey % 3 = 0").withColumn("o_orderdate", F.lit("1998-02-03").cast(orders.schema["o_orderdate"].dataType))
    orders.unionByName(again).write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    some = t.of_quarters("1998Q1", "1998Q2")
    linked = lambda x: sorted(map(str, x["fx_patches"].where("quarter IN ('1998Q1', '1998Q2')").join(x["fx_patch_vec"], "patch_path").select("quarter", "patch_path", "minx", "maxy", "vec_id").collect()))
    assert linked(some) == linked(t) and some["fx_patches"].count() < t["fx_patches"].count()
    assert len(set(linked(t))) < len(linked(t))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan(t["fx_patch_vec"]) and "l_orderkey" not in plan(some["fx_patch_vec"].join(some["fx_patches"], "patch_path"))
    assert "l_orderkey" not in plan(plan_change.linked_scores(t, "1998Q1", "1998Q2", 0.8, rx=False))


def test_a_pair_of_arrays_is_scored_once(monkeypatch):
    """However many patches of however many places have them: the RX map of a pair is the dear part."""
    pixels = [list(range(48)), list(range(100, 148)), [float(k * k) for k in range(48)]]
    arrays = pa.table({"is_a": [True] * 3 + [False] * 3, "vec_id": [0, 1, 2] * 2, "pixels": pa.array(pixels * 2, pa.list_(pa.float64()))})
    block = pa.table({"is_a": [True] * 20 + [False] * 10, "vec_id": [k % 2 for k in range(20)] + [1 + k % 2 for k in range(10)]})
    known, scored = change._Known(arrays, True), []
    made_of = change._stack_scores
    monkeypatch.setattr(change, "_stack_scores", lambda x, y, rx: scored.append(len(x)) or made_of(x, y, rx))
    for blocks in ([block, block], [block]):
        rows = [(i, j) for found in known.pairs(blocks) for i, j in zip(found[0].tolist(), found[1].tolist(), strict=True)]
        assert sorted(rows) == sorted((30 * n + i, 30 * n + j) for n in range(len(blocks)) for i in range(20) for j in range(20, 30))
    assert sum(scored) == 4


def test_many_points_are_moved_a_bounded_number_of_times(spark):
    points = spark.range(500).withColumnRenamed("id", "k")
    assert embeddings._met_blocks(points, "k", [], 300_000).count() == 500 * embeddings.BLOCKS
    assert embeddings._met_blocks(points, "k", [], 2_500).count() == 500 * 3
