"""Exact areas of unions and intersections of footprints by slab decomposition.

Rings are clipped to the cells of a grid. In a cell, the edges are cut at the heights of all vertices and crossings, so that in a slab
between two heights no two edges cross; a sweep from west to east counts, for every group, the rings that cover each trapezoid between
neighbouring edges. A group covers what at least one of its rings covers. Areas are sums of trapezoids: nothing is approximated by cells.
Rings that cover a cell whole stand for their group at once, and equal rings of a group are one, so dense places cost what differs in them.

A ring is closed, its inside is by even-odd parity (a ring may cross itself); rings of under three points, or without area, cover nothing.
Rows with a null ring or group are left out. An empty table gives an empty matrix, and null sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits of a cell's size within which heights are one.
_SAME = 1e-12
#: Pairs of edges that are tried for crossings at once.
_PAIRS = 1 << 20


def clipped(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring (points, closed or not) cut to a box, side by side; parts of it may run along the box's sides."""
    out = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if len(out) < 3:
            return out[:0]
        inner = sign * (out[:, axis] - bound) >= 0
        if inner.all():
            continue
        after, in_after = np.roll(out, -1, axis=0), np.roll(inner, -1)
        cross = inner != in_after
        d = after[:, axis] - out[:, axis]
        t = np.where(cross, (bound - out[:, axis]) / np.where(cross, d, 1.0), 0.0)
        at = out + t[:, None] * (after - out)
        at[:, axis] = bound
        both = np.stack([out, at], axis=1)
        out = both.reshape(-1, 2)[np.stack([inner, cross], axis=1).ravel()]
    return out


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges (x, y, x, y; y ascending) cross inside both."""
    found = [np.zeros(0)]
    some = max(1, _PAIRS // max(1, len(e)))
    d = e[:, 2:] - e[:, :2]
    for k in range(0, len(e), some):
        p, u = e[k : k + some, None, :2], d[k : k + some, None]
        q, v = e[None, :, :2], d[None]
        den = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        w = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / den, (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / den
            hit = (den != 0) & (t > 0) & (t < 1) & (s >= 0) & (s <= 1)
            found.append((p[..., 1] + t * u[..., 1])[hit])
    return np.concatenate(found)


def common_areas(rings: list[np.ndarray], groups: np.ndarray, n_groups: int, size: float) -> np.ndarray:
    """Matrix of the areas that two groups' unions have in common (of each union on the diagonal). rings: points, not closed."""
    out = np.zeros((n_groups, n_groups))
    heads = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    sloped = a[:, 1] != b[:, 1]
    a, b, heads = a[sloped], b[sloped], heads[sloped]
    up = a[:, 1] < b[:, 1]
    e = np.where(up[:, None], np.concatenate([a, b], axis=1), np.concatenate([b, a], axis=1))
    heights = np.unique(np.concatenate([e[:, 1], e[:, 3], _crossings(np.unique(e, axis=0))]))
    if len(heights) < 2:
        return out
    heights = heights[np.append(True, np.diff(heights) > _SAME * size)]
    for low, high in zip(heights, heights[1:], strict=False):
        middle = (low + high) / 2
        live = (e[:, 1] < middle) & (e[:, 3] > middle)
        k, owner = e[live], heads[live]
        slope = (k[:, 2] - k[:, 0]) / (k[:, 3] - k[:, 1])
        at = [k[:, 0] + slope * (y - k[:, 1]) for y in (low, middle, high)]
        order = np.argsort(at[1], kind="stable")
        owner, xs = owner[order], [x[order] for x in at]
        # A ring's edges enter and leave it in turn.
        by = np.argsort(owner, kind="stable")
        first = np.append(True, owner[by][1:] != owner[by][:-1])
        rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        step = np.empty(len(by), np.int64)
        step[by] = 1 - 2 * (rank % 2)
        sides = np.zeros((len(by), n_groups), np.int64)
        sides[np.arange(len(by)), groups[owner]] = step
        covered = (np.cumsum(sides, axis=0) > 0)[:-1].astype(float)
        width = (np.diff(xs[0]) + np.diff(xs[2])) / 2
        out += covered.T @ (covered * (width * (high - low))[:, None])
    return out


_PART = "group_a string, group_b string, area double"


def union_areas(df: DataFrame, cell: float, ring: str = "ring", group: str = "group") -> DataFrame:
    """(group_a, group_b, area): the area that the unions of two groups' rings have in common, both ways, and of each union with itself; no row
    where it is 0. ring: array of structs x, y."""
    p = F.transform(ring, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    rows = df.select(F.col(group).cast("string").alias("g"), p.alias("r")).where("g is not null and size(r) >= 3").distinct()
    span = lambda axis: F.sequence(F.floor(F.array_min(F.transform("r", lambda v: v[axis])) / cell), F.greatest(F.ceil(F.array_max(F.transform("r", lambda v: v[axis])) / cell) - 1, F.floor(F.array_min(F.transform("r", lambda v: v[axis])) / cell)))
    placed = rows.withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            whole: list[bool] = []
            for row in range(batch.num_rows):
                gx, gy = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                flat = batch.column(1)[row].values.flatten()
                x0, y0 = gx * cell, gy * cell
                made = clipped(np.stack([f.to_numpy() for f in flat], axis=1), x0, y0, (gx + 1) * cell, (gy + 1) * cell) - (x0, y0)
                corners = len(made) == 4 and set(map(tuple, made.tolist())) == {(0.0, 0.0), (cell, 0.0), (0.0, cell), (cell, cell)}
                whole.append(corners)
                area = abs(float(np.sum(made[:, 0] * np.roll(made[:, 1], -1) - np.roll(made[:, 0], -1) * made[:, 1]))) if len(made) > 2 else 0.0
                # A ring that crosses itself may have no signed area.
                flatly = len(made) < 3 or area == 0 and bool(np.ptp(made, axis=0).min() == 0)
                out.append(None if flatly else np.ascontiguousarray(made).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(0), pa.array(whole, pa.bool_()), pa.array(out, pa.binary())], names=["gx", "gy", "g", "whole", "part"])

    parts = placed.select("g", "r", "gx", "gy").mapInArrow(cut, "gx long, gy long, g string, whole boolean, part binary").where("part is not null").distinct()
    # One row stands for a group that covers the cell whole.
    full = parts.where("whole").select("gx", "gy", "g").distinct()
    rest = parts.where("not whole").join(full.hint("merge"), ["gx", "gy", "g"], "left_anti")
    box = np.array([(0, 0), (cell, 0), (cell, cell), (0, cell)], float).tobytes()
    cells = rest.select("gx", "gy", "g", "part").unionByName(full.withColumn("part", F.lit(bytearray(box)))).repartition("gx", "gy").sortWithinPartitions("gx", "gy")

    def measured(names: list[str], rings_: list[bytes]) -> Iterator[tuple[str, str, float]]:
        kinds = sorted(set(names))
        number = {g: k for k, g in enumerate(kinds)}
        area = common_areas([np.frombuffer(r, float).reshape(-1, 2) for r in rings_], np.array([number[g] for g in names]), len(kinds), cell)
        for i, j in zip(*np.nonzero(area > 0), strict=True):
            yield kinds[i], kinds[j], float(area[i, j])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], float] = {}
        last, names, held = None, [], []

        def done() -> None:
            for a, b, x in measured(names, held):
                total[a, b] = total.get((a, b), 0.0) + x

        for batch in batches:
            for gx, gy, g, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (gx, gy) != last:
                    if held:
                        done()
                    last, names, held = (gx, gy), [], []
                names.append(g)
                held.append(part)
        if held:
            done()
        a, b, x = zip(*((*k, v) for k, v in total.items()), strict=True) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(x, pa.float64())], names=["group_a", "group_b", "area"])

    return cells.mapInArrow(sums, _PART).groupBy("group_a", "group_b").agg(F.sum("area").alias("area"))


def union_iou(df: DataFrame, cell: float, ring: str = "ring", group: str = "group") -> DataFrame:
    """(group_a, group_b, iou) of every two groups' unions, both ways and with themselves; 0 where they have nothing in common."""
    areas = union_areas(df, cell, ring, group)
    own = areas.where("group_a = group_b")
    # A row for each group, and for each two groups: the result itself.
    every = own.select("group_a", F.col("area").alias("a")).crossJoin(own.select(F.col("group_a").alias("group_b"), F.col("area").alias("b")))
    i = F.coalesce("area", F.lit(0.0))
    return every.join(areas, ["group_a", "group_b"], "left").select("group_a", "group_b", (i / (F.col("a") + F.col("b") - i)).alias("iou"))
