"""Boxes, grids and rings as tables: covers, overlap joins by grid keys, areas, rasterisation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored
from .quadtree import overlaps
from .ranges import percentiles

BOX = ["minx", "miny", "maxx", "maxy"]


def snapped(step: float) -> dict[str, Column]:
    """A box's bounds moved outwards to multiples of the step."""
    return {c: (F.floor if c.startswith("min") else F.ceil)(F.col(c) / step).cast("double") * step for c in BOX}


def snap_bounds(df: DataFrame, step: float) -> DataFrame:
    """The extent of all boxes, snapped outwards; one row."""
    extent = df.agg(*(F.min(c).alias(c) for c in BOX[:2]), *(F.max(c).alias(c) for c in BOX[2:]))
    return extent.select(*(v.alias(k) for k, v in snapped(step).items()))


def tile_bbox(df: DataFrame, step: float) -> DataFrame:
    """Each box cut into cells of `step` from its lower corner, the last ones clipped; adds tile_x, tile_y."""
    count = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.ceil(F.round((F.col(hi) - F.col(lo)) / step, 9)).cast("int") - 1, F.lit(0)))
    cells = df.withColumn("tile_x", F.explode(count("minx", "maxx"))).withColumn("tile_y", F.explode(count("miny", "maxy")))
    return cells.withColumns({
        "maxx": F.least("maxx", F.col("minx") + (F.col("tile_x") + 1) * step), "maxy": F.least("maxy", F.col("miny") + (F.col("tile_y") + 1) * step),
        "minx": F.col("minx") + F.col("tile_x") * step, "miny": F.col("miny") + F.col("tile_y") * step,
    })


def tile_windows(scenes: DataFrame, patch: int, stride: int | None = None, height: str = "height", width: str = "width") -> DataFrame:
    """(…, row, col) of all whole windows of a raster; none where it is smaller than one."""
    step = stride or patch
    origins = lambda size: F.when(F.col(size) >= patch, F.sequence(F.lit(0), (F.col(size) - patch).cast("int"), F.lit(step)))
    return scenes.withColumn("row", F.explode(origins(height))).withColumn("col", F.explode(origins(width)))


def patch_bbox(minx: str, maxy: str, gsd: float, patch: int) -> dict[str, Column]:
    """Bounds of the window at (row, col) of a raster whose upper left corner is (minx, maxy)."""
    left, top = F.col(minx) + F.col("col") * gsd, F.col(maxy) - F.col("row") * gsd
    return {"minx": left, "miny": top - patch * gsd, "maxx": left + patch * gsd, "maxy": top}


def area_bounds(areas: DataFrame, keys: list[str], wanted: DataFrame, default: tuple[float, float, float, float]) -> DataFrame:
    """The extent of each wanted key's areas, a default box where there is none."""
    extent = areas.groupBy(*keys).agg(*(F.min(c).alias(c) for c in BOX[:2]), *(F.max(c).alias(c) for c in BOX[2:]))
    out = wanted.join(extent, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(float(d))) for c, d in zip(BOX, default, strict=True)})


def grid_keys(df: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a box meets with area: gx, gy."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.greatest(F.ceil(F.col(hi) / cell) - 1, F.floor(F.col(lo) / cell)))
    return df.withColumn("gx", F.explode(span("minx", "maxx"))).withColumn("gy", F.explode(span("miny", "maxy")))


def overlap_join(a: DataFrame, b: DataFrame, cell: float, also: Column | None = None) -> DataFrame:
    """Pairs of boxes that share area; a's columns end in _a, b's in _b.

    Both sides go to the grid cells they meet and join on the cell, which the planner can hash, split and spill. A pair
    is made once: in the cell with the lower corner of its intersection.
    """
    left = grid_keys(a, cell).withColumnsRenamed({c: f"{c}_a" for c in a.columns})
    right = grid_keys(b, cell).withColumnsRenamed({c: f"{c}_b" for c in b.columns})
    x0, y0 = F.greatest("minx_a", "minx_b"), F.greatest("miny_a", "miny_b")
    x1, y1 = F.least("maxx_a", "maxx_b"), F.least("maxy_a", "maxy_b")
    own = (F.floor(x0 / cell) == F.col("gx")) & (F.floor(y0 / cell) == F.col("gy"))
    pairs = left.join(right, ["gx", "gy"]).where((x1 > x0) & (y1 > y0) & own)
    if also is not None:
        pairs = pairs.where(also)
    return pairs.withColumn("shared", (x1 - x0) * (y1 - y0)).drop("gx", "gy")


def spatial_pair(patches: DataFrame, min_iou: float = 0.8, quarters: list[str] | None = None, quarter_iou: DataFrame | None = None, min_quarter_iou: float = 0.1) -> DataFrame:
    """Patches of different quarters at the same place: IoU (from min_iou on), shares, days from a to b; scene_id too where the table has it. By quadtree.overlaps().

    quarter_iou (quarter_a, quarter_b, iou), a row for each pair of quarters, prunes pairs of quarters; a pair that isn't in it is kept.
    """
    keep = [c for c in ("patch_path", "scene_id", "quarter", "date") if c != "scene_id" or c in patches.columns]
    # Rows are few beside their pairs, and the planner would put tasks together by the rows' bytes.
    return _paired(patches, keep, min_iou, quarters, quarter_iou, min_quarter_iou, int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_places(patches: DataFrame, min_iou: float) -> DataFrame:
    """Pairs of distinct boxes with an IoU from min_iou on, both ways and with themselves: minx_a, ..., maxy_b, shared; place_a and place_b number them, n_a and n_b count their patches."""
    # Stored: the tree's sample and both sides read the boxes again, and to find them is a pass over all patches.
    path = scratch(patches.sparkSession, "places")
    patches.groupBy(BOX).agg(F.count("*").alias("n")).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    places = patches.sparkSession.read.parquet(path)
    return overlaps(places, places, min_iou)


def _paired(p: DataFrame, keep: list[str], min_iou: float, quarters: list[str] | None, quarter_iou: DataFrame | None, min_quarter_iou: float, tasks: int | None = None) -> DataFrame:
    """Rows of a table of boxes, quarters and dates at the same place in different quarters: the kept columns of both sides, and what spatial_pair() adds. tasks: of the join; by default, as the planner sees fit."""
    p = p.select(*keep, *BOX)
    if quarters:
        p = p.where(F.col("quarter").isin(quarters))
    # Stored, as places and pairs both read them and what makes them may shuffle more than they take.
    p = stored(p, "patches", compression="zstd")
    # Patches of a common grid have one box in many quarters: places meet once, and their patches are joined to the pairs of places. These are
    # stored, so the planner knows how few they are. A patch then moves to its own place, where it is no guest, and of two near places the one with
    # fewer patches sends them to the other as guests. Both sides of the join are these rows, by equal plans, so they are shuffled once.
    area = lambda s: (F.col(f"maxx_{s}") - F.col(f"minx_{s}")) * (F.col(f"maxy_{s}") - F.col(f"miny_{s}"))
    near = near_places(p, min_iou).where(F.col("shared") / (area("a") + area("b") - F.col("shared")) >= min_iou)
    near = stored(near.select(*(F.col(f"{c}_a").alias(c) for c in BOX), "place_a", "place_b", "n_a", "n_b", area("a").alias("size"), "shared"), "near")
    own = near.groupBy(*BOX, F.col("place_a").alias("place"), "size").agg(F.max(F.when(F.col("place_a") == F.col("place_b"), F.col("shared"))).alias("shared"))
    sent = near.where(F.struct("n_a", "place_a") < F.struct("n_b", "place_b")).withColumnRenamed("place_b", "place")
    goes = own.withColumn("guest", F.lit(False)).unionByName(sent.select(*own.columns, F.lit(True).alias("guest")))
    rows = p.join(goes, BOX).select(*keep, "place", "size", "shared", "guest")
    rows = rows.repartition(tasks, "place") if tasks else rows
    a, b = (rows.withColumnsRenamed({c: f"{c}_{s}" for c in rows.columns}) for s in "ab")
    if quarters and len(set(quarters)) == 2:
        # Each side has one quarter: a row is moved once as well, meets none of its own or an earlier quarter, and nothing is asked of a pair's quarters.
        a, b = (df.where(F.col(f"quarter_{s}") == q).withColumn(f"quarter_{s}", F.lit(q)) for s, df, q in (("a", a, min(quarters)), ("b", b, max(quarters))))
    # Guests of one place don't meet there; two of its own do if the place is near itself.
    shared = F.when(F.col("guest_a"), F.col("shared_a")).otherwise(F.col("shared_b"))
    meet = (F.col("place_a") == F.col("place_b")) & (F.col("quarter_a") < F.col("quarter_b")) & ~(F.col("guest_a") & F.col("guest_b")) & shared.isNotNull()
    pairs = a.join(b, meet)
    if quarter_iou is not None:
        # A row for each pair of quarters that aren't matched, looked at where a pair is made.
        pairs = pairs.join(stored(quarter_iou.where(F.col("iou") < min_quarter_iou).select("quarter_a", "quarter_b"), "pruned"), ["quarter_a", "quarter_b"], "left_anti")
    values = [(shared / (F.col("size_a") + F.col("size_b") - shared)).alias("iou"), (shared / F.col("size_a")).alias("share_a"), (shared / F.col("size_b")).alias("share_b")]
    return pairs.select(*(f"{c}_{s}" for c in keep for s in "ab"), F.date_diff("date_b", "date_a").alias("days_gap"), *values)


def spatial_pair_summary(patches: DataFrame, min_iou: float = 0.8, quarters: list[str] | None = None, quarter_iou: DataFrame | None = None, min_quarter_iou: float = 0.1) -> DataFrame:
    """pair_summary() of spatial_pair(), every pair counted, without making it: patches of one place and day are one row with their number, and pairs of
    such rows stand for the products of their numbers. So it grows with places times days squared, whatever the number of patches."""
    days = patches.groupBy("quarter", "date", *BOX).agg(F.count("*").alias("n"))
    pairs = _paired(days, ["quarter", "date", "n"], min_iou, quarters, quarter_iou, min_quarter_iou)
    n = F.col("n_a") * F.col("n_b")
    gaps = pairs.groupBy("quarter_a", "quarter_b", "days_gap").agg(F.sum(n).alias("n"), F.sum(n * F.col("iou")).alias("iou"))
    gap, known = F.col("days_gap"), F.sum(F.when(F.col("days_gap").isNotNull(), F.col("n")))
    return gaps.groupBy("quarter_a", "quarter_b").agg(
        F.sum("n").alias("n_pairs"), (F.sum("iou") / F.sum("n")).alias("mean_iou"), (F.sum(gap * F.col("n")) / known).alias("mean_gap"),
        F.percentile(gap, 0.5, F.col("n")).alias("median_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"),
    )


def pair_summary(pairs: DataFrame) -> DataFrame:
    gap = F.col("days_gap")
    return pairs.groupBy("quarter_a", "quarter_b").agg(F.count("*").alias("n_pairs"), F.avg("iou").alias("mean_iou"), F.avg(gap).alias("mean_gap"), F.percentile(gap, 0.5).alias("median_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"))


def reoriented(pairs: DataFrame, qa: str, qb: str) -> DataFrame:
    """Pairs between two quarters with side a in qa: sides are swapped where needed, shares too, and the gap changes sign."""
    swap = F.col("quarter_a") == qb
    out = pairs.where((F.col("quarter_a").isin(qa, qb)) & (F.col("quarter_b").isin(qa, qb)) & (F.col("quarter_a") != F.col("quarter_b")))
    sides = [c[:-2] for c in pairs.columns if c.endswith("_a")]
    new = {f"{c}_{s}": F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")) for c in sides for s, o in ("ab", "ba")}
    return out.select(*(new.get(c, F.when(swap, -F.col(c)).otherwise(F.col(c)) if c == "days_gap" else F.col(c)).alias(c) for c in pairs.columns))


def cell_cover(df: DataFrame, cell: float, by: list[str], ring: str | None = None) -> DataFrame:
    """Distinct cells that the footprints of each group cover: those their boxes meet or, with a ring column, those whose centre is in the ring."""
    # Equal footprints cover equal cells: each is divided once.
    if ring is not None:
        return ring_cells(df.select(*by, ring).distinct(), cell, ring).select(*by, "gx", "gy").distinct()
    return grid_keys(df.select(*by, *BOX).distinct(), cell).select(*by, "gx", "gy").distinct()


def ring_cells(df: DataFrame, cell: float, ring: str) -> DataFrame:
    """A row for each grid cell whose centre is in a row's closed ring: gx, gy. A row of cells at a time: between every two crossings of its middle line."""
    ys = F.transform(ring, lambda p: p["y"])
    low, high = F.ceil(F.array_min(ys) / cell - 0.5), F.ceil(F.array_max(ys) / cell - 0.5) - 1
    rows = df.withColumn("gy", F.explode(F.when(high >= low, F.sequence(low, high))))
    spans = inside_spans(edges(F.col(ring)), (F.col("gy") + 0.5) * cell)
    runs = F.transform(spans, lambda s: F.struct(F.ceil(s["a"] / cell - 0.5).alias("a"), (F.ceil(s["b"] / cell - 0.5) - 1).alias("b")))
    cells = F.transform(F.filter(runs, lambda s: s["b"] >= s["a"]), lambda s: F.sequence(s["a"], s["b"]))
    return rows.withColumn("gx", F.explode(F.flatten(cells)))


def inside_spans(e: Column, y: Column) -> Column:
    """array<struct<a, b>>: the stretches a <= x < b of the line at y that are inside a ring, given its edges: between each two crossings."""
    cut = F.filter(e, lambda k: (k["ay"] > y) != (k["by"] > y))
    at = F.array_sort(F.transform(cut, lambda k: (k["bx"] - k["ax"]) * (y - k["ay"]) / (k["by"] - k["ay"]) + k["ax"]))
    pairs = F.filter(F.transform(at, lambda x, k: F.struct(x.alias("a"), F.try_element_at(at, k + 2).alias("b"), k.alias("k"))), lambda s: s["k"] % 2 == 0)
    return F.transform(pairs, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def quarter_iou(scenes: DataFrame, cell: float, ring: str | None = None) -> DataFrame:
    """IoU of every two quarters' covered cells, both ways and with themselves: exact for boxes on the grid; with rings off by their edges' cells at most."""
    cover = cell_cover(scenes, cell, ["quarter"], ring)
    sizes = cover.groupBy("quarter").agg(F.count("*").alias("n"))
    a, b = cover.withColumnRenamed("quarter", "quarter_a"), cover.withColumnRenamed("quarter", "quarter_b")
    both = a.join(b, ["gx", "gy"]).groupBy("quarter_a", "quarter_b").agg(F.count("*").alias("i"))
    every = sizes.select(F.col("quarter").alias("quarter_a"), F.col("n").alias("na")).crossJoin(sizes.select(F.col("quarter").alias("quarter_b"), F.col("n").alias("nb")))
    i = F.coalesce("i", F.lit(0))
    return every.join(both, ["quarter_a", "quarter_b"], "left").select("quarter_a", "quarter_b", (i / (F.col("na") + F.col("nb") - i)).alias("iou"))


def union_area(df: DataFrame, cell: float, ring: str | None = None) -> DataFrame:
    """Covered area, extent and its centre; one row."""
    extent = df.agg(*(F.min(c).alias(c) for c in BOX[:2]), *(F.max(c).alias(c) for c in BOX[2:]))
    area = cell_cover(df, cell, [], ring).agg((F.count("*") * cell * cell).alias("area"))
    return area.crossJoin(extent).withColumns({"centre_x": (F.col("minx") + F.col("maxx")) / 2, "centre_y": (F.col("miny") + F.col("maxy")) / 2})


def iou_pairs(matrix: DataFrame, more_than: float = 0.1, prefix: str = "") -> DataFrame:
    """The upper triangle above a limit, largest first."""
    out = matrix.where((F.col("quarter_a") < F.col("quarter_b")) & (F.col("iou") > more_than) & F.col("quarter_a").startswith(prefix) & F.col("quarter_b").startswith(prefix))
    return out.orderBy(F.desc("iou"), "quarter_a", "quarter_b")


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, ring) from ways (way_id, nodes array) and nodes (node_id, lon, lat): missing nodes are left out, rings closed, those of under three points dropped."""
    refs = ways.select("way_id", F.posexplode("nodes").alias("seq", "node_id"))
    found = refs.join(nodes, "node_id").select("way_id", "seq", "lon", "lat")
    return rings(found)


def rings(vertices: DataFrame) -> DataFrame:
    """(way_id, ring) from vertex rows (way_id, seq, lon, lat)."""
    points = vertices.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("ring"))
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    return points.where(F.size("ring") >= 3).withColumn("ring", closed)


def edges(ring: Column) -> Column:
    """array<struct<ax, ay, bx, by>> of a closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def ring_area(ring: Column) -> Column:
    """Shoelace area, around the ring's first point to keep digits."""
    x0, y0 = F.element_at(ring, 1)["x"], F.element_at(ring, 1)["y"]
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda a, e: a + (e["ax"] - x0) * (e["by"] - y0) - (e["bx"] - x0) * (e["ay"] - y0))) / 2


def dedup_rings(df: DataFrame) -> DataFrame:
    """Identical geometries once: the one with the least way_id."""
    return df.groupBy("ring").agg(F.min("way_id").alias("way_id")).select("way_id", "ring")


def footprint_stats(df: DataFrame, area: str = "area") -> DataFrame:
    """Number, total, median, 95th percentile and largest of areas; one row. The percentiles are picked by rank from ranges, so no task holds all areas."""
    sums = df.agg(F.count("*").alias("n"), F.sum(area).alias("total"), F.max(area).alias("largest"))
    return sums.crossJoin(percentiles(df, area, {"median": 0.5, "p95": 0.95}))


def _shift(name: str, word: Column, by: Column) -> Column:
    return F.call_function(name, word, by.cast("int"))


def _stretch(a: Column, b: Column, word: int) -> Column:
    """The bits of columns a to b that lie in a word of 64 columns."""
    lo, hi, ones = F.greatest(a - 64 * word, F.lit(0)), F.least(b - 64 * word, F.lit(63)), F.lit(-1).cast("long")
    return F.when(lo <= hi, _shift("shiftleft", ones, lo).bitwiseAND(_shift("shiftrightunsigned", ones, 63 - hi))).otherwise(F.lit(0).cast("long"))


def rasterize(polygons: DataFrame, patches: DataFrame, gsd: float, patch: int, min_area: float = 0.0, coarse: float | None = None) -> DataFrame:
    """(patch_path, row, col) of every cell that a polygon touches: an edge meets the cell's inside, or its centre is in the polygon.

    Polygons are (way_id, ring); several rings of a way_id are one polygon by even and odd, so a ring inside another is a hole. Those whose
    largest ring is under min_area are left out. Bounds alone meet patches, by overlap_join(). Edges are rows of their own, and each goes by
    bands of y to the rows of patches that it crosses, never a whole ring: there it marks the columns that it meets and flips the
    inside from one column on. A row of a patch is a few numbers of 64 columns, so marks and flips are aggregated by bits.
    """
    cell, words = coarse or gsd * patch, range(-(-patch // 64))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    least, most = (lambda v: F.min(F.array_min(v))), (lambda v: F.max(F.array_max(v)))
    bounds = polygons.groupBy("way_id").agg(least(xs).alias("minx"), least(ys).alias("miny"), most(xs).alias("maxx"), most(ys).alias("maxy"), F.max(ring_area(F.col("ring"))).alias("_area"))
    met = overlap_join(bounds.where(F.col("_area") >= min_area).drop("_area"), patches.select("patch_path", *BOX), cell)
    bands = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    met = met.select(F.col("way_id_a").alias("_way"), F.col("patch_path_b").alias("patch_path"), "minx_b", "maxx_b", "maxy_b", F.greatest("miny_a", "miny_b").alias("from"), F.least("maxy_a", "maxy_b").alias("to"))
    e = polygons.select("way_id", F.explode(edges(F.col("ring"))).alias("e")).select("way_id", "e.*", F.least("e.ay", "e.by").alias("low"), F.greatest("e.ay", "e.by").alias("high"))
    # Both are in all bands they meet; a pair is made in the band where they begin to have y in common. What lies right of a patch doesn't matter to it.
    once = (F.floor(F.greatest("low", "from") / cell) == F.col("band")) & (F.least("ax", "bx") < F.col("maxx_b"))
    pairs = e.withColumn("band", bands("low", "high")).join(met.withColumn("_band", bands("from", "to")), F.col("way_id").eqNullSafe(F.col("_way")) & (F.col("band") == F.col("_band")) & once)
    # Rows count down from the patch's upper bound.
    first, last = F.greatest(F.floor((F.col("maxy_b") - F.col("high")) / gsd), F.lit(0)), F.least(F.ceil((F.col("maxy_b") - F.col("low")) / gsd) - 1, F.lit(patch - 1))
    lines = pairs.where(first <= last).withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    lines = lines.withColumn("y1", F.col("maxy_b") - F.col("row") * gsd).withColumn("y0", F.col("y1") - gsd)
    ax, ay, bx, by, y0, y1, left = (F.col(c) for c in ("ax", "ay", "bx", "by", "y0", "y1", "minx_b"))

    def at(y: Column) -> Column:
        return F.when(y == ay, ax).when(y == by, bx).otherwise(ax + (y - ay) * (bx - ax) / (by - ay))

    level, middle = ay == by, y1 - gsd / 2
    p, q = F.when(level, ax).otherwise(at(F.greatest("low", y0))), F.when(level, bx).otherwise(at(F.least("high", y1)))
    crosses = (F.col("high") > y0) & (F.col("low") < y1)
    a = F.when(crosses, F.greatest(F.floor((F.least(p, q) - left) / gsd), F.lit(0)).cast("int")).otherwise(0)
    b = F.when(crosses, F.least(F.ceil((F.greatest(p, q) - left) / gsd) - 1, F.lit(patch - 1)).cast("int")).otherwise(-1)
    turn = F.ceil(((bx - ax) * (middle - ay) / (by - ay) + ax - left) / gsd - 0.5)
    turn = F.when((ay > middle) != (by > middle), F.greatest(F.least(turn, F.lit(patch)), F.lit(0)).cast("int")).otherwise(patch)
    lines = lines.select("patch_path", "row", "_way", a.alias("a"), b.alias("b"), turn.alias("turn"))
    marks = [F.bit_or(_stretch(F.col("a"), F.col("b"), k)).alias(f"m{k}") for k in words]
    flips = [F.bit_xor(_stretch(F.col("turn"), F.lit(patch - 1), k)).alias(f"i{k}") for k in words]
    filled = lines.groupBy("patch_path", "row", "_way").agg(*marks, *flips)
    rows = filled.groupBy("patch_path", "row").agg(*(F.bit_or(F.col(f"m{k}").bitwiseOR(F.col(f"i{k}"))).alias(f"m{k}") for k in words))
    # A row for each column and a test of its bit, which are compiled, where functions of arrays are not.
    every = rows.where(reduce(or_, (F.col(f"m{k}") != 0 for k in words))).select("*", F.explode(F.sequence(F.lit(0), F.lit(patch - 1))).alias("col"))
    word = F.coalesce(*(F.when(F.col("col") < 64 * (k + 1), F.col(f"m{k}")) for k in words))
    return every.where(_shift("shiftright", word, F.col("col") % 64).bitwiseAND(F.lit(1).cast("long")) == 1).select("patch_path", "row", "col")


def rasterize_places(polygons: DataFrame, patches: DataFrame, gsd: float, patch: int, min_area: float = 0.0, coarse: float | None = None) -> DataFrame:
    """rasterize() of each distinct box of the patches once: (minx, miny, maxx, maxy, row, col). Patches of a common grid share a few boxes, so this grows with places."""
    places = patches.select(BOX).distinct().select(F.struct(*BOX).alias("patch_path"), *BOX)
    return rasterize(polygons, places, gsd, patch, min_area, coarse).select("patch_path.*", "row", "col")


def mask_summary(cells: DataFrame, patches: DataFrame, patch: int, by: list[str] | None = None) -> DataFrame:
    """Positive cells and share of each patch, patches without any included. by: what names a mask in both tables (default: patch_path); BOX for cells of rasterize_places()."""
    by = by or ["patch_path"]
    n = cells.groupBy(*by).agg(F.count("*").alias("positive"))
    out = patches.join(n, by, "left").withColumn("positive", F.coalesce("positive", F.lit(0)))
    return out.withColumn("share", F.col("positive") / (patch * patch))


def rasterize_summary(masks: DataFrame) -> DataFrame:
    return masks.groupBy("scene_id").agg(F.count("*").alias("n_patches"), F.count_if(F.col("positive") > 0).alias("n_with"), F.sum("positive").alias("pixels"), F.avg("share").alias("mean_share"))


def iou_matrix(matrix: DataFrame, quarters: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The pairs as a matrix: a row and a column for each quarter with the prefix. Without named quarters, those of the table (few: a row of it for each)."""
    some = matrix.where(F.col("quarter_a").startswith(prefix) & F.col("quarter_b").startswith(prefix))
    return some.groupBy(F.col("quarter_a").alias("quarter")).pivot("quarter_b", quarters).agg(F.max("iou"))
