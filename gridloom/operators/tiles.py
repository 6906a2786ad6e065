"""Scenes held in tiles: resampling over tile borders, and cutting into tiles of another size.

A tile is a row: keys of its scene, tile_row, tile_col, and bands as array<array<double>>; all tiles have `size` rows and columns but the last ones
of a scene, which have what is left. Sizes of scenes are columns or numbers.

Only borders move between tiles: a destination pixel is made by the tile that holds the upper left of its four source
pixels, so a tile needs the first column of its right neighbour, the first row of the one below and one pixel of the one between. That is
2 / size of the data; the tiles themselves are moved once, by scene and place, and a scene of any size is as many tasks as its tiles allow.

Defined results: where a neighbour is missing, the border is repeated as it is at the scene's own border. Destination pixels of a missing tile
(or one without bands) have the fill value; destination tiles without any other are left out. Null pixels stay null. Empty tables give
empty ones; columns other than the named ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["tile_row", "tile_col"]
Size = int | str


def _of(v: Size) -> Column:
    return F.col(v) if isinstance(v, str) else F.lit(v)


def _left(whole: Column, at: Column, size: int) -> Column:
    """Rows or columns of the tile at a place."""
    return F.least(F.lit(size), whole - at * size).cast("int")


def _ints(first: Column, last: Column) -> Column:
    first, last = first.cast("int"), last.cast("int")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def halos(tiles: DataFrame, keys: list[str], size: int, height: Size, width: Size) -> DataFrame:
    """For each tile's place what its neighbours send: `right` (a column), `below` (a row), `corner` (a pixel), for each band."""
    rows, cols = _left(_of(height), F.col("tile_row"), size), _left(_of(width), F.col("tile_col"), size)
    column = F.transform("bands", lambda p: F.transform(_ints(F.lit(0), rows - 1), lambda r: F.get(p, r * cols)))
    sends = [(0, 1, column), (1, 0, F.transform("bands", lambda p: F.slice(p, 1, cols))), (1, 1, F.transform("bands", lambda p: F.slice(p, 1, 1)))]
    structs = [F.struct((F.col("tile_row") - i).alias("tile_row"), (F.col("tile_col") - j).alias("tile_col"), F.lit(k).alias("kind"), v.alias("v")) for k, (i, j, v) in enumerate(sends)]
    sent = tiles.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*").where("tile_row >= 0 AND tile_col >= 0")
    got = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    return sent.groupBy(*keys, *PLACE).agg(got(0).alias("right"), got(1).alias("below"), got(2).alias("corner"))


def _framed(rows: Column, cols: Column) -> Column:
    """The bands with one more row and column: the neighbours', or the own last ones again."""

    def one(p: Column, k: Column) -> Column:
        right = lambda r: F.when(F.col("right").isNull(), F.get(p, r * cols + cols - 1)).otherwise(F.get(F.get("right", k), r))
        below = F.when(F.col("below").isNull(), F.slice(p, (rows - 1) * cols + 1, cols)).otherwise(F.get("below", k))
        corner = F.when(F.col("corner").isNotNull(), F.get(F.get("corner", k), 0)).when(F.col("below").isNotNull(), F.get(F.get("below", k), cols - 1)).otherwise(right(rows - 1))
        own = F.transform(_ints(F.lit(0), rows - 1), lambda r: F.concat(F.slice(p, r * cols + 1, cols), F.array(right(r))))
        return F.flatten(F.concat(own, F.array(F.concat(below, F.array(corner)))))

    return F.transform("bands", one)


def _axis(first: Column, n: Column, whole: Column, to: Column, method: str) -> Column:
    """array<struct<i, at, d>>: destination rows (or columns) that a tile makes, the tile's own row that each begins at, and the next one's weight."""
    if method == "nearest":
        y = lambda i: F.floor((i + 0.5) * whole / to).cast("double")
    else:
        y = lambda i: F.greatest(F.lit(0.0), F.least(whole - 1.0, (i + 0.5) * whole / to - 0.5))
    low = F.when(first == 0, 0).otherwise(F.greatest(F.lit(0), F.floor(first * to / whole - 0.5) - 1))
    high = F.when(first + n >= whole, to - 1).otherwise(F.least(to - 1, F.ceil((first + n + 0.5) * to / whole) + 1))
    mine = F.filter(_ints(low, high), lambda i: (F.floor(y(i)) >= first) & (F.floor(y(i)) < first + n))
    return F.transform(mine, lambda i: F.struct(i.alias("i"), (F.floor(y(i)) - first).cast("int").alias("at"), (y(i) - F.floor(y(i))).alias("d")))


def resampled_pieces(tiles: DataFrame, keys: list[str], size: int, height: Size, width: Size, to_height: Size, to_width: Size, method: str = "bilinear") -> DataFrame:
    """What each tile makes of the resampled scene: keys, row0, col0, n_rows, n_cols, bands, to_height, to_width. method: bilinear or nearest."""
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"no such method: {method}")
    sizes = {"_h": _of(height), "_w": _of(width), "to_height": _of(to_height), "to_width": _of(to_width)}
    t = tiles.where(F.col("bands").isNotNull()).select(*keys, *PLACE, F.col("bands").cast("array<array<double>>").alias("bands"), *(v.cast("int").alias(k) for k, v in sizes.items()))
    if method == "bilinear":
        t = t.join(halos(t, keys, size, "_h", "_w"), [*keys, *PLACE], "left")
    t = t.withColumns({"_rows": _left(F.col("_h"), F.col("tile_row"), size), "_cols": _left(F.col("_w"), F.col("tile_col"), size)})
    t = t.withColumns({
        "_y": _axis(F.col("tile_row") * size, F.col("_rows"), F.col("_h"), F.col("to_height"), method),
        "_x": _axis(F.col("tile_col") * size, F.col("_cols"), F.col("_w"), F.col("to_width"), method),
    }).where("size(_y) > 0 AND size(_x) > 0")
    if method == "bilinear":
        t, step = t.withColumn("bands", _framed(F.col("_rows"), F.col("_cols"))), F.col("_cols") + 1
        line = lambda b, at, c: (1 - c["d"]) * F.get(b, at) + c["d"] * F.get(b, at + 1)
        value = lambda b, r, c: (1 - r["d"]) * line(b, r["at"] * step + c["at"], c) + r["d"] * line(b, (r["at"] + 1) * step + c["at"], c)
    else:
        value = lambda b, r, c: F.get(b, r["at"] * F.col("_cols") + c["at"])
    bands = F.transform("bands", lambda b: F.flatten(F.transform("_y", lambda r: F.transform("_x", lambda c: value(b, r, c)))))
    return t.select(*keys, F.col("_y")[0]["i"].alias("row0"), F.col("_x")[0]["i"].alias("col0"), F.size("_y").alias("n_rows"), F.size("_x").alias("n_cols"), bands.alias("bands"), "to_height", "to_width")


def retile(pieces: DataFrame, keys: list[str], size: int, height: Size, width: Size, fill: float = 0.0) -> DataFrame:
    """Pieces (row0, col0, n_rows, n_cols, bands) of scenes, which don't overlap, as tiles of another size. A tile gathers its own pixels only."""
    div = lambda a: F.floor(a / size).cast("int")
    p = pieces.withColumns({"_h": _of(height), "_w": _of(width)})
    p = p.withColumn("tile_row", F.explode(_ints(div(F.col("row0")), div(F.col("row0") + F.col("n_rows") - 1))))
    p = p.withColumn("tile_col", F.explode(_ints(div(F.col("col0")), div(F.col("col0") + F.col("n_cols") - 1))))
    top, left = F.col("tile_row") * size, F.col("tile_col") * size
    r0, c0 = F.greatest("row0", top), F.greatest("col0", left)
    r1, c1 = F.least(F.col("row0") + F.col("n_rows"), top + size), F.least(F.col("col0") + F.col("n_cols"), left + size)
    cut = lambda r: F.transform("bands", lambda b: F.slice(b, (r - F.col("row0")) * F.col("n_cols") + c0 - F.col("col0") + 1, c1 - c0))
    strips = F.transform(_ints(r0, r1 - 1), lambda r: F.struct(((r - top) * _left(F.col("_w"), F.col("tile_col"), size) + c0 - left).cast("int").alias("at"), (c1 - c0).alias("n"), cut(r).alias("v")))
    whole = p.select(*keys, *PLACE, "_h", "_w", strips.alias("s")).groupBy(*keys, *PLACE).agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.max("_h").alias("_h"), F.max("_w").alias("_w"))
    whole = whole.withColumn("_n", _left(F.col("_h"), F.col("tile_row"), size) * _left(F.col("_w"), F.col("tile_col"), size))
    end = lambda j: F.when(j < 0, 0).otherwise(F.get("s", j)["at"] + F.get("s", j)["n"])
    gap = lambda n: F.array_repeat(F.lit(fill), n.cast("int"))
    band = lambda k: F.flatten(F.concat(F.transform("s", lambda s, j: F.concat(gap(s["at"] - end(j - 1)), F.get(s["v"], k))), F.array(gap(F.col("_n") - end(F.size("s") - 1)))))
    return whole.select(*keys, *PLACE, F.transform(_ints(F.lit(0), F.size(F.col("s")[0]["v"]) - 1), band).alias("bands"))


def resample_tiles(tiles: DataFrame, keys: list[str], size: int, height: Size, width: Size, to_size: int, to_height: Size, to_width: Size, method: str = "bilinear", fill: float = 0.0) -> DataFrame:
    """Scenes in tiles of `size` resampled to to_height x to_width, in tiles of `to_size`; equal to resampling each scene whole."""
    return retile(resampled_pieces(tiles, keys, size, height, width, to_height, to_width, method), keys, to_size, "to_height", "to_width", fill)
