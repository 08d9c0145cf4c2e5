"""Rasters on regular grids: extents, alignment, coarsening, point sampling. All joins are on integer cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.bands import Bands
from lumenweave.operators.indices import nbr


@dataclass(frozen=True)
class Grid:
    """A north-up grid: outer west and north edge, cell size, columns, rows, reference system."""

    west: float
    north: float
    size: float
    width: int
    height: int
    crs: str | None = None

    @property
    def east(self) -> float:
        return self.west + self.width * self.size

    @property
    def south(self) -> float:
        return self.north - self.height * self.size

    @property
    def area(self) -> float:
        return (self.east - self.west) * (self.north - self.south)

    def centres(self, row: Column, col: Column) -> tuple[Column, Column]:
        """x and y of cells."""
        return F.lit(self.west) + (col + 0.5) * self.size, F.lit(self.north) - (row + 0.5) * self.size

    def cells(self, df: DataFrame) -> DataFrame:
        """row and col of every cell, made on the cluster."""
        n = df.sparkSession.range(self.width * self.height)
        return n.select(F.expr(f"cast(id div {self.width} as int)").alias("row"), F.expr(f"cast(id % {self.width} as int)").alias("col"))


def spatial_info(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bounds of pixel centres, mean cell size, rows and columns, of the whole table or by scene."""
    size = lambda lo, hi, n: F.when(F.col(n) > 1, (F.col(hi) - F.col(lo)) / (F.col(n) - 1))
    out = df.groupBy(*by).agg(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"), (F.max("row") - F.min("row") + 1).cast("long").alias("n_rows"), (F.max("col") - F.min("col") + 1).cast("long").alias("n_cols")
    )
    return out.withColumns({"x_res": size("xmin", "xmax", "n_cols"), "y_res": size("ymin", "ymax", "n_rows")})


def grid_from(info: Mapping, crs: str | None = None) -> Grid:
    """The grid of a row of ``spatial_info``."""
    size = info["x_res"] or info["y_res"] or 1.0
    return Grid(info["xmin"] - size / 2, info["ymax"] + size / 2, size, int(info["n_cols"]), int(info["n_rows"]), crs)


def common_grid(grids: Sequence[Grid], bounds: tuple[float, float, float, float] | None = None, resolution: float = 30.0, min_overlap: float = 0.10) -> Grid:
    """The grid on which all scenes overlap: the intersection of their edges, or ``bounds`` (west, south, east, north)."""
    if len(grids) < 2:
        raise ValueError("two grids at least are needed")
    if len({g.crs for g in grids}) > 1 or grids[0].crs is None:
        raise ValueError("all grids must have one and the same reference system")
    if bounds is None:
        west, south = max(g.west for g in grids), max(g.south for g in grids)
        east, north = min(g.east for g in grids), min(g.north for g in grids)
        if west >= east or south >= north:
            raise ValueError("the scenes do not overlap")
        share = (east - west) * (north - south) / min(g.area for g in grids)
        if share < min_overlap:
            raise ValueError(f"the scenes overlap by {share:.1%} only")
    else:
        west, south, east, north = bounds
    width, height = max(1, round((east - west) / resolution)), max(1, round((north - south) / resolution))
    return Grid(west, north, resolution, width, height, grids[0].crs)


def _weights(f: Column, method: str) -> list[tuple[Column, Column]]:
    """Source cells along an axis and their weights for fractional position ``f`` (0 at the first centre)."""
    base = F.floor(f)
    d = f - base
    if method == "bilinear":
        return [(base, 1 - d), (base + 1, d)]
    near = lambda t: 1.5 * t**3 - 2.5 * t**2 + 1  # noqa: E731  Catmull-Rom, distance under 1
    far = lambda t: -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2  # noqa: E731  distance 1 to 2
    return [(base - 1, far(1 + d)), (base, near(d)), (base + 1, near(1 - d)), (base + 2, far(2 - d))]


def reproject(df: DataFrame, source: Grid, target: Grid, columns: Sequence[str], method: str = "nearest", outer: bool = False) -> DataFrame:
    """``columns`` of a raster (row, col, ...) on the target's cells; with ``outer`` also cells without a source.

    nearest takes the source cell that holds the target's centre; bilinear and cubic weigh 4 or 16 cells, those that
    are missing being left out and the rest made to sum to 1.
    """
    if source.crs != target.crs:
        raise ValueError(f"reference systems differ: {source.crs} and {target.crs}")
    cells = target.cells(df)
    x, y = target.centres(F.col("row"), F.col("col"))
    fx, fy = (x - source.west) / source.size, (source.north - y) / source.size
    data = df.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), *columns)
    if method == "nearest":
        keyed = cells.withColumns({"s_row": F.floor(fy).cast("int"), "s_col": F.floor(fx).cast("int")})
        return keyed.join(data, ["s_row", "s_col"], "left" if outer else "inner").select("row", "col", *columns)
    if method not in ("bilinear", "cubic"):
        raise ValueError(method)
    corners = [F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), (wr * wc).alias("w")) for r, wr in _weights(fy - 0.5, method) for c, wc in _weights(fx - 0.5, method)]
    inside = (fx >= 0) & (fx < source.width) & (fy >= 0) & (fy < source.height)
    keyed = cells.withColumn("k", F.explode(F.array(*corners))).filter(inside).select("row", "col", F.col("k.r").alias("s_row"), F.col("k.c").alias("s_col"), F.col("k.w").alias("w"))
    joined = keyed.join(data, ["s_row", "s_col"])
    sums = [(F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in columns]
    out = joined.groupBy("row", "col").agg(*sums)
    return cells.join(out, ["row", "col"], "left") if outer else out


def align(scenes: Mapping[str, tuple[DataFrame, Grid]], columns: Sequence[str], method: str = "nearest", **grid) -> tuple[dict[str, DataFrame], Grid]:
    """All scenes on their common grid; scenes already on it are left as they are."""
    target = common_grid([g for _, g in scenes.values()], **grid)
    return {k: df.select("row", "col", *columns) if g == target else reproject(df, g, target, columns, method) for k, (df, g) in scenes.items()}, target


def dnbr(pre: DataFrame, post: DataFrame, bands: Bands, spectrum: str = "spectrum", grids: tuple[Grid, Grid] | None = None, auto_align: bool = True, method: str = "nearest", **target) -> DataFrame:
    """(row, col, nbr_pre, nbr_post, dnbr) of two rasters; only the index, not the spectrum, is shuffled.

    Where their ``grids`` differ both go to their common grid (``target`` has its bounds, resolution, min_overlap), or it
    is an error if ``auto_align`` is off. Without ``grids`` the rasters must be on one grid already.
    """
    a = pre.select("row", "col", nbr(F.col(spectrum), bands).alias("nbr_pre"))
    b = post.select("row", "col", nbr(F.col(spectrum), bands).alias("nbr_post"))
    if grids is not None and grids[0] != grids[1]:
        if not auto_align:
            raise ValueError("the scenes are on different grids")
        to = common_grid(grids, **target)
        a, b = (df if g == to else reproject(df, g, to, [c], method) for df, g, c in ((a, grids[0], "nbr_pre"), (b, grids[1], "nbr_post")))
    return a.join(b, ["row", "col"]).withColumn("dnbr", F.col("nbr_pre") - F.col("nbr_post"))


def align_classes(df: DataFrame, source: Grid, target: Grid, code: str = "code", nodata: int = -1) -> DataFrame:
    """Class codes on every cell of the target, ``nodata`` where there is none."""
    return reproject(df, source, target, [code], outer=True).withColumn(code, F.coalesce(F.col(code), F.lit(nodata)).cast("short"))


def coarsen(df: DataFrame, columns: Sequence[str], factor_row: int, factor_col: int, rows: int, cols: int) -> DataFrame:
    """Means over blocks of cells, missing values left out, partial blocks at the far edges dropped."""
    whole = (F.col("row") < rows // factor_row * factor_row) & (F.col("col") < cols // factor_col * factor_col)
    block = [F.expr(f"row div {factor_row}").cast("int").alias("row"), F.expr(f"col div {factor_col}").cast("int").alias("col")]
    return df.filter(whole).groupBy(*block).agg(*[F.avg(c).alias(c) for c in columns])


def coarsening_factor(size: float, resolution: float) -> int:
    """Cells of ``size`` in one of ``resolution``, at least 1, halves to even."""
    return max(1, round(resolution / size))


def aggregate_to_grid(df: DataFrame, source: Grid, target: Grid, columns: Sequence[str]) -> DataFrame:
    """``columns`` coarsened to the target's cell size, then put on its cells by nearest neighbour."""
    if source.crs != target.crs:
        raise ValueError(f"reference systems differ: {source.crs} and {target.crs}")
    f = coarsening_factor(source.size, target.size)
    blocks = coarsen(df, columns, f, f, source.height, source.width)
    coarse = Grid(source.west, source.north, source.size * f, source.width // f, source.height // f, source.crs)
    return reproject(blocks, coarse, target, columns, outer=True)


def cell_of(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """row and col of the pixel whose centre is nearest, the lower coordinate of two equally near; NULL outside the grid."""
    fx, fy = (x - (grid.west + grid.size / 2)) / grid.size, ((grid.north - grid.size / 2) - y) / grid.size
    inside = (fx >= -0.5) & (fx <= grid.width - 0.5) & (fy >= -0.5) & (fy <= grid.height - 0.5)
    col = F.greatest(F.ceil(fx - 0.5), F.lit(0)).cast("int")
    row = F.least(F.floor(fy + 0.5), F.lit(grid.height - 1)).cast("int")
    return F.when(inside, row), F.when(inside, col)


def sample_points(points: DataFrame, raster: DataFrame, grid: Grid, columns: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the raster's ``columns`` at their pixels (NULL outside)."""
    row, col = cell_of(F.col(x), F.col(y), grid)
    keyed = points.withColumns({"_row": row, "_col": col})
    data = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *columns)
    return keyed.join(data, ["_row", "_col"], "left").drop("_row", "_col")


def colocate_sites(sites: DataFrame, raster: DataFrame, grid: Grid, column: str, tolerance: float = 60.0) -> DataFrame:
    """``sites`` with the pixel's value and a status: ok, masked (no value there) or outside (farther than ``tolerance`` on an axis)."""
    cx = F.least(F.greatest(F.round((F.col("x") - grid.west) / grid.size - 0.5), F.lit(0)), F.lit(grid.width - 1)).cast("int")
    cy = F.least(F.greatest(F.round((grid.north - F.col("y")) / grid.size - 0.5), F.lit(0)), F.lit(grid.height - 1)).cast("int")
    px, py = grid.centres(cy, cx)
    near = (F.abs(px - F.col("x")) <= tolerance) & (F.abs(py - F.col("y")) <= tolerance)
    keyed = sites.withColumns({"_row": F.when(near, cy), "_col": F.when(near, cx)})
    data = raster.select(F.col("row").alias("_row"), F.col("col").alias("_col"), column)
    out = keyed.join(data, ["_row", "_col"], "left")
    status = F.when(F.col("_row").isNull(), "outside").when(F.col(column).isNull(), "masked").otherwise("ok")
    return out.withColumn("status", status).drop("_row", "_col")


def overlap_matrix(scenes: DataFrame, key: str = "scene_id") -> DataFrame:
    """Pairs of scenes (a < b) that overlap, and the overlap over the smaller area.

    ``scenes`` has a row a scene: its key, xmin, ymin, xmax, ymax. Scenes are met by equal cells of tilings, one for each
    power of two that a scene's longer side reaches: the tiling of the larger scene of a pair, of which either covers a
    few cells. So scenes that are far apart never meet, and one large scene doesn't bring the small ones together.
    """
    box = ["xmin", "ymin", "xmax", "ymax"]
    longer = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1e-9))
    own = scenes.select(F.col(key).alias("key"), *box, F.ceil(F.log2(longer)).cast("int").alias("level"))
    levels = own.agg(F.collect_set("level").alias("levels"))  # one row of at most some hundred exponents
    up = own.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    side = F.pow(F.lit(2.0), F.col("level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))
    tiled = lambda df: df.withColumn("tx", F.explode(span("xmin", "xmax"))).withColumn("ty", F.explode(span("ymin", "ymax")))
    smaller = tiled(up).select("level", "tx", "ty", F.struct("key", *box).alias("s"))
    larger = tiled(own).select("level", "tx", "ty", F.struct("key", *box).alias("l"))
    met = smaller.join(larger, ["level", "tx", "ty"]).filter(F.col("s.key") != F.col("l.key"))
    pairs = met.select(F.least("s", "l").alias("p"), F.greatest("s", "l").alias("q")).distinct()
    pairs = pairs.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"), *[F.col(f"{x}.{c}").alias(f"{y}_{c}") for x, y in (("p", "a"), ("q", "b")) for c in box])
    w = F.least("a_xmax", "b_xmax") - F.greatest("a_xmin", "b_xmin")
    h = F.least("a_ymax", "b_ymax") - F.greatest("a_ymin", "b_ymin")
    area = lambda p: (F.col(f"{p}_xmax") - F.col(f"{p}_xmin")) * (F.col(f"{p}_ymax") - F.col(f"{p}_ymin"))
    return pairs.filter((w > 0) & (h > 0)).select("a", "b", (w * h / F.least(area("a"), area("b"))).alias("overlap"))


