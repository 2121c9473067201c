"""Rasters as long tables (r, c, v), row 0 in the north, and their places on the map."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstone.functions.columns import COVER_GROUPS, aspect_degrees, no_nan, slope_degrees, utm_forward, utm_inverse
from foldstone.session import ship


@dataclass(frozen=True)
class Grid:
    """Where a raster lies: its north-west corner, the size of a cell (both positive) and its shape."""

    x0: float
    y0: float
    dx: float
    dy: float
    height: int
    width: int

    def window(self, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """(first row, first column, rows, columns) of the cells under (left, bottom, right, top): offsets are cut down to whole
        cells and lengths rounded up, with room for the last digits of a float."""
        left, bottom, right, top = bounds
        row, col = (self.y0 - top) / self.dy, (left - self.x0) / self.dx
        height, width = (top - bottom) / self.dy, (right - left) / self.dx
        return math.floor(row + 1e-6), math.floor(col + 1e-6), math.ceil(height - 1e-6), math.ceil(width - 1e-6)

    def cropped(self, bounds: tuple[float, float, float, float]) -> Grid:
        row, col, height, width = self.window(bounds)
        return Grid(self.x0 + col * self.dx, self.y0 - row * self.dy, self.dx, self.dy, height, width)

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The row and column, with fractions, of a place."""
        return (self.y0 - y) / self.dy, (x - self.x0) / self.dx

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 - self.height * self.dy, self.x0 + self.width * self.dx, self.y0


TILE = 256


def _neighbours(raster: DataFrame) -> DataFrame:
    """Each cell of a dense raster with the values beside it. Cells are dealt by square tiles, those at an edge to the tile beyond as
    well: one shuffle, after which a tile's rows and columns are windows of the same partitions."""
    r, c = F.col("r"), F.col("c")
    own = F.struct(F.floor(r / TILE).alias("tr"), F.floor(c / TILE).alias("tc"))
    steps = [(F.pmod(r, F.lit(TILE)) == edge, F.struct((own["tr"] + dr).alias("tr"), (own["tc"] + dc).alias("tc"))) for edge, dr, dc in ((0, -1, 0), (TILE - 1, 1, 0))]
    steps += [(F.pmod(c, F.lit(TILE)) == edge, F.struct(own["tr"].alias("tr"), (own["tc"] + dc).alias("tc"))) for edge, dc in ((0, -1), (TILE - 1, 1))]
    homes = F.array_compact(F.array(own, *[F.when(at, home) for at, home in steps]))
    dealt = raster.select("r", "c", "v", F.explode(homes).alias("home")).select("r", "c", "v", "home.tr", "home.tc").repartition("tr", "tc")
    along, across = Window.partitionBy("tr", "tc", "r").orderBy("c"), Window.partitionBy("tr", "tc", "c").orderBy("r")
    near = dealt.select("*", F.lag("v").over(along).alias("west"), F.lead("v").over(along).alias("east"), F.lag("v").over(across).alias("north"), F.lead("v").over(across).alias("south"))
    return near.where((F.floor(r / TILE) == F.col("tr")) & (F.floor(c / TILE) == F.col("tc"))).drop("tr", "tc")


def _gradients(west: Column, east: Column, north: Column, south: Column, v: Column, cell: float) -> tuple[Column, Column]:
    """Rise to the east and to the north: central differences, one-sided at the edges."""

    def rise(low: Column, high: Column) -> Column:
        steps = F.when(low.isNotNull() & high.isNotNull(), 2 * cell).otherwise(cell)
        return (F.coalesce(high, v) - F.coalesce(low, v)) / steps

    return rise(west, east), rise(south, north)


def terrain(raster: DataFrame, cell: float = 30.0) -> DataFrame:
    """slope, aspect, aspect_sin, aspect_cos and curvature of every cell of a dense raster."""
    near = _neighbours(raster)
    east, north = _gradients(*(F.col(x) for x in ("west", "east", "north", "south", "v")), cell)
    aspect = aspect_degrees(east, north)
    around = sum((F.coalesce(x, "v") for x in ("west", "east", "north")), F.coalesce("south", "v"))
    return near.select("r", "c", "v", slope_degrees(east, north).alias("slope"), aspect.alias("aspect"), F.sin(F.radians(aspect)).alias("aspect_sin"), F.cos(F.radians(aspect)).alias("aspect_cos"), ((around - 4 * F.col("v")) / cell**2).alias("curvature"))


def terrain_at(raster: DataFrame, points: DataFrame, cell: float = 30.0) -> DataFrame:
    """Terrain at ``points`` (id, r, c) from the 5 x 5 cells around each; NULL unless all 25 have values. Flat ground has
    aspect sine and cosine 0. Only the cells that points need are read from the join; the raster gets no window."""
    reach = F.sequence(F.lit(-2), F.lit(2))
    spots = points.select("id", "r", "c", F.explode(reach).alias("dr")).select("*", F.explode(reach).alias("dc"))
    values = raster.where(F.col("v").isNotNull()).select(F.col("r").alias("vr"), F.col("c").alias("vc"), "v")
    met = spots.join(values, (F.col("r") + F.col("dr") == F.col("vr")) & (F.col("c") + F.col("dc") == F.col("vc")), "left")

    def at(dr: int, dc: int) -> Column:
        return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("v")))

    near = met.groupBy("id").agg(F.count("v").alias("n"), at(0, 0).alias("z"), at(0, -1).alias("w"), at(0, 1).alias("e"), at(-1, 0).alias("nn"), at(1, 0).alias("s"))
    east, north = _gradients(F.col("w"), F.col("e"), F.col("nn"), F.col("s"), F.col("z"), cell)
    aspect = F.radians(aspect_degrees(east, north))
    whole = lambda c: F.when(F.col("n") == 25, c)
    lap = (F.col("w") + F.col("e") + F.col("nn") + F.col("s") - 4 * F.col("z")) / cell**2
    return near.select("id", whole(F.col("z")).alias("elevation"), whole(slope_degrees(east, north)).alias("slope"), whole(F.coalesce(F.sin(aspect), F.lit(0.0))).alias("aspect_sin"), whole(F.coalesce(F.cos(aspect), F.lit(0.0))).alias("aspect_cos"), whole(lap).alias("curvature"))


def stack_mean(stack: DataFrame) -> DataFrame:
    """(r, c, mean) over the layers of ``stack`` (r, c, v); missing and not-a-number values do not count."""
    return stack.groupBy("r", "c").agg(F.avg(no_nan(F.col("v"))).alias("mean"))


def sample(raster: DataFrame, points: DataFrame) -> DataFrame:
    """The value of the cell that holds each of ``points`` (id, prow, pcol: fractional); NULL outside."""
    cells = raster.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v")
    spots = points.select("id", F.floor("prow").alias("r"), F.floor("pcol").alias("c"))
    return spots.join(cells, ["r", "c"], "left").select("id", "v")


def annual_mean(layers: dict[str, tuple[DataFrame, Grid]], bounds: tuple[float, float, float, float]) -> tuple[DataFrame, Grid]:
    """The mean over yearly rasters (r, c, v) inside bounds, as a raster of its own grid. All must lie on one grid."""
    if not layers:
        raise ValueError("a mean needs one raster at least")
    (first, (_, grid)), *others = layers.items()
    for name, (_, other) in others:
        if other != grid:
            raise ValueError(f"{name} does not lie on the grid of {first}")
    row, col, height, width = grid.window(bounds)
    stack = None
    for raster, _ in layers.values():
        inside = raster.where(F.col("r").between(row, row + height - 1) & F.col("c").between(col, col + width - 1))
        cut = inside.select((F.col("r") - row).alias("r"), (F.col("c") - col).alias("c"), "v")
        stack = cut if stack is None else stack.unionByName(cut)
    return stack_mean(stack).select("r", "c", F.col("mean").alias("v")), grid.cropped(bounds)


def sample_at(raster: DataFrame, grid: Grid, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(id, v): the value of the cell that holds each of ``points`` (id, x, y); NULL outside."""
    row, col = grid.place(F.col(x), F.col(y))
    inside = raster.where(F.col("r").between(0, grid.height - 1) & F.col("c").between(0, grid.width - 1))
    return sample(inside, points.select("id", row.alias("prow"), col.alias("pcol")))


#: Fixed value: metres in a degree of latitude.
METRES_A_DEGREE = 111_320.0
CHUNK = 256


def _runs(points: DataFrame) -> DataFrame:
    """(id, r, low, high): for each of ``points`` (id, prow, pcol, a, b, radius) the columns of every row whose pixel centres lie in its
    circle. ``a`` and ``b`` are the heights and widths of a pixel in the unit of the radius."""
    reach = F.col("radius") / F.col("a")
    rows = F.sequence(F.floor(F.col("prow") - reach), F.ceil(F.col("prow") + reach))
    each = points.select("*", F.explode(rows).alias("r")).withColumn("dy", F.pow((F.col("r") + 0.5 - F.col("prow")) * F.col("a"), 2))
    each = each.where(F.col("dy") <= F.col("radius") * F.col("radius"))
    holds = lambda c: F.col("dy") + F.pow((c + 0.5 - F.col("pcol")) * F.col("b"), 2) <= F.col("radius") * F.col("radius")
    half = F.sqrt(F.col("radius") * F.col("radius") - F.col("dy")) / F.col("b")
    each = each.withColumn("low", F.ceil(F.col("pcol") - 0.5 - half)).withColumn("high", F.floor(F.col("pcol") - 0.5 + half))
    low, high = F.col("low"), F.col("high")  # the root may be off by its last digit: the centres beside decide
    low = F.when(holds(low - 1), low - 1).when(holds(low), low).otherwise(low + 1)
    high = F.when(holds(high + 1), high + 1).when(holds(high), high).otherwise(high - 1)
    return each.select("id", F.col("r").cast("long").alias("r"), low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")


def _running_counts(chunks: DataFrame, groups: dict[str, tuple[int, ...]]) -> DataFrame:
    """(r, k, pixels, groups...): for a chunk of a raster's row, how many valid pixels, and how many of each group, lie before each place."""
    names = ["pixels", *groups]

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {n: [] for n in names}
            for cells in frame.cells:
                codes = np.zeros(CHUNK, np.int64)
                for cell in cells:
                    codes[cell["at"]] = cell["code"]
                for n in names:
                    marks = codes > 0 if n == "pixels" else np.isin(codes, groups[n])
                    out[n].append(np.concatenate([[0], np.cumsum(marks)]).astype(np.int32))
            yield pd.DataFrame({"r": frame.r, "k": frame.k, **out})

    ship(chunks.sparkSession)
    return chunks.mapInPandas(over, "r long, k long, " + ", ".join(f"{n} array<int>" for n in names))


def shares_in_circles(cover: DataFrame, points: DataFrame, groups: dict[str, tuple[int, ...]] = COVER_GROUPS) -> DataFrame:
    """Share of each group of codes among the valid pixels (``code`` > 0) of ``cover`` (r, c, code) in the circle of each of ``points``
    (id, prow, pcol, a, b, radius); NULL for all groups where no pixel is valid.

    A circle is a run of columns in each row it meets, and a run's counts are differences of running counts at its two ends: work
    follows the rows of a circle, not its pixels, and only chunks that circles meet are counted."""
    runs = _runs(points).select("*", F.explode(F.sequence(F.floor(F.col("low") / CHUNK), F.floor(F.col("high") / CHUNK))).alias("k"))
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(CHUNK), c - F.col("k") * CHUNK)).cast("int") + 1
    runs = runs.select("id", "r", "k", place(F.col("low")).alias("a"), place(F.col("high") + 1).alias("z"))
    pixels = cover.where("code > 0").select(F.col("r").cast("long").alias("r"), F.floor(F.col("c") / CHUNK).alias("k"), F.struct(F.pmod(F.col("c"), F.lit(CHUNK)).cast("int").alias("at"), F.col("code").cast("int").alias("code")).alias("cell"))
    chunks = pixels.join(runs.select("r", "k").distinct(), ["r", "k"], "left_semi").groupBy("r", "k").agg(F.collect_list("cell").alias("cells"))  # at most CHUNK
    met = runs.join(_running_counts(chunks, groups), ["r", "k"])
    count = lambda n: F.sum(F.col(n)[F.col("z") - 1] - F.col(n)[F.col("a") - 1])
    found = met.groupBy("id").agg(*[count(n).alias(n) for n in ("pixels", *groups)])
    return points.select("id").join(found, "id", "left").select("id", *[F.when(F.col("pixels") > 0, F.col(g) / F.col("pixels")).alias(g) for g in groups])


def _positive(radius: float) -> None:
    if radius <= 0:
        raise ValueError("a radius has to be greater than zero")


def class_shares(cover: DataFrame, points: DataFrame, radius: float, groups: dict[str, tuple[int, ...]] = COVER_GROUPS) -> DataFrame:
    """``shares_in_circles`` within ``radius`` pixels of ``points`` (id, prow, pcol)."""
    _positive(radius)
    one = F.lit(1.0)
    return shares_in_circles(cover, points.select("id", "prow", "pcol", one.alias("a"), one.alias("b"), F.lit(float(radius)).alias("radius")), groups)


def cover_shares(tiles: dict[str, tuple[DataFrame, Grid]], points: DataFrame, radius_km: float = 2.5, groups: dict[str, tuple[int, ...]] = COVER_GROUPS) -> DataFrame:
    """``shares_in_circles`` within ``radius_km`` of ``points`` (id, lon, lat), over tiles (r, c, v) in degrees that lie on one global grid of
    pixels from (-180, 90). A degree of longitude is as wide as it is at the point. Later tiles stand over earlier ones."""
    if not tiles:
        raise ValueError("At least one tile is needed")
    _positive(radius_km)
    size = next(iter(tiles.values()))[1].dx
    merged = None
    for order, (name, (tile, grid)) in enumerate(tiles.items()):
        row, col = (90.0 - grid.y0) / size, (grid.x0 + 180.0) / size
        if abs(row - round(row)) > 1e-3 or abs(col - round(col)) > 1e-3:
            raise ValueError(f"{name} is off the pixel grid from (-180, 90)")
        part = tile.select((F.col("r") + round(row)).alias("r"), (F.col("c") + round(col)).alias("c"), F.coalesce(F.col("v").cast("int"), F.lit(0)).alias("code"), F.lit(order).alias("order"))
        merged = part if merged is None else merged.unionByName(part)
    if len(tiles) > 1:
        merged = merged.groupBy("r", "c").agg(F.max_by("code", "order").alias("code"))
    high = F.lit(size * METRES_A_DEGREE)
    spots = points.select("id", ((90.0 - F.col("lat")) / size).alias("prow"), ((F.col("lon") + 180.0) / size).alias("pcol"), high.alias("a"), (high * F.cos(F.radians("lat"))).alias("b"), F.lit(radius_km * 1000.0).alias("radius"))
    return shares_in_circles(merged.select("r", "c", "code"), spots, groups)


def snapped_grid(left: float, bottom: float, right: float, top: float, cell: float = 30.0, pad: float = 1000.0) -> Grid:
    """The grid of whole cells around bounds with a margin."""
    x0, y1 = math.floor((left - pad) / cell) * cell, math.floor((bottom - pad) / cell) * cell
    x1, y0 = math.ceil((right + pad) / cell) * cell, math.ceil((top + pad) / cell) * cell
    return Grid(x0, y0, cell, cell, round((y0 - y1) / cell), round((x1 - x0) / cell))


def coarser(grid: Grid, cell: float) -> Grid:
    """The grid of larger cells from the same corner that covers ``grid``."""
    return Grid(grid.x0, grid.y0, cell, cell, math.ceil(grid.height * grid.dy / cell), math.ceil(grid.width * grid.dx / cell))


def all_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """(r, c, x, y) of every cell, at its centre."""
    cells = spark.range(grid.height).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1)).cast("array<bigint>")).alias("c"))
    return cells.select("r", "c", (grid.x0 + (F.col("c") + 0.5) * grid.dx).alias("x"), (grid.y0 - (F.col("r") + 0.5) * grid.dy).alias("y"))


def projected_bounds(grid: Grid) -> tuple[Column, Column, Column, Column]:
    """The bounds, in metres, of the projected corners of a grid in degrees."""
    corners = [utm_forward(F.lit(x), F.lit(y)) for x in grid.bounds[::2] for y in grid.bounds[1::2]]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def mosaic(tiles: dict[str, tuple[DataFrame, Grid]], target: DataFrame) -> DataFrame:
    """(r, c, v): the cells ``target`` (r, c, x, y: metres) with the values of tiles (r, c, v) in degrees, bilinear between the four
    centres around. Missing ones do not count and the others' weights grow for them; a later tile stands over an earlier one.

    Cells meet tiles by the whole degrees that these reach into."""
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    cells = target.select("r", "c", lon.alias("lon"), lat.alias("lat"))
    cells = cells.withColumn("dlon", F.floor("lon").cast("int")).withColumn("dlat", F.floor("lat").cast("int"))
    listed, pixels = [], None
    for order, (tile, grid) in enumerate(tiles.values()):
        left, bottom, right, top = grid.bounds
        listed += [(order, *map(float, (grid.x0, grid.y0, grid.dx, grid.dy, grid.height, grid.width)), i, j) for i in range(math.floor(left), math.ceil(right)) for j in range(math.floor(bottom), math.ceil(top))]
        part = tile.select(F.lit(order).alias("tile"), F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), "v").where("v is not null and not isnan(v)")
        pixels = part if pixels is None else pixels.unionByName(part)
    if pixels is None:
        return target.select("r", "c", F.lit(None).cast("double").alias("v"))
    named = target.sparkSession.createDataFrame(listed, "tile int, x0 double, y0 double, dx double, dy double, height double, width double, dlon int, dlat int")
    row, col = (F.col("y0") - F.col("lat")) / F.col("dy"), (F.col("lon") - F.col("x0")) / F.col("dx")
    met = cells.join(F.broadcast(named), ["dlon", "dlat"]).select("r", "c", "tile", row.alias("row"), col.alias("col"), "height", "width")  # a row for each tile and degree
    met = met.where("row >= 0 and row < height and col >= 0 and col < width")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    each = met.select("r", "c", "tile", (F.col("row") - 0.5).alias("row"), (F.col("col") - 0.5).alias("col"), F.explode(corners).alias("at"))
    down, over = F.col("row") - F.floor("row"), F.col("col") - F.floor("col")
    weight = F.when(F.col("at.i") == 1, down).otherwise(1 - down) * F.when(F.col("at.j") == 1, over).otherwise(1 - over)
    each = each.select("r", "c", "tile", (F.floor("row") + F.col("at.i")).alias("sr"), (F.floor("col") + F.col("at.j")).alias("sc"), weight.alias("w")).where("w > 0")
    mixed = each.join(pixels, ["tile", "sr", "sc"]).groupBy("r", "c", "tile").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return target.select("r", "c").join(mixed.groupBy("r", "c").agg(F.max_by("v", "tile").alias("v")), ["r", "c"], "left")
