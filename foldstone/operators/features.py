"""The feature table: events and background places with terrain, distances, rainfall and land cover; and its summary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.columns import COVER_GROUPS, utm_forward, utm_inverse
from foldstone.operators import catalogue, raster, sampling, vector
from foldstone.operators.raster import Grid
from foldstone.session import materialize

#: Accuracy (km) up to which an event counts as near, backgrounds an event, cell sizes in metres, radius of land cover.
CUTOFF_KM, RATIO, CELL, COARSE, RADIUS_KM = 5.0, 5, 30.0, 300.0, 2.5
#: The columns of the table, and those that a row has to have.
COVER = list(COVER_GROUPS)
COLUMNS = ["label", "abs_set", "event_id", "event_date", "accuracy_km", "longitude", "latitude", "x", "y", "elevation", "slope", "aspect_sin", "aspect_cos", "curvature", "road_dist_km", "river_dist_km", "rain_mm", *COVER, "inside"]
NEEDED = ["elevation", "slope", "curvature", "rain_mm", *COVER]
SETS = ("presence", "uniform", "road_weighted")


@dataclass(frozen=True)
class Inputs:
    """``events``: cleaned, with event_id, event_time, accuracy_km, longitude and latitude. ``roads``, ``rivers`` and ``boundary`` are
    segments in metres; ``dem`` lies on ``grid``; ``rain`` and the tiles of ``cover`` are in degrees, each with its own grid."""

    events: DataFrame
    boundary: DataFrame
    roads: DataFrame
    rivers: DataFrame
    dem: DataFrame
    grid: Grid
    rain: tuple[DataFrame, Grid]
    cover: dict[str, tuple[DataFrame, Grid]]


def assemble(points: DataFrame, *parts: DataFrame) -> DataFrame:
    """``points`` with the columns of every part, by id; ids without a part's row have NULLs."""
    return reduce(lambda whole, part: whole.join(part, "id", "left"), parts, points)


def finished(rows: DataFrame, needed: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """The rows that have all they need, the first of each key."""
    return catalogue.keep_first(catalogue.complete(rows, needed), keys, order)


def presences(events: DataFrame) -> DataFrame:
    """Events with their projected places."""
    x, y = utm_forward(F.col("longitude"), F.col("latitude"))
    return events.select("event_id", F.col("event_time").alias("event_date"), "accuracy_km", "longitude", "latitude", x.alias("x"), y.alias("y"))


def backgrounds(cells: DataFrame, events: DataFrame, roads: DataFrame, grid: Grid, draws: int) -> tuple[DataFrame, DataFrame]:
    """Repeated draws (draw, scheme, id, x, y) among ``cells`` (id, r, c, x, y), and the distances (id, km) that their weights come from.
    Cells that hold any event are not drawn; a draw has ``RATIO`` cells for each near event."""
    near = events.where(F.col("accuracy_km") <= CUTOFF_KM).withColumn("id", F.monotonically_increasing_id())
    km = lambda points: vector.nearest_line(points, roads).select("id", (F.col("distance") / 1000.0).alias("km"))
    far = materialize(km(cells), "cell-distances")
    weights = sampling.matched_weights(far, km(near)).select("id", F.col("weight").alias("w"))
    free = vector.unoccupied(cells, events, grid.x0, grid.y0, grid.dx).join(weights, "id")
    wanted = RATIO * near.count()
    sampling.enough(free, wanted, "w")
    return sampling.repeated_draws(free, draws, wanted).join(cells.select("id", "x", "y"), "id"), far


def build(inputs: Inputs, draws: int = 1) -> tuple[DataFrame, DataFrame]:
    """The feature table, with ``draw`` (-1 for events), and the distances of all background cells to roads."""
    spark = inputs.events.sparkSession
    coarse = raster.coarser(inputs.grid, COARSE)
    inside = vector.rasterize(inputs.boundary, coarse.x0, coarse.y0, coarse.height, coarse.width, COARSE)
    cells = inside.select((F.col("r") * coarse.width + F.col("c")).alias("id"), "r", "c", (coarse.x0 + (F.col("c") + 0.5) * COARSE).alias("x"), (coarse.y0 - (F.col("r") + 0.5) * COARSE).alias("y"))
    cells = materialize(cells, "cells")
    events = materialize(presences(inputs.events), "presences")
    drawn, far = backgrounds(cells, events, inputs.roads, coarse, draws)
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    absent = drawn.select(F.lit(0).alias("label"), F.col("scheme").alias("abs_set"), F.col("draw").cast("int").alias("draw"), lon.alias("longitude"), lat.alias("latitude"), "x", "y")
    present = events.select(F.lit(1).alias("label"), F.lit("presence").alias("abs_set"), F.lit(-1).alias("draw"), *events.columns)
    points = materialize(present.unionByName(absent, allowMissingColumns=True).withColumn("id", F.monotonically_increasing_id()), "points")
    return described(points, inputs), far


def described(points: DataFrame, inputs: Inputs, radius_km: float = RADIUS_KM) -> DataFrame:
    """The features of ``points`` (id, label, abs_set, draw, longitude, latitude, x, y, ...): rows without all they need go, and of the
    rows of a set and draw in one cell the first stays."""
    row, col = inputs.grid.place(F.col("x"), F.col("y"))
    points = points.withColumns({"row": row.cast("long"), "col": col.cast("long")})  # cut towards zero
    terrain = raster.terrain_at(inputs.dem, points.select("id", F.col("row").alias("r"), F.col("col").alias("c")), inputs.grid.dx)
    km = lambda lines, name: vector.nearest_line(points, lines).select("id", (F.col("distance") / 1000.0).alias(name))
    rain = raster.sample_at(*inputs.rain, points, "longitude", "latitude").withColumnRenamed("v", "rain_mm")
    cover = raster.cover_shares(inputs.cover, points.select("id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), radius_km)
    whole = assemble(points, terrain, km(inputs.roads, "road_dist_km"), km(inputs.rivers, "river_dist_km"), rain, cover, vector.within(points, inputs.boundary))
    return finished(whole, NEEDED, ["abs_set", "draw", "row", "col"], ["id"]).select("id", *COLUMNS, "draw")


def _by_set(of: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in of.items()])


def _shares(distances: DataFrame, km: str) -> DataFrame:
    found = sampling.bin_shares(distances.select(F.col(km).alias("km")))
    return found.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("s"))  # a row a bin


def summary(table: DataFrame, far: DataFrame, before: int) -> DataFrame:
    """One row: settings, counts, medians and shares by set, for a JSON document. ``before``: rows before any was dropped."""
    here = lambda c, k: F.when(F.col("abs_set") == k, F.col(c))
    each = lambda make: _by_set({k: make(k) for k in SETS})
    found = table.agg(
        each(lambda k: F.rint(F.median(here("rain_mm", k)))).alias("median_rain_mm"),
        _by_set({c: each(lambda k, c=c: F.bround(F.avg(here(c, k)), 3)) for c in COVER}).alias("mean_land_cover_share"),
        each(lambda k: F.bround(F.median(here("river_dist_km", k)), 2)).alias("median_river_dist_km"),
        each(lambda k: F.bround(F.median(here("road_dist_km", k)), 2)).alias("median_road_dist_km"),
        each(lambda k: F.count_if(F.col("abs_set") == k)).alias("counts_by_set"),
        F.count(F.lit(1)).alias("rows_written"),
        (F.lit(before) - F.count(F.lit(1))).alias("rows_dropped"),
    )
    near = table.where((F.col("abs_set") == "presence") & (F.col("accuracy_km") <= CUTOFF_KM))
    bins = {"background_cells": _shares(far, "km"), "near_presences": _shares(near, "road_dist_km"), **{k: _shares(table.where(F.col("abs_set") == k), "road_dist_km") for k in SETS[1:]}}
    for name, one in bins.items():
        found = found.crossJoin(one.withColumnRenamed("s", f"share_{name}"))  # one row each
    shares = F.struct(*[F.col(f"share_{n}").alias(n) for n in bins])
    settings = {"cell_m": CELL, "absence_ratio": RATIO, "presence_cutoff_km": CUTOFF_KM, "land_cover_radius_km": RADIUS_KM}
    return found.select(*[F.lit(v).alias(k) for k, v in settings.items()], *[c for c in found.columns if not c.startswith("share_")], shares.alias("share_by_distance_bin"))


def boundary_grid(edges: DataFrame, cell: float = CELL) -> Grid:
    """The grid around the projected edges of a boundary, with a margin of a kilometre."""
    b = edges.agg(F.min(F.least("x0", "x1")).alias("l"), F.min(F.least("y0", "y1")).alias("b"), F.max(F.greatest("x0", "x1")).alias("r"), F.max(F.greatest("y0", "y1")).alias("t")).first()
    return raster.snapped_grid(b["l"], b["b"], b["r"], b["t"], cell)


def boundary_dem(spark: SparkSession, tiles: dict[str, tuple[DataFrame, Grid]], edges: DataFrame, grid: Grid) -> DataFrame:
    """Elevation on ``grid`` from the tiles that meet the boundary of ``edges``, in metres."""
    boxes = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), *[c.alias(k) for k, c in zip(("l", "b", "r", "t"), raster.projected_bounds(g))]) for name, (_, g) in tiles.items()])).alias("box")).select("box.*")
    used = {r["name"] for r in vector.boxes_meeting(boxes, edges).collect()}  # a row a tile
    return raster.mosaic({name: tile for name, tile in tiles.items() if name in used}, raster.all_cells(spark, grid))
