"""Points, segments and rings: joins on grid cells instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstone.functions.columns import crosses_ray, segment_distance
from foldstone.session import materialize


def _cells_around(df: DataFrame, x: str, y: str, size: Column | float, reach: int = 1) -> DataFrame:
    step = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("cx", F.explode(F.transform(step, lambda d: (F.floor(F.col(x) / size) + d).cast("long")))).withColumn("cy", F.explode(F.transform(step, lambda d: (F.floor(F.col(y) / size) + d).cast("long"))))


def _cells_of(segments: DataFrame, size: float) -> DataFrame:
    """Each segment once for every grid cell that it may touch: cut into parts no longer than a cell, then the cells of
    the parts' boxes."""
    long = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    parts = F.greatest(F.ceil(long / size), F.lit(1)).cast("int")
    cut = segments.select("*", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))

    def span(a: str, b: str) -> Column:
        p = F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("parts")
        q = F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") + 1) / F.col("parts")
        return F.sequence(F.floor(F.least(p, q) / size).cast("long"), F.floor(F.greatest(p, q) / size).cast("long"))

    return cut.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1"))).drop("parts", "i").distinct()


def _nearest(points: DataFrame, targets: DataFrame, distance: Column, keys: list[str], size: float, reach: float, other: Column | None = None) -> DataFrame:
    """(id, distance) of each of ``points`` (id, x, y, keys) to the nearest of ``targets`` (keys, cx, cy, ...), listed by grid cells of ``size``.

    The search goes down a pyramid of cells, each four times as wide as those below. Of the cells that hold targets a point keeps
    those that may hold the nearest one: no farther than the farthest corner, ``reach`` added, of the best cell. So it meets the
    targets of a few cells, however many there are in all, and the upper levels are short tables. With ``other`` (``oid`` is a target's
    own id) a cell in which a point is alone promises nothing."""
    counted = materialize(targets.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("n")), "cells")
    span = counted.agg(F.max("cx").alias("r"), F.min("cx").alias("l"), F.max("cy").alias("t"), F.min("cy").alias("b")).first()
    if span["r"] is None:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    levels = 0
    while 4**levels <= max(span["r"] - span["l"], span["t"] - span["b"]):
        levels += 1
    own = points.withColumn("px", F.floor(F.col("x") / size)).withColumn("py", F.floor(F.col("y") / size))

    def at(level: int, up: bool = False) -> DataFrame:
        """The cells of a level with their targets' number, and the cell above each."""
        cell = lambda c, k: F.floor(F.col(c) / F.lit(4**k)).cast("long")
        found = counted.groupBy(*keys, cell("cx", level).alias("cx"), cell("cy", level).alias("cy")).agg(F.sum("n").alias("n"))
        return found.withColumns({"ux": cell("cx", 1), "uy": cell("cy", 1)}) if up else found

    top = at(levels)  # at most four cells a key
    met = own.join(top, keys) if keys else own.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one").drop("one")
    for level in range(levels, -1, -1):
        width = size * 4**level
        gap = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * width - F.col(v), F.col(v) - (F.col(c) + 1) * width)
        far = lambda v, c: F.greatest(F.abs(F.col(v) - F.col(c) * width), F.abs((F.col(c) + 1) * width - F.col(v))) + reach
        most = F.hypot(far("x", "cx"), far("y", "cy"))
        if other is not None:
            here = (F.floor(F.col("px") / F.lit(4**level)) == F.col("cx")) & (F.floor(F.col("py") / F.lit(4**level)) == F.col("cy"))
            most = F.when(here & (F.col("n") < 2), F.lit(float("inf"))).otherwise(most)
        met = met.withColumn("low", F.hypot(gap("x", "cx"), gap("y", "cy"))).withColumn("most", F.min(most).over(Window.partitionBy("id")))
        met = met.where(F.col("low") <= F.col("most") * (1 + 1e-9)).drop("low", "most", "n")  # a few cells a point
        if level:
            met = met.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(at(level - 1, True), [*keys, "ux", "uy"]).drop("ux", "uy")
    found = met.join(targets, [*keys, "cx", "cy"])
    if other is not None:
        found = found.where(other)
    return points.select("id").join(found.groupBy("id").agg(F.min(distance).alias("distance")), "id", "left")


def nearest_line(points: DataFrame, segments: DataFrame, bucket: float = 2000.0) -> DataFrame:
    """(id, distance) of each of ``points`` (id, x, y) to the nearest of ``segments`` (x0, y0, x1, y1); NULL without any."""
    targets = _cells_of(segments.select("x0", "y0", "x1", "y1").distinct(), bucket)
    distance = segment_distance(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))
    spots = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _nearest(spots, targets, distance, [], bucket, bucket)  # a part of a segment may lie in a cell beside one that lists it


def nearest_other(points: DataFrame, by: str, bucket: float = 2000.0) -> DataFrame:
    """(id, distance) of each of ``points`` (id, x, y, ``by``) to the nearest other one of the same ``by``; points in one
    place are 0 apart."""
    own = points.select("id", by, "x", "y")
    targets = own.select(F.col("id").alias("oid"), by, F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("x") / bucket).alias("cx"), F.floor(F.col("y") / bucket).alias("cy"))
    distance = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return _nearest(own, targets, distance, [by], bucket, 0.0, F.col("id") != F.col("oid"))


def within(points: DataFrame, edges: DataFrame, least_rows: int = 1024, most_rows: int = 1 << 16) -> DataFrame:
    """(id, inside) of ``points`` (id, x, y) in the polygon of ``edges`` (x0, y0, x1, y1): an odd number of crossings of the ray eastwards.

    The bounds of the edges are cut into about as many rows as there are edges, so that few edges end in a row, and into columns,
    about the root of that. In a row an edge lies in the cells from ``first`` to ``last``. A point tests the edges of its own cell;
    those that lie wholly to the east of it cross if they span its y: all that span the whole row are known by their number, and
    only the few that end in the row are held against y. Points outside the bounds are not joined."""
    span = edges.agg(F.min(F.least("x0", "x1")).alias("l"), F.max(F.greatest("x0", "x1")).alias("r"), F.min(F.least("y0", "y1")).alias("b"), F.max(F.greatest("y0", "y1")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not span["n"]:
        return points.select("id", F.lit(False).alias("inside"))
    rows, cols = max(least_rows, min(most_rows, span["n"])), max(1, min(1024, round(span["n"] ** 0.5)))
    high, wide = max((span["t"] - span["b"]) / rows, 1e-12), max((span["r"] - span["l"]) / cols, 1e-12)
    slack = F.lit(1e-9 * max(1.0, *(abs(span[c]) for c in "lrbt")))  # more than floats can be off in the steps below
    place = lambda v, origin, step, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - origin) / step))).cast("int")
    row, col = (lambda y: place(y, span["b"], high, rows)), (lambda x: place(x, span["l"], wide, cols))
    low, top = F.least("y0", "y1"), F.greatest("y0", "y1")
    each = edges.where("y0 <> y1").select("x0", "y0", "x1", "y1", low.alias("low"), top.alias("top"), F.explode(F.sequence(row(low), row(top))).alias("row"))
    floor_, ceiling = span["b"] + F.col("row") * high, span["b"] + (F.col("row") + 1) * high
    at = lambda y: F.col("x0") + (F.col("x1") - F.col("x0")) * (F.least(F.greatest(y, "low"), "top") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    a, b = at(floor_ - slack), at(ceiling + slack)
    each = each.select("*", col(F.least(a, b) - slack).alias("first"), col(F.greatest(a, b) + slack).alias("last"))
    close = each.select("row", F.explode(F.sequence("first", "last")).alias("col"), "x0", "y0", "x1", "y1")
    whole = (F.col("low") < floor_ - slack) & (F.col("top") > ceiling + slack)
    spanning = each.where(whole).groupBy("row", "first").agg(F.count(F.lit(1)).alias("n"))
    ending = each.where(~whole).select("row", "first", "low", "top")
    bounds = F.col("x").between(span["l"], span["r"]) & F.col("y").between(span["b"], span["t"])
    spots = points.where(bounds).select("id", "x", "y", row(F.col("y")).alias("row"), col(F.col("x")).alias("col"))
    one = F.lit(1).cast("long").alias("n")
    here = spots.join(close, ["row", "col"]).where(crosses_ray(*(F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")))).select("id", one)
    east = spots.join(spanning, "row").where(F.col("first") > F.col("col")).select("id", "n")
    few = spots.join(ending, "row").where((F.col("first") > F.col("col")) & (F.col("low") <= F.col("y")) & (F.col("top") > F.col("y"))).select("id", one)
    crossed = here.unionByName(east).unionByName(few).groupBy("id").agg((F.sum("n") % 2 == 1).alias("odd"))
    return points.select("id").join(crossed, "id", "left").select("id", F.coalesce("odd", F.lit(False)).alias("inside"))


def boxes_meeting(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``boxes`` (name, l, b, r, t) that meet the polygon of ``edges``: an edge runs through one, or its centre lies inside."""
    widest = boxes.agg(F.max(F.greatest(F.col("r") - F.col("l"), F.col("t") - F.col("b"))).alias("w")).first()["w"]
    if not widest:
        return boxes
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / widest).cast("long"), F.floor(F.col(b) / widest).cast("long")))
    placed = boxes.withColumn("cx", span("l", "r")).withColumn("cy", span("b", "t"))
    met = placed.join(_cells_of(edges.select("x0", "y0", "x1", "y1"), widest), ["cx", "cy"])
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    outer = (F.greatest(x0, x1) >= F.col("l")) & (F.least(x0, x1) <= F.col("r")) & (F.greatest(y0, y1) >= F.col("b")) & (F.least(y0, y1) <= F.col("t"))
    sides = [F.signum((x1 - x0) * (F.col(y) - y0) - (y1 - y0) * (F.col(x) - x0)) for x in ("l", "r") for y in ("b", "t")]
    through = met.where(outer & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)).select("name")
    centres = boxes.select(F.col("name").alias("id"), ((F.col("l") + F.col("r")) / 2).alias("x"), ((F.col("b") + F.col("t")) / 2).alias("y"))
    held = within(centres, edges).where("inside").select(F.col("id").alias("name"))
    return boxes.join(through.unionByName(held).distinct(), "name")


def rasterize(edges: DataFrame, xmin: float, ymax: float, rows: int, cols: int, cell: float) -> DataFrame:
    """(r, c) of the cells whose centres lie inside the polygon."""
    spark = edges.sparkSession
    grid = spark.range(rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1)).cast("array<bigint>")).alias("c"))
    centres = grid.select((F.col("r") * cols + F.col("c")).alias("id"), (xmin + (F.col("c") + 0.5) * cell).alias("x"), (ymax - (F.col("r") + 0.5) * cell).alias("y"))
    inside = within(centres, edges).where("inside")
    return inside.select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))


def unoccupied(cells: DataFrame, points: DataFrame, xmin: float, ymax: float, cell: float) -> DataFrame:
    """``cells`` (r, c, ...) that hold none of ``points`` (x, y). Places are cut towards zero, as whole-number casts do."""
    taken = points.select(((ymax - F.col("y")) / cell).cast("long").alias("r"), ((F.col("x") - xmin) / cell).cast("long").alias("c")).distinct()
    return cells.join(taken, ["r", "c"], "left_anti")


def beyond(points: DataFrame, others: DataFrame, keys: list[str], limit: Column | float) -> DataFrame:
    """``points`` (keys, x, y, ...) that are farther than ``limit`` from all of ``others`` (keys, x, y) with equal keys: an
    anti join on grid cells as wide as the limit, which may be a column that both sides have and that follows from the keys."""
    size = F.greatest(limit if isinstance(limit, Column) else F.lit(float(limit)), F.lit(1e-9))
    near = others.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy"), size.alias("size"))
    near = _cells_around(near, "ox", "oy", F.col("size")).drop("size")
    own = points.withColumn("size", size).withColumn("cx", F.floor(F.col("x") / F.col("size"))).withColumn("cy", F.floor(F.col("y") / F.col("size")))
    same = [own[k].eqNullSafe(near[k]) for k in [*keys, "cx", "cy"]]
    close = F.hypot(own["x"] - near["ox"], own["y"] - near["oy"]) <= own["size"]
    met = same[0]
    for c in same[1:]:
        met = met & c
    return own.join(near, met & close, "left_anti").drop("cx", "cy", "size")
