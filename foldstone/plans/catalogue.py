"""The driver's queries over the fixture views, each beside its SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import columns as C
from foldstone.operators import catalogue, experiment, features, folds, metrics, models, raster, sampling, vector
from foldstone.operators.models import Learner
from foldstone.operators.raster import Grid
from foldstone.plans.views import view, with_views
from foldstone.session import shared_folder, table
from foldstone.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, and its SQL over the named views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


#: The published series in SQL, worked out from the ellipsoid: third flattening n, radius r, eccentricity e, and the coefficients.
_SERIES = """f as (select (1 / 298.257223563e0) / (2 - 1 / 298.257223563e0) n),
 k as (select n, 0.9996e0 * 6378137e0 / (1 + n) * (1 + n*n/4 + pow(n,4)/64 + pow(n,6)/256) r, 2 * sqrt(n) / (1 + n) e,
 [n/2 - 2*n*n/3 + 5*pow(n,3)/16 + 41*pow(n,4)/180, 13*n*n/48 - 3*pow(n,3)/5 + 557*pow(n,4)/1440, 61*pow(n,3)/240 - 103*pow(n,4)/140, 49561*pow(n,4)/161280] al,
 [n/2 - 2*n*n/3 + 37*pow(n,3)/96 - pow(n,4)/360, n*n/48 + pow(n,3)/15 - 437*pow(n,4)/1440, 17*pow(n,3)/480 - 37*pow(n,4)/840, 4397*pow(n,4)/161280] be,
 [2*n - 2*n*n/3 - 2*pow(n,3) + 116*pow(n,4)/45, 7*n*n/3 - 8*pow(n,3)/5 - 227*pow(n,4)/45, 56*pow(n,3)/15 - 136*pow(n,4)/35, 4279*pow(n,4)/630] de from f)"""
_SUM = lambda of: f"list_sum(list_transform(range(1, 5), lambda j: {of}))"


# --- Rasters ------------------------------------------------------------------------------------------------------

_GRADIENT = """g as (select r, c, v, lag(v) over (partition by r order by c) w, lead(v) over (partition by r order by c) e, lag(v) over (partition by c order by r) n, lead(v) over (partition by c order by r) s from v_dem),
 d as (select *, (coalesce(e, v) - coalesce(w, v)) / (case when e is not null and w is not null then 60e0 else 30e0 end) ge, (coalesce(n, v) - coalesce(s, v)) / (case when n is not null and s is not null then 60e0 else 30e0 end) gn from g)"""
_ASPECT = "case when sqrt(ge * ge + gn * gn) >= 1e-9 then (case when degrees(atan2(-ge, -gn)) < 0 then degrees(atan2(-ge, -gn)) + 360 else degrees(atan2(-ge, -gn)) end) end"


@query(f"with {_GRADIENT} select r, c, round(degrees(atan(sqrt(ge * ge + gn * gn))), 6) slope, round({_ASPECT}, 6) aspect from d", "v_dem")
def terrain_slope_aspect(spark, sf_dir):
    return raster.terrain(view(spark, sf_dir, "v_dem")).select("r", "c", r("slope"), r("aspect"))


@query(f"with {_GRADIENT} select r, c, round((coalesce(w, v) + coalesce(e, v) + coalesce(n, v) + coalesce(s, v) - 4 * v) / 900e0, 6) curvature from d", "v_dem")
def terrain_curvature(spark, sf_dir):
    return raster.terrain(view(spark, sf_dir, "v_dem")).select("r", "c", r("curvature"))


@query(f"with {_GRADIENT}, a as (select r, c, {_ASPECT} a from d) select r, c, round(sin(radians(a)), 6) aspect_sin, round(cos(radians(a)), 6) aspect_cos from a", "v_dem")
def aspect_sin_cos(spark, sf_dir):
    return raster.terrain(view(spark, sf_dir, "v_dem")).select("r", "c", r("aspect_sin"), r("aspect_cos"))


@query(
    """with p as (select id, cast(floor(prow) as bigint) r, cast(floor(pcol) as bigint) c from v_zpts),
 m as (select id, v_dem.r - p.r dr, v_dem.c - p.c dc, v from p join v_dem on abs(v_dem.r - p.r) <= 2 and abs(v_dem.c - p.c) <= 2),
 k as (select id, max(v) filter (dr = 0 and dc = 0) z, max(v) filter (dr = 0 and dc = 1) e, max(v) filter (dr = 0 and dc = -1) w, max(v) filter (dr = -1 and dc = 0) n, max(v) filter (dr = 1 and dc = 0) s from m where v is not null group by id having count(*) = 25),
 g as (select *, (e - w) / 60e0 ge, (n - s) / 60e0 gn from k),
 a as (select *, case when sqrt(ge * ge + gn * gn) >= 1e-9 then atan2(-ge, -gn) end a from g)
 select p.id, round(z, 6) elevation, round(degrees(atan(sqrt(ge * ge + gn * gn))), 6) slope, round(case when z is not null then coalesce(sin(a), 0) end, 6) aspect_sin, round(case when z is not null then coalesce(cos(a), 0) end, 6) aspect_cos, round((w + e + n + s - 4 * z) / 900e0, 6) curvature from p left join a on a.id = p.id""",
    "v_dem", "v_zpts",
)
def terrain_at_points(spark, sf_dir):
    points = view(spark, sf_dir, "v_zpts").select("id", F.floor("prow").alias("r"), F.floor("pcol").alias("c"))
    found = raster.terrain_at(view(spark, sf_dir, "v_dem"), points)
    return found.select("id", *[r(c) for c in ("elevation", "slope", "aspect_sin", "aspect_cos", "curvature")])


@query("with y as (select yr, r, c, sum(v) v from v_stack group by 1, 2, 3) select r, c, round(avg(v), 4) mean from y group by 1, 2", "v_stack")
def stack_mean_annual(spark, sf_dir):
    yearly = view(spark, sf_dir, "v_stack").groupBy("yr", "r", "c").agg(F.sum("v").alias("v"))
    return raster.stack_mean(yearly).select("r", "c", r("mean", 4))


@query("select p.id, d.v from v_zpts p left join v_dem d on d.r = cast(floor(prow) as bigint) and d.c = cast(floor(pcol) as bigint)", "v_dem", "v_zpts")
def sample_raster_points(spark, sf_dir):
    return raster.sample(view(spark, sf_dir, "v_dem"), view(spark, sf_dir, "v_zpts"))


@query(
    "with m as (select p.id, code from v_zpts p join v_cover k on (k.r + 0.5e0 - prow) * (k.r + 0.5e0 - prow) + (k.c + 0.5e0 - pcol) * (k.c + 0.5e0 - pcol) <= 6.25e0 where code > 0), s as (select id, count(*) n, "
    + ", ".join(f"count(*) filter (code in ({', '.join(map(str, codes))})) {g}" for g, codes in C.COVER_GROUPS.items())
    + " from m group by id) select p.id, "
    + ", ".join(f"round({g} / cast(n as double), 6) {g}" for g in C.COVER_GROUPS)
    + " from v_zpts p left join s on s.id = p.id",
    "v_cover", "v_zpts",
)
def landcover_shares(spark, sf_dir):
    return raster.class_shares(view(spark, sf_dir, "v_cover"), view(spark, sf_dir, "v_zpts"), 2.5).select("id", *[r(g) for g in C.COVER_GROUPS])


_TARGETS = "(select (g // 30)::bigint r, (g % 30)::bigint c, 300000e0 + (g % 30) * 7000 x, 3250000e0 - (g // 30) * 9000 y from (select unnest(range(900)) g) t)"


def _tiles(spark, sf_dir) -> dict[str, tuple[DataFrame, Grid]]:
    """Two tiles side by side, the second a little over the first, with gaps."""
    dem = view(spark, sf_dir, "v_dem").withColumn("v", F.when((F.col("r") + F.col("c")) % 13 != 0, F.col("v")))
    other = dem.withColumn("v", F.col("v") + 5000)
    return {"a": (dem, Grid(85.0, 29.3, 0.05, 0.05, 50, 20)), "b": (other, Grid(85.9, 29.3, 0.05, 0.05, 50, 20))}


@query(
    f"""with {_SERIES.replace('f as', 'ser as').replace('from f)', 'from ser)')}, t0 as (select * from {_TARGETS}),
 a as (select t0.r rr, t0.c cc, y / k.r xi, (x - 500000e0) / k.r eta, be, de from t0 cross join k),
 b as (select *, xi - {_SUM('be[j] * sin(2 * j * xi) * cosh(2 * j * eta)')} xi1, eta - {_SUM('be[j] * cos(2 * j * xi) * sinh(2 * j * eta)')} eta1 from a),
 g as (select *, asin(sin(xi1) / cosh(eta1)) chi from b),
 ll as (select rr, cc, 87e0 + degrees(atan2(sinh(eta1), cos(xi1))) lon, degrees(chi + {_SUM('de[j] * sin(2 * j * chi)')}) lat from g),
 px as (select 0 tile, 85e0 x0, r, c, v from v_dem where (r + c) % 13 <> 0 and r < 50 union all select 1, 85.9e0, r, c, v + 5000 from v_dem where (r + c) % 13 <> 0 and r < 50),
 spot as (select rr, cc, tile, (29.3e0 - lat) / 0.05e0 fr, (lon - x0) / 0.05e0 fc from ll cross join (values (0, 85e0), (1, 85.9e0)) t(tile, x0)),
 m as (select rr, cc, spot.tile, sum(v * greatest(0, 1 - abs(fr - 0.5 - px.r)) * greatest(0, 1 - abs(fc - 0.5 - px.c))) / sum(greatest(0, 1 - abs(fr - 0.5 - px.r)) * greatest(0, 1 - abs(fc - 0.5 - px.c))) v
  from spot join px on px.tile = spot.tile and abs(fr - 0.5 - px.r) < 1 and abs(fc - 0.5 - px.c) < 1 where fr >= 0 and fr < 50 and fc >= 0 and fc < 20 group by 1, 2, 3),
 o as (select rr, cc, max_by(v, tile) v from m group by 1, 2)
 select t0.r, t0.c, round(v, 4) v from t0 left join o on o.rr = t0.r and o.cc = t0.c""",
    "v_dem",
)
def bilinear_mosaic(spark, sf_dir):
    cells = spark.range(900).selectExpr("id div 30 r", "id % 30 c", "300000e0 + (id % 30) * 7000 x", "3250000e0 - (id div 30) * 9000 y")
    tiles = {name: (tile.where("r < 50"), grid) for name, (tile, grid) in _tiles(spark, sf_dir).items()}
    return raster.mosaic(tiles, cells).select("r", "c", r("v", 4))


@query("select r - 2 r, c - 3 c, round(avg(v), 4) v from (select yr, r, c, sum(v) v from v_stack where yr < 1998 group by 1, 2, 3) t where r between 2 and 6 and c between 3 and 12 group by 1, 2", "v_stack")
def annual_mean_in_window(spark, sf_dir):
    """Three yearly layers on one grid of quarter degrees, cut to bounds."""
    stack = view(spark, sf_dir, "v_stack").where("yr < 1998")
    layers = {str(y): (stack.where(F.col("yr") == y).groupBy("r", "c").agg(F.sum("v").alias("v")), Grid(80.0, 31.0, 0.25, 0.25, 10_000, 20)) for y in (1995, 1996, 1997)}
    mean, _ = raster.annual_mean(layers, (80.75, 29.25, 83.25, 30.5))
    return mean.select("r", "c", r("v", 4))


_COVER_SQL = f"""cover as (select r + 148 r, c + 650 c, code from v_cover where code > 0),
 circle as (select p.id, code from v_pts p join cover k on pow((k.r + 0.5e0 - (90 - lat) / 0.4e0) * (0.4e0 * 111320), 2) + pow((k.c + 0.5e0 - (lon + 180) / 0.4e0) * (0.4e0 * 111320 * cos(radians(lat))), 2) <= pow(60000e0, 2)),
 counted as (select id, count(*) n, {", ".join(f"count(*) filter (code in ({', '.join(map(str, codes))})) {g}" for g, codes in C.COVER_GROUPS.items())} from circle group by id)"""


def _cover_tiles(spark, sf_dir) -> dict[str, tuple[DataFrame, Grid]]:
    return {"tile": (view(spark, sf_dir, "v_cover").select("r", "c", F.col("code").alias("v")), Grid(80.0, 30.8, 0.4, 0.4, 10_000, 20))}


@query(f"with {_COVER_SQL} select p.id, " + ", ".join(f"round({g} / n::double, 6) {g}" for g in C.COVER_GROUPS) + " from v_pts p left join counted s on s.id = p.id", "v_cover", "v_pts")
def cover_in_metric_circles(spark, sf_dir):
    found = raster.cover_shares(_cover_tiles(spark, sf_dir), view(spark, sf_dir, "v_pts").select("id", "lon", "lat"), 60.0)
    return found.select("id", *[r(g) for g in C.COVER_GROUPS])


# --- Vectors ------------------------------------------------------------------------------------------------------

_FORWARD = f"""with {_SERIES}, a as (select id, radians(lat) phi, radians(lon - 87e0) lam, k.* from v_pts cross join k),
 b as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) t from a), c as (select *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta from b)
 select id, round(500000e0 + r * (eta + {_SUM('al[j] * cos(2 * j * xi) * sinh(2 * j * eta)')}), 3) x, round(r * (xi + {_SUM('al[j] * sin(2 * j * xi) * cosh(2 * j * eta)')}), 3) y from c"""
_BACKWARD = f"""with {_SERIES}, a as (select id, (2900000e0 + y) / r xi, (x - 500000e0) / r eta, k.* from v_pts cross join k),
 b as (select *, xi - {_SUM('be[j] * sin(2 * j * xi) * cosh(2 * j * eta)')} xi1, eta - {_SUM('be[j] * cos(2 * j * xi) * sinh(2 * j * eta)')} eta1 from a),
 c as (select *, asin(sin(xi1) / cosh(eta1)) chi from b)
 select id, round(87e0 + degrees(atan2(sinh(eta1), cos(xi1))), 8) lon, round(degrees(chi + {_SUM('de[j] * sin(2 * j * chi)')}), 8) lat from c"""


@query(_FORWARD, "v_pts")
def utm_forward(spark, sf_dir):
    x, y = C.utm_forward(F.col("lon"), F.col("lat"))
    return view(spark, sf_dir, "v_pts").select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(_BACKWARD, "v_pts")
def utm_inverse(spark, sf_dir):
    lon, lat = C.utm_inverse(F.col("x"), F.col("y") + 2900000.0)
    return view(spark, sf_dir, "v_pts").select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


_DIST = """(select p.id, min(sqrt(power(p.x - (x0 + t * (x1 - x0)), 2) + power(p.y - (y0 + t * (y1 - y0)), 2))) d from (
 select p.id, p.x, p.y, s.*, case when (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) > 0 then greatest(0e0, least(1e0, ((p.x-x0)*(x1-x0)+(p.y-y0)*(y1-y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) else 0e0 end t from v_pts p cross join v_seg s) p group by 1)"""
_BIN = "len(list_filter([" + ", ".join(f"{e}::double" for e in C.INNER_EDGES_KM) + "], lambda e: e <= km))"


def _line_km(spark, sf_dir) -> DataFrame:
    found = vector.nearest_line(view(spark, sf_dir, "v_pts"), view(spark, sf_dir, "v_seg"), 4000.0)
    return found.select("id", (F.col("distance") / 1000.0).alias("km"))


@query(f"select id, round(d / 1000e0, 6) km from {_DIST}", "v_pts", "v_seg")
def nearest_line_distance(spark, sf_dir):
    return _line_km(spark, sf_dir).select("id", r("km"))


_INSIDE = "(select p.id, count(i) % 2 = 1 inside from v_pts p left join v_ring e on (e.y0 > p.y) <> (e.y1 > p.y) and p.x < (e.x1 - e.x0) * (p.y - e.y0) / (e.y1 - e.y0) + e.x0 group by p.id)"


@query(f"select id, inside from {_INSIDE}", "v_pts", "v_ring")
def point_in_polygon(spark, sf_dir):
    return vector.within(view(spark, sf_dir, "v_pts"), view(spark, sf_dir, "v_ring"))


@query("with g as (select r, c, (c + 0.5e0) * 5000 x, 200000 - (r + 0.5e0) * 5000 y from (select unnest(range(40)) r) a cross join (select unnest(range(80)) c) b), h as (select r, c, count(i) n from g left join v_ring e on (e.y0 > g.y) <> (e.y1 > g.y) and g.x < (e.x1 - e.x0) * (g.y - e.y0) / (e.y1 - e.y0) + e.x0 group by r, c) select r, c from h where n % 2 = 1", "v_ring")
def rasterize_polygon(spark, sf_dir):
    return vector.rasterize(view(spark, sf_dir, "v_ring"), 0.0, 200000.0, 40, 80, 5000.0)


@query("select id, r, c from v_cells where valid and not exists (select 1 from v_pts where label = 1 and cast(trunc((v_pts.y) / 2000e0) as bigint) = v_cells.r and cast(trunc(v_pts.x / 20000e0) as bigint) = v_cells.c)", "v_cells", "v_pts")
def occupied_cell_exclusion(spark, sf_dir):
    events = view(spark, sf_dir, "v_pts").where("label = 1").select((F.col("x") / 10).alias("x"), (-F.col("y")).alias("y"))
    cells = view(spark, sf_dir, "v_cells").where("valid").select("id", "r", "c")
    return vector.unoccupied(cells, events, 0.0, 0.0, 2000.0).select("id", "r", "c")


_HALVES = "select way_id, kind, x0, y0, (x0 + x1) / 2 x1, (y0 + y1) / 2 y1 from v_seg union all select way_id, kind, (x0 + x1) / 2, (y0 + y1) / 2, x1, y1 from v_seg"


def _ways(spark, sf_dir) -> DataFrame:
    """Lines as an extract has them: tags, and three nodes each."""
    tag = F.when(F.col("kind") == "river", "waterway").otherwise("highway")
    node = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    nodes = F.array(node("x0", "y0"), node("(x0 + x1) / 2", "(y0 + y1) / 2"), node("x1", "y1"))
    return view(spark, sf_dir, "v_seg").select("way_id", F.create_map(tag, F.col("kind"), F.lit("name"), F.lit("line")).alias("tags"), nodes.alias("nodes"))


@query(f"select * from ({_HALVES}) t where kind in ('primary', 'residential')", "v_seg")
def road_extract(spark, sf_dir):
    return files.segments_of(files.ways_of(_ways(spark, sf_dir), "highway", C.MOTOR_CLASSES))


@query(f"select * from ({_HALVES}) t where kind = 'river'", "v_seg")
def river_extract(spark, sf_dir):
    return files.segments_of(files.ways_of(_ways(spark, sf_dir), "waterway", C.RIVER_CLASSES))


@query("select cast(floor((min(x) - 1000) / 30) * 30 as double) xmin, cast(floor((min(y) - 1000) / 30) * 30 as double) ymin, cast(ceil((max(x) + 1000) / 30) * 30 as double) xmax, cast(ceil((max(y) + 1000) / 30) * 30 as double) ymax from v_pts", "v_pts")
def padded_bounds(spark, sf_dir):
    low = lambda c: (F.floor((F.min(c) - 1000) / 30) * 30).cast("double")
    high = lambda c: (F.ceil((F.max(c) + 1000) / 30) * 30).cast("double")
    return view(spark, sf_dir, "v_pts").agg(low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"))


@query("select floor((50000e0 - 1000) / 30) * 30 x0, ceil((180000e0 + 1000) / 30) * 30 y0, cast((ceil((180000e0 + 1000) / 30) - floor((20000e0 - 1000) / 30)) as bigint) height, cast((ceil((350000e0 + 1000) / 30) - floor((50000e0 - 1000) / 30)) as bigint) width, cast(ceil((ceil((180000e0 + 1000) / 30) - floor((20000e0 - 1000) / 30)) / 10) as bigint) coarse_height, cast(ceil((ceil((350000e0 + 1000) / 30) - floor((50000e0 - 1000) / 30)) / 10) as bigint) coarse_width")
def boundary_grid(spark, sf_dir):
    """The grid around the boundary, with its margin, and the shape of the coarser one over it."""
    grid = features.boundary_grid(view(spark, sf_dir, "v_ring"))
    coarse = raster.coarser(grid, 300.0)
    return spark.createDataFrame([(grid.x0, grid.y0, grid.height, grid.width, coarse.height, coarse.width)], "x0 double, y0 double, height bigint, width bigint, coarse_height bigint, coarse_width bigint")


@query(
    "with b as (select p_partkey name, (p_partkey * 7919 % 400) * 1000e0 + 370 l, (p_partkey * 104729 % 200) * 1000e0 + 410 b from part), c as (select name, l, b, l + 9000 r, b + 7000 t from b),"
    " g as (select name, l + (r - l) * i / 60 x, b + (t - b) * j / 60 y from c cross join (select unnest(range(61)) i) u cross join (select unnest(range(61)) j) v where i in (0, 60) or j in (0, 60)),"
    " h as (select name, x, y, count(e.i) % 2 = 1 inside from g left join v_ring e on (e.y0 > y) <> (e.y1 > y) and x < (e.x1 - e.x0) * (y - e.y0) / (e.y1 - e.y0) + e.x0 group by name, x, y),"
    " k as (select name from h where inside union select name from c join v_ring e on e.x0 between l and r and e.y0 between b and t) select distinct name from k",
    "v_ring",
)
def boxes_at_boundary(spark, sf_dir):
    """Boxes that meet the polygon. The SQL looks for a place of their rims inside it, or a corner of it inside them."""
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey name", "(p_partkey * 7919 % 400) * 1000e0 + 370 l", "(p_partkey * 104729 % 200) * 1000e0 + 410 b").selectExpr("name", "l", "b", "l + 9000 r", "b + 7000 t")
    return vector.boxes_meeting(boxes, view(spark, sf_dir, "v_ring")).select("name")


@query(f"with {_SERIES}, s as (select i, 80 + x0 / 50000 lon, 26 + y0 / 50000 lat from v_ring), a as (select i, radians(lat) phi, radians(lon - 87e0) lam, k.* from s cross join k), b as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) t from a), c as (select *, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta from b) select i, round(500000e0 + r * (eta + {_SUM('al[j] * cos(2 * j * xi) * sinh(2 * j * eta)')}), 3) x, round(r * (xi + {_SUM('al[j] * sin(2 * j * xi) * cosh(2 * j * eta)')}), 3) y from c", "v_ring")
def projected_boundary(spark, sf_dir):
    """The boundary through a GeoJSON file in the shared folder, in degrees there, projected when read."""
    points = [[80 + x / 50000, 26 + y / 50000] for x, y in ((50000, 20000), (350000, 20000), (350000, 180000), (200000, 90000), (50000, 180000), (50000, 20000))]
    path = f"{shared_folder(spark)}/boundary-{uuid.uuid4().hex}"
    document = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [points]}}]})
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    edges = files.projected(files.ring_edges(spark, path))
    return edges.select((F.col("i") - 1).cast("int").alias("i"), F.round("x0", 3).alias("x"), F.round("y0", 3).alias("y"))


# --- Sampling -----------------------------------------------------------------------------------------------------

@query(
    f"with k as (select d / 1000e0 km from {_DIST}), b as (select {_BIN} bin, count(*) n from k group by 1), t as (select unnest(range(10)) bin), f as (select t.bin, coalesce(n, 0) n from t left join b on b.bin = t.bin) select cast(bin as integer) bin, cast(n as bigint) n, round_even(n / cast(sum(n) over () as double), 3) share from f",
    "v_pts", "v_seg",
)
def distance_bin_shares(spark, sf_dir):
    return sampling.bin_shares(_line_km(spark, sf_dir).select("km"))


@query(
    f"with k as (select d.id, label, accuracy_km, {_BIN} bin from (select id, d / 1000e0 km from {_DIST}) d join v_pts p on p.id = d.id), b as (select bin, count(*) filter (label = 0) nb, count(*) filter (label = 1 and accuracy_km <= 5) np from k group by 1), w as (select bin, case when nb = 0 then 0 else (np / cast(sum(np) over () as double)) / (nb / cast(sum(nb) over () as double)) end w from b) select k.id, cast(k.bin as integer) bin, round(w, 6) weight from k join w on w.bin = k.bin where label = 0",
    "v_pts", "v_seg",
)
def presence_matched_weights(spark, sf_dir):
    points = view(spark, sf_dir, "v_pts").select("id", "label", "accuracy_km").join(_line_km(spark, sf_dir), "id")
    found = sampling.matched_weights(points.where("label = 0").select("id", "km"), points.where("label = 1 and accuracy_km <= 5").select("km"))
    return found.select("id", "bin", r("weight"))


_U = lambda seed, key: f"((('0x' || substr(md5({seed} || '|' || cast({key} as varchar)), 1, 13))::bigint + 1) / 4503599627370497e0)"


@query(f"select id, r, c from v_cells where valid order by {_U(repr('0'), 'id')}, id limit 50", "v_cells")
def sample_uniform(spark, sf_dir):
    return sampling.sample_cells(view(spark, sf_dir, "v_cells").where("valid"), 50, 0).select("id", "r", "c")


@query(f"select id, w from v_cells where valid and w > 0 order by -ln({_U(repr('1'), 'id')}) / w, id limit 50", "v_cells")
def sample_weighted(spark, sf_dir):
    return sampling.sample_cells(view(spark, sf_dir, "v_cells").where("valid"), 50, 1, "w").select("id", "w")


@query(
    f"""with e as (select draw, id, w from v_cells cross join (select unnest(range(4)) draw) t where valid),
 a as (select draw, 'uniform' scheme, id, {_U("cast(2 * draw as varchar)", 'id')} k from e union all select draw, 'road_weighted', id, -ln({_U("cast(2 * draw + 1 as varchar)", 'id')}) / w from e where w > 0)
 select draw, scheme, id from (select *, row_number() over (partition by draw, scheme order by k, id) rn from a) t where rn <= 30""",
    "v_cells",
)
def repeated_draws(spark, sf_dir):
    return sampling.repeated_draws(view(spark, sf_dir, "v_cells").where("valid"), 4, 30)


# --- Folds --------------------------------------------------------------------------------------------------------

@query("select id, dense_rank() over (order by floor(x / 50000e0), floor(y / 50000e0)) - 1 block from v_pts", "v_pts")
def block_ids(spark, sf_dir):
    return folds.block_ids(view(spark, sf_dir, "v_pts"), 50000.0).select("id", F.col("block").cast("bigint").alias("block"))


_FOLD = f"""b as (select distinct cast(floor(x / 50000e0) as bigint) ix, cast(floor(y / 50000e0) as bigint) iy from v_pts),
 o as (select ix, iy, (row_number() over (order by {_U(repr('0'), "concat(ix, ':', iy)")}, ix, iy) - 1) % 5 fold from b),
 q as (select p.*, cast(fold as integer) fold from v_pts p join o on ix = floor(x / 50000e0) and iy = floor(y / 50000e0))"""


@query(f"with {_FOLD} select id, fold from q", "v_pts")
def spatial_block_kfold(spark, sf_dir):
    return folds.spatial_folds(view(spark, sf_dir, "v_pts"), 50000.0).select("id", "fold")


@query(
    f"with {_FOLD}, f as (select cast(unnest(range(5)) as integer) test_fold), k as (select test_fold, q.id, q.label from q join f on fold <> test_fold where not exists (select 1 from q t where t.fold = test_fold and sqrt((t.x - q.x) * (t.x - q.x) + (t.y - q.y) * (t.y - q.y)) <= 3000e0)) select test_fold, count(*) train, cast(sum(label) as bigint) presences from k group by 1",
    "v_pts",
)
def buffered_train_counts(spark, sf_dir):
    points = folds.spatial_folds(view(spark, sf_dir, "v_pts"), 50000.0)
    return folds.buffered_training(points, 5, 3000.0).groupBy("test_fold").agg(F.count(F.lit(1)).alias("train"), F.sum("label").cast("bigint").alias("presences"))


@query(f"select id, label, cast((row_number() over (partition by label order by {_U(repr('0'), 'id')}, id) - 1) % 5 as integer) fold from v_pts", "v_pts")
def stratified_kfold(spark, sf_dir):
    return folds.stratified_folds(view(spark, sf_dir, "v_pts")).select("id", "label", "fold")


@query(f"with {_FOLD} select fold, label, count(*) n, round(sum(count(*)) over (partition by fold) / cast(2 * count(*) as double), 6) weight from q group by fold, label", "v_pts")
def balanced_class_weights(spark, sf_dir):
    return folds.balanced_weights(folds.spatial_folds(view(spark, sf_dir, "v_pts"), 50000.0), ["fold"]).select("fold", "label", "n", r("weight"))


@query(f"with {_FOLD}, f as (select cast(unnest(range(5)) as integer) test_fold), s as (select distinct test_fold, floor(x / 50000e0) bx, floor(y / 50000e0) bz, fold = test_fold held from q cross join f) select test_fold, cast(0 as bigint) shared, count(*) filter (held) held from s group by 1", "v_pts")
def blocks_kept_whole(spark, sf_dir):
    """Blocks of each test fold, and how many of them are among its training rows' blocks as well: none."""
    points = folds.spatial_folds(view(spark, sf_dir, "v_pts"), 50000.0)
    block = [F.floor(F.col(c) / 50000.0).alias(f"b{c}") for c in "xy"]
    test = points.select(F.col("fold").alias("test_fold"), *block)
    both = test.intersect(folds.buffered_training(points, 5, 0.0).select("test_fold", *block))
    shared = both.groupBy("test_fold").agg(F.count(F.lit(1)).alias("shared"))
    return test.distinct().groupBy("test_fold").agg(F.count(F.lit(1)).alias("held")).join(shared, "test_fold", "left").select("test_fold", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), "held")


# --- Metrics ------------------------------------------------------------------------------------------------------

_RANK = "k as (select *, rank() over (partition by sfold order by score) + (count(*) over (partition by sfold, score) - 1) / 2e0 rk from v_scored)"


@query(f"with {_RANK} select sfold, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)), 9) auroc from k group by sfold having min(y) <> max(y)", "v_scored")
def auroc_by_fold(spark, sf_dir):
    return metrics.auroc(view(spark, sf_dir, "v_scored"), ["sfold"]).select("sfold", r("auroc", 9))


_AP = """t as (select kind, fold, score, sum(y) tp, count(*) n from z group by 1, 2, 3),
 u as (select *, sum(tp) over (partition by kind, fold order by score desc) ctp, sum(n) over (partition by kind, fold order by score desc) cn from t),
 ap as (select kind, fold, sum(tp * ctp / cast(cn as double)) / sum(tp) ap from u group by 1, 2)"""


@query(f"with z as (select 's' kind, sfold fold, y, score from v_scored), {_AP} select fold sfold, round(ap, 9) ap from ap", "v_scored")
def average_precision_by_fold(spark, sf_dir):
    return metrics.average_precision(view(spark, sf_dir, "v_scored"), ["sfold"]).select("sfold", r("ap", 9))


def _compared(spark, sf_dir) -> DataFrame:
    scored = view(spark, sf_dir, "v_scored")
    both = scored.select(F.lit("random").alias("kind"), F.col("rfold").alias("fold"), "y", "score").unionByName(scored.select(F.lit("spatial").alias("kind"), F.col("sfold").alias("fold"), "y", "score"))
    return metrics.compare(both)


@query(
    f"""with z as (select 'random' kind, rfold fold, y, score from v_scored union all select 'spatial', sfold, y, score from v_scored), {_AP},
 k as (select *, rank() over (partition by kind, fold order by score) + (count(*) over (partition by kind, fold, score) - 1) / 2e0 rk from z),
 a as (select kind, fold, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)) auroc from k group by 1, 2 having min(y) <> max(y)),
 m as (select a.kind, avg(auroc) am, stddev_pop(auroc) sd, avg(ap) pm, count(*) n from a join ap on ap.kind = a.kind and ap.fold = a.fold group by 1)
 select round(r.am, 9) random_auroc_mean, round(r.sd, 9) random_auroc_std, round(r.pm, 9) random_pr_auc_mean, r.n random_folds, round(s.am, 9) spatial_auroc_mean, round(s.sd, 9) spatial_auroc_std, round(s.pm, 9) spatial_pr_auc_mean, s.n spatial_folds, round(r.am - s.am, 9) auroc_gap from m r, m s where r.kind = 'random' and s.kind = 'spatial'""",
    "v_scored",
)
def compare_cv_gap(spark, sf_dir):
    found = _compared(spark, sf_dir)
    return found.select(*[c if c.endswith("folds") else r(c, 9) for c in found.columns])


@query("with n as (select p.abs_set, p.id, min(sqrt(power(p.x - o.x, 2) + power(p.y - o.y, 2))) d from v_pts p join v_pts o on p.abs_set = o.abs_set and p.id <> o.id group by 1, 2) select abs_set, count(*) n, round(quantile_cont(d, 0.1) / 1000e0, 6) p10, round(quantile_cont(d, 0.5) / 1000e0, 6) p50, round(quantile_cont(d, 0.9) / 1000e0, 6) p90 from n group by 1", "v_pts")
def nn_percentiles(spark, sf_dir):
    points = view(spark, sf_dir, "v_pts")
    near = vector.nearest_other(points, "abs_set", 4000.0).join(points.select("id", "abs_set"), "id").where("distance is not null")
    p = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = near.groupBy("abs_set").agg(F.count(F.lit(1)).alias("n"), p.alias("p"))
    return found.select("abs_set", "n", *[F.round(F.col("p")[i] / 1000.0, 6).alias(f"p{q}") for i, q in enumerate((10, 50, 90))])


# --- Catalogue ----------------------------------------------------------------------------------------------------

_CLEAN = "(select event_id, o_custkey, case when try_cast(event_date as double) is not null then make_timestamp(cast(try_cast(event_date as double) as bigint) * 1000) else try_strptime(event_date, '%Y-%m-%d') end ts, case location_accuracy when 'exact' then 0e0 when '1km' then 1e0 when '5km' then 5e0 when '10km' then 10e0 when '25km' then 25e0 when '50km' then 50e0 end accuracy_km from v_catalogue where lower(trim(country_name)) = 'asia')"


def _cleaned(spark, sf_dir) -> DataFrame:
    return catalogue.clean_catalogue(view(spark, sf_dir, "v_catalogue"), "asia", ("o_custkey",))


@query(f"select event_id, cast(epoch_ms(ts) as bigint) event_ms, accuracy_km from {_CLEAN}", "v_catalogue")
def catalogue_clean(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("event_id", F.unix_millis("event_time").alias("event_ms"), "accuracy_km")


@query(
    """select c_custkey::varchar event_id, (1000 * (800000000 + c_custkey))::varchar event_date, (c_custkey % 90)::double longitude, (c_custkey % 45)::double latitude, '5km' location_accuracy,
 'Nepal' country_name, case when c_custkey % 3 = 0 then 'import' end event_import_source, c_name source_name, null::varchar source_link from customer where c_custkey % 5 not in (1, 2, 3) and c_custkey % 7 <> 0"""
)
def json_adapter(spark, sf_dir):
    """Features of a service, some without places, with one coordinate or without properties, two hundred a page."""
    feature = """concat('{', case c_custkey % 5 when 1 then '"geometry":{"coordinates":[]}' when 2 then '"geometry":{"coordinates":[1]}' when 3 then '"geometry":null'
 else concat('"geometry":{"type":"Point","coordinates":[', c_custkey % 90, ',', c_custkey % 45, ']}') end,
 ',"properties":{"event_id":', c_custkey, ',"event_date":', 1000 * (800000000 + c_custkey), ',"location_accuracy":"5km",', case when c_custkey % 3 = 0 then '"event_import_source":"import",' else '' end, '"source_name":"', c_name, '"}}')"""
    page = F.concat(F.lit('{"features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}"))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    pages = customers.select(F.floor(F.col("c_custkey") / 200).alias("page"), F.expr(feature).alias("feature")).groupBy("page").agg(page.alias("payload"))
    return files.feature_rows(pages, "Nepal")


@query("select o_custkey, event_id, country_name, location_accuracy from (select *, row_number() over (partition by o_custkey order by event_id) rn from v_catalogue) t where rn = 1", "v_catalogue")
def dedupe_keep_first(spark, sf_dir):
    rows = view(spark, sf_dir, "v_catalogue").select("o_custkey", "event_id", "country_name", "location_accuracy")
    return catalogue.keep_first(rows, ["o_custkey"], ["event_id"])


@query(f"select count(*) before, count(*) filter (ts is not null and accuracy_km is not null and event_id % 11 <> 0) after, count(*) filter (ts is null or accuracy_km is null or event_id % 11 = 0) dropped from {_CLEAN}", "v_catalogue")
def dropna_accounting(spark, sf_dir):
    """Some accuracies are not a number, which counts as missing."""
    rows = _cleaned(spark, sf_dir).withColumn("accuracy_km", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("accuracy_km")))
    return catalogue.row_account(rows, ["event_time", "accuracy_km"])


@query(f"select event_id, accuracy_km from {_CLEAN} where ts is not null and accuracy_km is not null and event_id % 11 <> 0", "v_catalogue")
def dropna_rows(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).withColumn("accuracy_km", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("accuracy_km")))
    return catalogue.complete(rows, ["event_time", "accuracy_km"]).select("event_id", "accuracy_km")


@query("select id, label, abs_set, accuracy_km from v_pts where (label = 1 and accuracy_km <= 5) or abs_set = 'uniform'", "v_pts")
def cutoff_scheme_filter(spark, sf_dir):
    return catalogue.one_scheme(view(spark, sf_dir, "v_pts"), "uniform", 5.0).select("id", "label", "abs_set", "accuracy_km")


@query("select abs_set, round(median(f1), 6) median, round(avg(f1), 6) mean, count(*) n from v_pts group by 1", "v_pts")
def set_summary_medians(spark, sf_dir):
    return catalogue.set_summary(view(spark, sf_dir, "v_pts"), "abs_set", "f1").select("abs_set", r("median"), r("mean"), "n")


@query("select abs_set, cast(sum(label) as bigint) n_pres, cast(sum(1 - label) as bigint) n_abs from v_pts group by 1", "v_pts")
def conditional_counts(spark, sf_dir):
    return view(spark, sf_dir, "v_pts").groupBy("abs_set").agg(F.sum("label").alias("n_pres"), F.sum(1 - F.col("label")).alias("n_abs"))


@query("select yr, count(*) n from v_stack where yr between 1995 and 2001 group by 1", "v_stack")
def year_completeness(spark, sf_dir):
    """Counts by year, once the years have passed the gate that wants each from 1995 to 2001."""
    stack = view(spark, sf_dir, "v_stack")
    files.require_years([r["yr"] for r in stack.select("yr").distinct().collect()], 1995, 2001)
    return stack.groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(name)")
def file_listing(spark, sf_dir):
    found = [p.rsplit("/", 1)[1].removesuffix(".parquet") for p in files.list_files(spark, f"{sf_dir}/*.parquet")]
    files.require_count(found, 14, "tables")
    return spark.createDataFrame([(n,) for n in found], "name string")


@query("select r_name region, cast(count(*) as bigint) nations, cast(min(n_nationkey) as bigint) first from nation join region on n_regionkey = r_regionkey group by 1")
def json_documents(spark, sf_dir):
    """A summary as one JSON document in the shared folder, read back."""
    found = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"), F.min("n_nationkey").cast("bigint").alias("first"))
    path = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    files.write_document(found.agg(F.collect_list(F.struct(F.col("r_name").alias("region"), "nations", "first")).alias("regions")), path)  # five rows
    read = spark.read.json(path, schema="regions array<struct<region:string,nations:bigint,first:bigint>>")
    return read.select(F.explode("regions").alias("x")).select("x.*")


@query("select n_nationkey::bigint id, n_name name, n_regionkey / 4e0 v from nation")
def csv_tables(spark, sf_dir):
    """A table through CSV and back, in the shared folder."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_table(table(spark, sf_dir, "nation").selectExpr("n_nationkey id", "n_name name", "n_regionkey / 4e0 v"), path)
    return files.read_table(spark, path, "id bigint, name string, v double")


# --- Experiments --------------------------------------------------------------------------------------------------

@query("select abs_set, cutoff_km, cast(block_km as bigint) block_km, cast(buffer_km as bigint) buffer_km from (values ('uniform'), ('road_weighted')) a(abs_set) cross join (values (5e0), (10e0)) b(cutoff_km) cross join (values (25), (50), (100)) c(block_km) cross join (values (0), (10)) d(buffer_km)")
def experiment_grid(spark, sf_dir):
    return experiment.grid(spark)


@query('select abs_set, model, round_even(avg(spatial_auroc), 3) mean, round_even(stddev_samp(spatial_auroc), 3) std, min(spatial_auroc) "min", max(spatial_auroc) "max", count(*) draws from v_runs group by 1, 2', "v_runs")
def draw_summary(spark, sf_dir):
    return experiment.draw_summary(view(spark, sf_dir, "v_runs"))


@query("select m.abs_set, m.model, round(avg(m.spatial_auroc - b.spatial_auroc), 6) mean_delta, count(*) filter (m.spatial_auroc > b.spatial_auroc) wins, count(*) draws from v_runs m join v_runs b on b.model = 'm0' and m.model <> 'm0' and m.abs_set = b.abs_set and m.draw = b.draw group by 1, 2", "v_runs")
def paired_model_delta(spark, sf_dir):
    return experiment.paired_delta(view(spark, sf_dir, "v_runs"), "m0").select("abs_set", "model", r("mean_delta"), "wins", "draws")


@query("select abs_set, model, " + ", ".join(f"round(avg(spatial_auroc) filter (draw = {d}), 6) v_{d}" for d in range(1, 8)) + " from v_runs group by 1, 2", "v_runs")
def sensitivity_pivot(spark, sf_dir):
    return experiment.pivot(view(spark, sf_dir, "v_runs"), ["abs_set", "model"], "draw", list(range(1, 8)), "spatial_auroc").select("abs_set", "model", *[r(f"v_{d}") for d in range(1, 8)])


@query("select abs_set, model, round(avg(random_auroc), 6) random_auroc, round(avg(spatial_auroc), 6) spatial_auroc, round(stddev_pop(spatial_auroc), 6) spatial_auroc_sd, round(avg(random_auroc - spatial_auroc), 6) gap from v_runs group by 1, 2", "v_runs")
def seed_summary(spark, sf_dir):
    return experiment.seed_summary(view(spark, sf_dir, "v_runs"), ["abs_set", "model"]).select("abs_set", "model", *[r(c) for c in ("random_auroc", "spatial_auroc", "spatial_auroc_sd", "gap")])


@query("select abs_set, draw, model, spatial_auroc from v_runs where abs_set = 'R' and draw = 2 and model in ('m1', 'm3')", "v_runs")
def headline_filter(spark, sf_dir):
    rows = experiment.matching(view(spark, sf_dir, "v_runs"), {"abs_set": "R", "draw": 2})
    return rows.where(F.col("model").isin("m1", "m3")).select("abs_set", "draw", "model", "spatial_auroc")


@query("select id, case when score < 1e0/3 then '#2c7bb6' when score < 2e0/3 then '#fdae61' else '#d7191c' end colour, printf('%.2f', score) said from v_scored", "v_scored")
def score_colour_bands(spark, sf_dir):
    return view(spark, sf_dir, "v_scored").select("id", C.colour(F.col("score")).alias("colour"), C.two_digits(F.col("score")).alias("said"))


@query("select model, replace(replace(concat(case when model in ('m0', 'm1') then 'Random forest' else 'Gradient boosting' end, ' ', model), 'Random forest', 'RF'), 'Gradient boosting', 'GB') short from (select distinct model from v_runs) t", "v_runs")
def model_label_abbrev(spark, sf_dir):
    names = view(spark, sf_dir, "v_runs").select("model").distinct()
    long = F.concat_ws(" ", F.when(F.col("model").isin("m0", "m1"), "Random forest").otherwise("Gradient boosting"), "model")
    return names.select("model", experiment.short_name(long).alias("short"))


@query("select abs_set, draw, model, round(case when count(*) over (partition by abs_set, model) > 1 then -0.1e0 + 0.2e0 * (row_number() over (partition by abs_set, model order by draw) - 1) / (count(*) over (partition by abs_set, model) - 1) else -0.1e0 end, 6) jitter from v_runs", "v_runs")
def jitter_positions(spark, sf_dir):
    return experiment.jitter(view(spark, sf_dir, "v_runs"), ["abs_set", "model"], "draw").select("abs_set", "draw", "model", r("jitter"))


@query("select cast(position as integer) position, t.model, a.spatial_auroc from (values (0, 'm3'), (1, 'none'), (2, 'm0')) t(position, model) left join (select model, round(avg(spatial_auroc), 6) spatial_auroc from v_runs group by 1) a on a.model = t.model", "v_runs")
def reindex_fixed_order(spark, sf_dir):
    means = view(spark, sf_dir, "v_runs").groupBy("model").agg(F.round(F.avg("spatial_auroc"), 6).alias("spatial_auroc"))
    return experiment.in_order(means, "model", ["m3", "none", "m0"]).select("position", "model", "spatial_auroc")


@query("select unnest(range(0, (select count(*) from events), 2000)) as \"offset\"")
def page_offsets(spark, sf_dir):
    return experiment.page_offsets(table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n")), 2000)


@query("select abs_set, count(*) n from v_pts group by 1 union all select 'all', count(*) from v_pts", "v_pts")
def counts_by_set(spark, sf_dir):
    points = view(spark, sf_dir, "v_pts").select("abs_set")
    return points.unionByName(points.select(F.lit("all").alias("abs_set"))).groupBy("abs_set").agg(F.count(F.lit(1)).alias("n"))


# --- Feature table and study --------------------------------------------------------------------------------------

_NEAREST = lambda kinds, name: f"""{name} as (select id, min(sqrt(power(px - (x0 + t * (x1 - x0)), 2) + power(py - (y0 + t * (y1 - y0)), 2))) / 1000 km from (
 select p.id, p.x px, p.y py, s.*, case when (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) > 0 then greatest(0e0, least(1e0, ((p.x-x0)*(x1-x0)+(p.y-y0)*(y1-y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) else 0e0 end t from v_pts p cross join v_seg s where kind in ({kinds})) group by id)"""  # noqa: E731


@query(
    f"""with {_COVER_SQL}, {_NEAREST("'primary', 'residential'", 'road')}, {_NEAREST("'river'", 'river')},
 p as (select *, cast(trunc((200000 - y) / 2000) as bigint) rr, cast(trunc(x / 20000) as bigint) cc from v_pts),
 m as (select id, v_dem.r - rr dr, v_dem.c - cc dc, v from p join v_dem on abs(v_dem.r - rr) <= 2 and abs(v_dem.c - cc) <= 2),
 kk as (select id, max(v) filter (dr = 0 and dc = 0) z, max(v) filter (dr = 0 and dc = 1) e, max(v) filter (dr = 0 and dc = -1) w, max(v) filter (dr = -1 and dc = 0) n, max(v) filter (dr = 1 and dc = 0) s from m group by id having count(v) = 25),
 g as (select *, (e - w) / 40000e0 ge, (n - s) / 40000e0 gn from kk), a as (select *, case when sqrt(ge * ge + gn * gn) >= 1e-9 then atan2(-ge, -gn) end a from g),
 rain as (select r, c, avg(v) v from (select yr, r, c, sum(v) v from v_stack group by 1, 2, 3) t group by 1, 2),
 inn as (select id, inside from {_INSIDE}),
 f as (select p.id, label, abs_set, rr, cc, round(z, 6) elevation, round(degrees(atan(sqrt(ge * ge + gn * gn))), 6) slope, round(coalesce(sin(a), 0), 6) aspect_sin, round(coalesce(cos(a), 0), 6) aspect_cos, round((w + e + a.n + s - 4 * z) / 4e8, 12) curvature,
  round(road.km, 6) road_dist_km, round(river.km, 6) river_dist_km, round(rain.v, 4) rain_mm, {", ".join(f"round(counted.{c} / counted.n::double, 6) {c}" for c in C.COVER_GROUPS)}, inside
  from p join a using (id) join road using (id) join river using (id) join inn using (id) join counted using (id)
  join rain on rain.r = cast(floor((31 - lat) / 0.5) as bigint) and rain.c = cast(floor((lon - 80) / 0.45) as bigint) where rain.v is not null)
 select * exclude (rr, cc) from (select *, row_number() over (partition by abs_set, rr, cc order by id) k from f) t where k = 1""".replace(" select * exclude (rr, cc) from", " select * exclude (rr, cc, k) from"),
    "v_dem", "v_pts", "v_seg", "v_cover", "v_stack", "v_ring",
)
def feature_table(spark, sf_dir):
    """Terrain, distances, rainfall, cover and the boundary at every place, rows without all of them dropped, the first of each cell."""
    lines = view(spark, sf_dir, "v_seg")
    rain = raster.stack_mean(view(spark, sf_dir, "v_stack").groupBy("yr", "r", "c").agg(F.sum("v").alias("v"))).select("r", "c", F.col("mean").alias("v"))
    given = features.Inputs(
        events=None, boundary=view(spark, sf_dir, "v_ring"), roads=lines.where(F.col("kind").isin(*C.MOTOR_CLASSES)), rivers=lines.where(F.col("kind").isin(*C.RIVER_CLASSES)),
        dem=view(spark, sf_dir, "v_dem"), grid=Grid(0.0, 200000.0, 20000.0, 2000.0, 1 << 30, 20), rain=(rain, Grid(80.0, 31.0, 0.45, 0.5, 1 << 30, 20)), cover=_cover_tiles(spark, sf_dir),
    )
    points = view(spark, sf_dir, "v_pts").selectExpr("id", "label", "abs_set", "0 draw", "id event_id", "timestamp'2000-01-01' event_date", "accuracy_km", "lon longitude", "lat latitude", "x", "y")
    found = features.described(points, given, 60.0)
    digits = {"curvature": 12, "rain_mm": 4}
    values = [c for c in features.COLUMNS if c not in ("label", "abs_set", "event_id", "event_date", "accuracy_km", "longitude", "latitude", "x", "y", "inside")]
    return found.select("id", "label", "abs_set", *[r(c, digits.get(c, 6)) for c in values], "inside")


_STUDY = f"""st as (select * from (values ('uniform', 0), ('uniform', 10), ('road_weighted', 0), ('road_weighted', 10)) a(s, b) cross join (values (0), (1)) t(seed)),
 p as (select s, id, label, x, y, f1 from v_pts cross join (values ('uniform'), ('road_weighted')) t(s) where (label = 1 and accuracy_km <= 5) or abs_set = s),
 bl as (select distinct s, seed, cast(floor(x / 50000e0) as bigint) ix, cast(floor(y / 50000e0) as bigint) iy from p cross join (values (0), (1)) t(seed)),
 fo as (select s, seed, ix, iy, (row_number() over (partition by s, seed order by {_U("cast(seed as varchar)", "concat(ix, ':', iy)")}, ix, iy) - 1) % 5 f from bl),
 q as (select p.*, seed, f from p join fo on fo.s = p.s and ix = floor(x / 50000e0) and iy = floor(y / 50000e0)),
 rn as (select p.*, seed, (row_number() over (partition by s, seed, label order by {_U("cast(seed as varchar)", "id")}, id) - 1) % 5 f from p cross join (values (0), (1)) t(seed)),
 tf as (select unnest(range(5)) tf),
 tr as (select 'spatial' kind, q.s, b, q.seed, tf, label, f1 from q join st on st.s = q.s and st.seed = q.seed cross join tf where f <> tf and (b = 0 or not exists (select 1 from q o where o.s = q.s and o.seed = q.seed and o.f = tf and sqrt((o.x - q.x) * (o.x - q.x) + (o.y - q.y) * (o.y - q.y)) <= b * 1000e0))
  union all select 'random', s, 0, seed, tf, label, f1 from rn cross join tf where f <> tf),
 te as (select 'spatial' kind, q.s, b, q.seed, f tf, label, f1 from q join st on st.s = q.s and st.seed = q.seed union all select 'random', s, 0, seed, f, label, f1 from rn),
 sg as (select kind, s, b, seed, tf, case when avg(f1) filter (label = 1) > avg(f1) filter (label = 0) then 1 else -1 end g from tr group by all having min(label) <> max(label)),
 z as (select te.*, g * f1 sc from te join sg using (kind, s, b, seed, tf)),
 k as (select *, rank() over (partition by kind, s, b, seed, tf order by sc) + (count(*) over (partition by kind, s, b, seed, tf, sc) - 1) / 2e0 rk from z),
 au as (select kind, s, b, seed, tf, (sum(rk) filter (label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * sum(1 - label)) a from k group by all having min(label) <> max(label)),
 t as (select kind, s, b, seed, tf, sc, sum(label) tp, count(*) n from z group by all),
 u as (select *, sum(tp) over (partition by kind, s, b, seed, tf order by sc desc) ctp, sum(n) over (partition by kind, s, b, seed, tf order by sc desc) cn from t),
 ap as (select kind, s, b, seed, tf, sum(tp * ctp / cn::double) / sum(tp) ap from u group by all),
 m as (select kind, s, b, seed, avg(a) a, avg(ap) ap, count(*) n from au join ap using (kind, s, b, seed, tf) group by all),
 x as (select sp.s, sp.b, sp.seed, ra.a ra, sp.a sa, ra.ap rp, sp.ap pp, sp.n from m sp join m ra on ra.kind = 'random' and sp.kind = 'spatial' and ra.s = sp.s and ra.seed = sp.seed),
 c as (select s, sum(label)::int n_pres, sum(1 - label)::int n_abs from p group by s)"""


@query(
    f"""with {_STUDY} select x.s abs_set, 'f1 (logistic)' model, 5e0 cutoff_km, 50 block_km, b buffer_km, max(n_pres) n_pres, max(n_abs) n_abs, round(avg(ra), 6) random_auroc, round(avg(sa), 6) spatial_auroc, round(avg(ra - sa), 6) gap, round(avg(rp), 6) random_prauc, round(avg(pp), 6) spatial_prauc,
 round(stddev_pop(sa), 6) spatial_auroc_sd_over_seeds, avg(n) spatial_folds_scored from x join c on c.s = x.s group by x.s, b""",
    "v_pts",
)
def baseline_study(spark, sf_dir):
    """The runner over two schemes, two buffers and two seeds, with one model whose ranking SQL can tell: that of its only feature, turned
    around where the training rows say so."""
    settings = {"abs_set": ("uniform", "road_weighted"), "cutoff_km": (5.0,), "block_km": (50,), "buffer_km": (0, 10)}
    found = experiment.baselines(view(spark, sf_dir, "v_pts"), {"f1 (logistic)": (["f1"], Learner("logistic"))}, settings, (0, 1))
    exact = ("abs_set", "model", "cutoff_km", "block_km", "buffer_km", "n_pres", "n_abs", "spatial_folds_scored")
    return found.select(*[c if c in exact else r(c) for c in found.columns])


@query(
    "select * from (values ('Slope only (logistic)', 'logistic', 1), ('Elevation only (logistic)', 'logistic', 1), ('Logistic regression', 'logistic', 5), ('Random forest', 'forest', 5), ('Random forest + road distance (ablation)', 'forest', 6), ('Road distance only (logistic)', 'logistic', 1), ('Random forest + river distance', 'forest', 6), ('River distance only (logistic)', 'logistic', 1), ('Random forest + road + river distance', 'forest', 7), ('Random forest + rainfall', 'forest', 6), ('Random forest + land cover', 'forest', 13), ('Random forest + rainfall + land cover', 'forest', 14), ('Rainfall only (logistic)', 'logistic', 1), ('Land cover only (forest)', 'forest', 8), ('Gradient boosting', 'boosting', 5), ('Gradient boosting + land cover', 'boosting', 13), ('Gradient boosting + rainfall + land cover', 'boosting', 14)) t(model, kind, n_features)"
)
def model_registry(spark, sf_dir):
    return spark.createDataFrame([(name, learner.kind, len(columns)) for name, (columns, learner) in experiment.MODELS.items()], "model string, kind string, n_features int")


# --- Models -------------------------------------------------------------------------------------------------------

_FEATURES = ["f1", "x", "y"]


def _fold_roles(spark, sf_dir) -> DataFrame:
    points = folds.spatial_folds(view(spark, sf_dir, "v_pts").where("label = 0 or accuracy_km <= 5"), 50000.0)
    return models.roles(points, folds.buffered_training(points, 5, 10000.0))


_NEAR = "n as (select * from v_pts where label = 0 or accuracy_km <= 5)"
_ROLES = f"""{_NEAR}, b as (select distinct cast(floor(x / 50000e0) as bigint) ix, cast(floor(y / 50000e0) as bigint) iy from n),
 o as (select ix, iy, (row_number() over (order by {_U(repr('0'), "concat(ix, ':', iy)")}, ix, iy) - 1) % 5 f from b),
 q as (select n.*, f from n join o on ix = floor(x / 50000e0) and iy = floor(y / 50000e0)), tf as (select unnest(range(5)) tf),
 tr as (select tf, q.* from q cross join tf where f <> tf and not exists (select 1 from q o where o.f = tf and sqrt((o.x - q.x) * (o.x - q.x) + (o.y - q.y) * (o.y - q.y)) <= 10000e0)),
 ok as (select tf from tr group by tf having min(label) <> max(label) intersect select f from q group by f having min(label) <> max(label))"""


@query(f"with {_ROLES} select learner, f::int test_fold, id, label y from q join ok on tf = f cross join (values ('logistic'), ('forest'), ('boosting')) t(learner)", "v_pts")
def model_rows(spark, sf_dir):
    """Which rows each learner scores, and in which fold."""
    given = _fold_roles(spark, sf_dir)
    found = None
    for learner in (Learner("logistic"), Learner("forest", trees=8), Learner("boosting")):
        one = models.fold_predictions(given, _FEATURES, learner).select(F.lit(learner.kind).alias("learner"), "test_fold", "id", "y")
        found = one if found is None else found.unionByName(one)
    return found


def _newton(steps: int) -> str:
    """Newton steps of the class-balanced logistic regression on one scaled feature, unrolled."""
    parts = [
        "sc as (select tr.tf, avg(f1) m, stddev_pop(f1) sd, count(*) n, sum(label) n1 from tr join ok using (tf) group by tr.tf)",
        "d as (select tf, (f1 - m) / sd v, label y, case when label = 1 then n / (2e0 * n1) else n / (2e0 * (n - n1)) end c from tr join sc using (tf))",
        "w0 as (select tf, 0e0 w, 0e0 a from sc)",
    ]
    for i in range(steps):
        parts.append(f"s{i} as (select tf, w, a, sum(c * (p - y) * v) + w gw, sum(c * (p - y)) + 1e-9 * a ga, sum(c * p * (1 - p) * v * v) + 1 hw, sum(c * p * (1 - p) * v) hx, sum(c * p * (1 - p)) + 1e-9 ha from (select d.*, w, a, 1 / (1 + exp(-(w * v + a))) p from d join w{i} using (tf)) t group by tf, w, a)")
        parts.append(f"w{i + 1} as (select tf, w - (ha * gw - hx * ga) / (hw * ha - hx * hx) w, a - (hw * ga - hx * gw) / (hw * ha - hx * hx) a from s{i})")
    return ",\n ".join(parts)


@query(f"with {_ROLES}, {_newton(9)} select f::int test_fold, id, label y, round(1 / (1 + exp(-(w * (f1 - m) / sd + a))), 6) score from q join sc on sc.tf = f join w9 on w9.tf = f", "v_pts")
def logistic_one_feature(spark, sf_dir):
    return models.fold_predictions(_fold_roles(spark, sf_dir), ["f1"], "logistic").select("test_fold", "id", "y", r("score"))


@query()
def logistic_scores(spark, sf_dir):
    return models.fold_predictions(_fold_roles(spark, sf_dir), _FEATURES, "logistic")


@query()
def forest_scores(spark, sf_dir):
    return models.fold_predictions(_fold_roles(spark, sf_dir), _FEATURES, "forest")


@query()
def boosting_scores(spark, sf_dir):
    return models.fold_predictions(_fold_roles(spark, sf_dir), _FEATURES, "boosting")


@query()
def map_scores(spark, sf_dir):
    samples = catalogue.one_scheme(view(spark, sf_dir, "v_pts"), "road_weighted", 5.0)
    return models.in_sample_scores(samples, _FEATURES).withColumn("colour", C.colour(F.col("score")))


@query(
    f"""with {_ROLES}, sg as (select tf, case when avg(f1) filter (label = 1) > avg(f1) filter (label = 0) then 1 else -1 end g from tr join ok using (tf) group by tf),
 z as (select f tf, label y, g * f1 sc from q join sg on sg.tf = f),
 k as (select *, rank() over (partition by tf order by sc) + (count(*) over (partition by tf, sc) - 1) / 2e0 rk from z),
 au as (select tf, (sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * sum(1 - y)) auroc from k group by tf),
 t as (select tf, sc, sum(y) tp, count(*) n from z group by 1, 2), u as (select *, sum(tp) over (partition by tf order by sc desc) ctp, sum(n) over (partition by tf order by sc desc) cn from t),
 ap as (select tf, sum(tp * ctp / cn::double) / sum(tp) ap from u group by 1)
 select au.tf::int test_fold, round(auroc, 9) auroc, round(ap, 9) ap from au join ap using (tf)""",
    "v_pts",
)
def logistic_fold_scores(spark, sf_dir):
    """Scores of each fold by one feature: SQL knows their order, that of the feature or the reverse, as the training rows say."""
    scored = models.fold_predictions(_fold_roles(spark, sf_dir), ["f1"], "logistic")
    return metrics.fold_scores(scored, ["test_fold"]).select("test_fold", r("auroc", 9), r("ap", 9))
