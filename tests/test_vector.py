import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.functions import columns as C
from foldstone.operators import vector


def test_nearest_line_vectors(spark):
    lines = spark.createDataFrame([(0.0, 0.0, 1000.0, 0.0), (0.0, 2000.0, 1000.0, 2000.0)], "x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 500.0, 300.0), (2, 500.0, 1600.0), (3, 500.0, 1000.0), (4, 1500.0, 0.0), (5, -2400.0, 0.0)], "id int, x double, y double")
    for bucket in (50.0, 1000.0, 1e6):
        found = {r["id"]: round(r["distance"], 6) for r in vector.nearest_line(points, lines, bucket).collect()}
        assert found == {1: 300, 2: 400, 3: 1000, 4: 500, 5: 2400}


def test_on_the_line_and_no_lines(spark):
    points = spark.createDataFrame([(1, 500.0, 500.0)], "id int, x double, y double")
    schema = "x0 double, y0 double, x1 double, y1 double"
    assert vector.nearest_line(points, spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0)], schema)).first()["distance"] == pytest.approx(0)
    assert vector.nearest_line(points, spark.createDataFrame([], schema)).first()["distance"] is None


def test_nearest_other_keeps_copies_at_zero(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((60, 2)) * 1e5
    xy[1] = xy[0]
    points = spark.createDataFrame([(i, "a", float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, by string, x double, y double")
    found = {r["id"]: r["distance"] for r in vector.nearest_other(points, "by", 500.0).collect()}
    apart = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    np.fill_diagonal(apart, np.inf)
    assert found[0] == 0 and found[1] == 0
    assert [found[i] for i in range(60)] == pytest.approx(apart.min(axis=1).tolist())


def test_polygon_with_a_notch(spark):
    ring = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 5, 5), (5, 5, 0, 10), (0, 10, 0, 0)]
    edges = spark.createDataFrame([tuple(map(float, e)) for e in ring], "x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 8.0), (3, 1.0, 8.0), (4, 11.0, 1.0)], "id int, x double, y double")
    assert {r["id"]: r["inside"] for r in vector.within(points, edges).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert vector.rasterize(edges, 0.0, 10.0, 10, 10, 1.0).count() == pytest.approx(75, abs=6)


def test_polygons_of_many_edges_against_plain_parity(spark):
    rng = np.random.default_rng(8)
    angle = np.sort(rng.random(400)) * 2 * np.pi
    radius = 50 + 40 * rng.random(400)
    ring = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1).round(1)
    ring[:40, 1] = ring[:40, 1].round(0)  # level edges and corners at points' heights
    hole = ring[::-7] * 0.2
    edges = [(*a, *b) for r in (ring, hole) for a, b in zip(r, np.roll(r, -1, axis=0))]
    xy = np.concatenate([rng.uniform(-100, 100, (1500, 2)).round(1), ring[:50], np.stack([rng.uniform(-100, 100, 100), ring[:100, 1]], axis=1)])
    want = [sum((y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 for x0, y0, x1, y1 in edges) % 2 == 1 for x, y in xy]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, x double, y double")
    lines = spark.createDataFrame([tuple(map(float, e)) for e in edges], "x0 double, y0 double, x1 double, y1 double")
    for least in (1, 50, 5000):
        found = {r["id"]: r["inside"] for r in vector.within(points, lines, least).collect()}
        assert [found[i] for i in range(len(xy))] == want


def test_far_points_meet_few_targets(spark):
    rng = np.random.default_rng(9)
    town = np.concatenate([rng.normal(0, 300, (800, 2)), rng.uniform(-4e5, 4e5, (30, 2))])
    places = np.concatenate([rng.uniform(-4e5, 4e5, (200, 2)), rng.normal(0, 500, (100, 2))])
    ends = town + rng.normal(0, 4000, town.shape)
    lines = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(town, ends)], "x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "id int, x double, y double")
    found = {r["id"]: r["distance"] for r in vector.nearest_line(points, lines, 1000.0).collect()}
    d = ends - town
    t = np.clip(((places[:, None] - town) * d).sum(axis=2) / (d**2).sum(axis=1), 0, 1)
    want = np.hypot(*(places[:, None] - town - t[:, :, None] * d).transpose(2, 0, 1)).min(axis=1)
    assert [found[i] for i in range(300)] == pytest.approx(want.tolist())


def test_boxes_that_meet_a_boundary(spark):
    ring = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)]
    edges = spark.createDataFrame([tuple(map(float, e)) for e in ring], "x0 double, y0 double, x1 double, y1 double")
    boxes = [("in", 4, 4, 5, 5), ("over", 9, 9, 12, 12), ("out", 11, 0, 12, 1), ("around", -5, -5, 15, 15), ("beside", -3, 4, -1, 6)]
    rows = spark.createDataFrame([(n, *map(float, b)) for n, *b in boxes], "name string, l double, b double, r double, t double")
    assert sorted(r["name"] for r in vector.boxes_meeting(rows, edges).collect()) == ["around", "in", "over"]


def test_cell_lookup_truncates(spark):
    cells = spark.createDataFrame([(r, c) for r in range(3) for c in range(3)], "r long, c long")
    points = spark.createDataFrame([(-0.5, 2.5)], "x double, y double")  # half a cell west of the grid falls into column 0
    assert vector.unoccupied(cells, points, 0.0, 3.0, 1.0).count() == 8


def test_projection_meets_a_published_pair(spark):
    """The tower at 79 23 13.7 W, 43 38 33.24 N has 630084 east, 4833438 north in zone 17; places there lie as they do in zone 45, 168 degrees
    east of it."""
    x, y = C.utm_forward(F.lit(-(79 + 23 / 60 + 13.7 / 3600) + 168.0), F.lit(43 + 38 / 60 + 33.24 / 3600))
    found = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert found["x"] == pytest.approx(630084, abs=1) and found["y"] == pytest.approx(4833438, abs=1)


def test_projection_round_trip(spark):
    points = spark.createDataFrame([(80.1, 30.4), (87.0, 27.0), (88.3, 26.3)], "lon double, lat double")
    x, y = C.utm_forward(F.col("lon"), F.col("lat"))
    back = points.select("*", x.alias("x"), y.alias("y"))
    lon, lat = C.utm_inverse(F.col("x"), F.col("y"))
    for r in back.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r["lon"] == pytest.approx(r["lon2"], abs=1e-11) and r["lat"] == pytest.approx(r["lat2"], abs=1e-11)
    assert back.where("lon = 87").first()["x"] == pytest.approx(500000)
