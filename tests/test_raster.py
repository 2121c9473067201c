import math

import numpy as np
import pytest

from foldstone.operators import raster


def frame(spark, grid):
    rows = [(r, c, None if v is None or math.isnan(v) else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "r long, c long, v double")


def test_inclined_plane_faces_west(spark):
    found = raster.terrain(frame(spark, [[30.0 * c for c in range(20)] for _ in range(20)])).where("r = 10 and c = 10").first()
    assert found["slope"] == pytest.approx(45) and found["aspect"] == pytest.approx(270)


def test_north_rising_plane_faces_south(spark):
    found = raster.terrain(frame(spark, [[-30.0 * r] * 20 for r in range(20)])).where("r = 10 and c = 10").first()
    assert found["aspect"] == pytest.approx(180)


def test_flat_has_no_aspect(spark):
    assert raster.terrain(frame(spark, [[0.0] * 5] * 5)).where("aspect is not null").count() == 0


def test_terrain_at_point_of_a_plane(spark):
    points = spark.createDataFrame([(1, 15, 10)], "id long, r long, c long")
    found = raster.terrain_at(frame(spark, [[30.0 * c for c in range(30)] for _ in range(30)]), points).first()
    assert (found["elevation"], round(found["slope"], 9), round(found["aspect_sin"], 9), round(found["aspect_cos"], 9)) == (300, 45, -1, 0)
    assert found["curvature"] == pytest.approx(0)


def test_edges_and_gaps_are_null(spark):
    grid = np.random.default_rng(0).random((30, 30)).tolist()
    grid[15][15] = None
    points = spark.createDataFrame([(1, 0, 15), (2, 15, 15), (3, 14, 15), (4, 29, 15), (5, 5, 5)], "id long, r long, c long")
    found = {r["id"]: r["slope"] for r in raster.terrain_at(frame(spark, grid), points).collect()}
    assert [found[i] for i in (1, 2, 3, 4)] == [None] * 4 and found[5] is not None


def test_flat_point_has_zero_sine_and_cosine(spark):
    points = spark.createDataFrame([(1, 10, 10)], "id long, r long, c long")
    found = raster.terrain_at(frame(spark, [[500.0] * 20] * 20), points).first()
    assert (found["slope"], found["aspect_sin"], found["aspect_cos"]) == (0, 0, 0)


def test_stack_mean_skips_missing(spark):
    rows = [(0, 0, None), (0, 0, 3000.0), (0, 1, float("nan")), (0, 1, 1000.0), (1, 1, None)]
    found = {(r["r"], r["c"]): r["mean"] for r in raster.stack_mean(spark.createDataFrame(rows, "r int, c int, v double")).collect()}
    assert found == {(0, 0): 3000, (0, 1): 1000, (1, 1): None}


def test_lookup_outside_is_null(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, -0.5, 1.0), (3, 1.0, 9.0), (4, 5.0, 1.0)], "id int, prow double, pcol double")
    found = {r["id"]: r["v"] for r in raster.sample(frame(spark, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]), points).collect()}
    assert found == {1: 0, 2: None, 3: None, 4: None}


def test_shares_over_a_seam_and_far_away(spark):
    cover = [(r, c, 10 if c < 50 else 0 if c < 53 else 40) for r in range(100) for c in range(100)]
    points = spark.createDataFrame([(1, 50.0, 51.5), (2, 50.0, 20.0), (3, 900.0, 900.0)], "id int, prow double, pcol double")
    found = {r["id"]: r for r in raster.class_shares(spark.createDataFrame(cover, "r int, c int, code int"), points, 10).collect()}
    assert found[1]["lc_tree"] == pytest.approx(0.5, abs=0.05) and found[1]["lc_tree"] + found[1]["lc_crop"] == pytest.approx(1)
    assert found[2]["lc_tree"] == 1 and found[3]["lc_tree"] is None
    with pytest.raises(ValueError):
        raster.class_shares(spark.createDataFrame(cover, "r int, c int, code int"), points, 0)
