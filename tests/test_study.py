import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone import study
from foldstone.functions.columns import utm_inverse
from foldstone.operators import experiment, features, metrics
from foldstone.operators.models import Learner
from foldstone.operators.raster import Grid

X0, Y0, CELLS = 300_000.0, 3_100_000.0, 200  # six kilometres of 30 m cells


def cells(spark, value, n=CELLS):
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    return grid.select("r", "c", value.cast("double").alias("v"))


@pytest.fixture(scope="module")
def made(spark):
    size = CELLS * 30.0
    corners = [(X0 + 400, Y0 - 400), (X0 + size - 400, Y0 - 400), (X0 + size - 400, Y0 - size + 400), (X0 + 400, Y0 - size + 400)]
    schema = "x0 double, y0 double, x1 double, y1 double"
    boundary = spark.createDataFrame([(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])], schema)
    roads = spark.createDataFrame([(X0, Y0 - 2000.0, X0 + size, Y0 - 2500.0)], schema)
    rivers = spark.createDataFrame([(X0 + 3000.0, Y0, X0 + 2500.0, Y0 - size)], schema)
    dem = cells(spark, 500 + 3 * F.col("c") + F.pmod(F.xxhash64("r", "c"), F.lit(7)))
    lon, lat = utm_inverse(F.lit(X0), F.lit(Y0))
    corner = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    left, top = round(corner["lon"] - 0.1, 2), round(corner["lat"] + 0.1, 2)
    rain = cells(spark, 1000 + F.col("c"), 20), Grid(left, top, 0.02, 0.02, 20, 20)
    cover = {"tile": (cells(spark, F.when(F.col("c") % 2 == 0, 10).otherwise(40), 200), Grid(left, top, 0.002, 0.002, 200, 200))}
    rng = np.random.default_rng(0)
    xy = np.stack([X0 + rng.uniform(500, size - 500, 40), Y0 - rng.uniform(1500, 3500, 40)], axis=1)
    xy[5] = xy[4]  # two events in one cell
    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    events = spark.createDataFrame([(i, float(x), float(y), None if i == 39 else 25.0 if i >= 10 else 5.0) for i, (x, y) in enumerate(xy)], "event_id long, x double, y double, accuracy_km double")
    events = events.select("event_id", F.lit(None).cast("timestamp").alias("event_time"), "accuracy_km", lon.alias("longitude"), lat.alias("latitude"))
    inputs = features.Inputs(events, boundary, roads, rivers, dem, Grid(X0, Y0, 30.0, 30.0, CELLS, CELLS), rain, cover)
    table, far = features.build(inputs, 2)
    return table.persist(), far.persist()


def test_feature_table(spark, made):
    table, far = made
    rows = table.collect()
    assert table.columns == ["id", *features.COLUMNS, "draw"]
    count = {(r["abs_set"], r["draw"]): sum((x["abs_set"], x["draw"]) == (r["abs_set"], r["draw"]) for x in rows) for r in rows}
    assert count[("presence", -1)] == 39 and count[("uniform", 0)] == count[("road_weighted", 1)] == 50  # the second of two events in a cell goes
    assert all(0 <= (r["x"] - X0) < CELLS * 30 and r["inside"] for r in rows)
    for r in rows[::17]:
        row, col = int((Y0 - r["y"]) / 30), int((r["x"] - X0) / 30)
        assert 500 + 3 * col <= r["elevation"] < 507 + 3 * col and r["lc_tree"] + r["lc_crop"] == pytest.approx(1)
        t = min(1, max(0, ((r["x"] - X0) * 6000 + (r["y"] - Y0 + 2000) * -500) / (6000**2 + 500**2)))
        assert r["road_dist_km"] == pytest.approx(np.hypot(r["x"] - X0 - t * 6000, r["y"] - Y0 + 2000 + t * 500) / 1000, abs=1e-9)
        assert 1000 <= r["rain_mm"] < 1020 and row >= 2
    taken = {(int((Y0 - r["y"]) / 300), int((r["x"] - X0) / 300)) for r in rows if r["label"]}
    assert not taken & {(int((Y0 - r["y"]) / 300), int((r["x"] - X0) / 300)) for r in rows if not r["label"]}
    near = lambda s: np.mean([r["road_dist_km"] for r in rows if r["abs_set"] == s])
    assert abs(near("road_weighted") - near("presence")) < abs(near("uniform") - near("presence"))
    said = json.loads(features.summary(table.where("draw < 1"), far, 400).select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    assert said["counts_by_set"] == {"presence": 39, "uniform": 50, "road_weighted": 50} and said["rows_dropped"] == 400 - 139
    assert len(said["share_by_distance_bin"]["uniform"]) == 10 and sum(said["share_by_distance_bin"]["background_cells"]) == pytest.approx(1, abs=0.01)


def made_up(spark, n=120):
    rng = np.random.default_rng(0)
    rows = []
    for abs_set, label, count in (("presence", 1, n), ("uniform", 0, 200), ("road_weighted", 0, 200)):
        for _ in range(count):
            accuracy = float(rng.choice([1.0, 5.0, 25.0])) if label else None
            rows.append((len(rows), label, abs_set, accuracy, float(rng.uniform(0, 400_000)), float(rng.uniform(0, 200_000)), float(rng.normal(20 + 5 * label, 8)), len(rows) % 2))
    return spark.createDataFrame(rows, "id long, label int, abs_set string, accuracy_km double, x double, y double, slope double, draw int")


def test_runner_takes_the_right_rows(spark):
    table = made_up(spark)
    models = {"Slope and y": (["slope", "y"], Learner("logistic"))}
    grid = {"abs_set": ("road_weighted",), "cutoff_km": (5.0,), "block_km": (50,), "buffer_km": (0, 10)}
    found = {r["buffer_km"]: r for r in experiment.baselines(table, models, grid, (0, 1)).collect()}
    near = table.where("label = 1 and accuracy_km <= 5").count()
    for r in found.values():
        assert (r["n_pres"], r["n_abs"], r["abs_set"], r["cutoff_km"], r["spatial_folds_scored"]) == (near, 200, "road_weighted", 5.0, 5.0)
        assert 0.5 < r["random_auroc"] <= 1 and r["gap"] == pytest.approx(r["random_auroc"] - r["spatial_auroc"])
    assert found[0]["random_auroc"] == found[10]["random_auroc"] and found[0]["spatial_auroc"] != found[10]["spatial_auroc"]


def test_runner_of_draws_and_leakage(spark):
    table = made_up(spark)
    models = {"Slope only": (["slope"], Learner("logistic"))}
    found = experiment.absence_variation(table, models).collect()
    assert sorted((r["abs_set"], r["draw"], r["n_abs"]) for r in found) == [("road_weighted", 0, 100), ("road_weighted", 1, 100), ("uniform", 0, 100), ("uniform", 1, 100)]
    leak = experiment.leakage(table, {"slope": ["slope"], "slope + x, y": ["slope", "x", "y"], "x, y only": ["x", "y"]}, (50, 60), (0,), Learner("logistic"))
    assert sorted((r["block_km"], r["features"]) for r in leak.where("abs_set = 'uniform'").collect()) == [(50, "slope"), (50, "slope + x, y"), (50, "x, y only"), (60, "slope"), (60, "x, y only")]
    text = experiment.report(leak.orderBy("block_km", "features"), ["abs_set", "features", "gap"], 2, most=3)
    assert len(text.split("\n")) == 5 and text.endswith("...")


def test_nothing_scored_is_an_error(spark):
    table = spark.createDataFrame([(i, int(i % 5 < 2), "presence" if i % 5 < 2 else "uniform", 1.0, float(i), i % 5 * 60_000.0, float(i)) for i in range(100)], "id long, label int, abs_set string, accuracy_km double, x double, y double, slope double")
    with pytest.raises(ValueError, match=metrics.NOTHING_SCORED):
        experiment.cross_validated(table, experiment.scheme_sets(("uniform",), (5.0,)), [("uniform:5.0", 50, 0)], {"m": (["slope"], Learner("logistic"))}, (0,)).count()


def test_registry():
    assert len(experiment.MODELS) == 17 and {k.kind for _, k in experiment.MODELS.values()} == {"logistic", "forest", "boosting"}
    assert set(experiment.DRAW_MODELS) < set(experiment.MODELS) and len({f for fs, _ in experiment.MODELS.values() for f in fs}) == 16


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    args = study.arguments(["features", "--draws", "20", "--catalogue", "x.csv"])
    assert (args.command, args.draws, args.catalogue, args.out) == ("features", 20, "x.csv", "data/tables")
    monkeypatch.setenv("FOLDSTONE_RAW", "/somewhere")
    assert study.arguments(["map"]).raw == "/somewhere"
    with pytest.raises(ValueError, match="45 elevation tiles are needed"):
        study.main(["features", "--raw", str(tmp_path), "--out", str(tmp_path)], spark)
    rng = np.random.default_rng(1)
    rows = [(i % 4 == 0, "presence" if i % 4 == 0 else "road_weighted", i) for i in range(200)]
    columns = study.TABLE.split(", ")
    values = {"accuracy_km": "1.0", "inside": "true", "event_id": "", "event_date": ""}
    lines = [",".join(c.split()[0] for c in columns)]
    for label, scheme, i in rows:
        row = {"label": str(int(label)), "abs_set": scheme, "longitude": f"{80 + i / 100}", "latitude": "28.0", **values}
        lines.append(",".join(row.get(c.split()[0], f"{rng.normal(5.0 * label, 2):.4f}") for c in columns))
    (tmp_path / "features.csv").write_text("\n".join(lines) + "\n")
    study.main(["map", "--out", str(tmp_path)], spark)
    assert (tmp_path / "map.html").read_text().count("<circle") == 200 and "map.html" in capsys.readouterr().out


def test_reports_of_the_studies(spark, tmp_path, monkeypatch, capsys):
    columns = study.TABLE.split(", ")
    lines = [",".join([c.split()[0] for c in columns] + ["draw"])]
    for i in range(60):
        row = {"label": str(i % 2), "abs_set": ("uniform", "presence")[i % 2], "accuracy_km": "1.0", "inside": "true", "event_id": "", "event_date": "", "x": f"{1000.0 * i}", "y": "0.0"}
        lines.append(",".join([row.get(c.split()[0], "1.5") for c in columns] + ["0"]))
    (tmp_path / "features_draws.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "features.csv").write_text("\n".join(line.rsplit(",", 1)[0] for line in lines) + "\n")
    seen = []
    scores = [("uniform", f"m{i}", 5.0, 50, b, 10, 20, 0.9, 0.7 + i / 100, 0.2, 0.8, 0.6, 0.01, 5.0) for i in range(3) for b in (0, 10)]
    schema = "abs_set string, model string, cutoff_km double, block_km int, buffer_km int, n_pres int, n_abs int, random_auroc double, spatial_auroc double, gap double, random_prauc double, spatial_prauc double, spatial_auroc_sd_over_seeds double, spatial_folds_scored double"
    monkeypatch.setattr(study.experiment, "baselines", lambda table: seen.append(table.count()) or spark.createDataFrame(scores, schema))
    study.main(["baselines", "--out", str(tmp_path)], spark)
    said = capsys.readouterr().out
    assert said.index("m2") < said.index("m0") and "0.720" in said and "5.0_50_10" in said and said.count("uniform") == 9
    monkeypatch.setattr(study.experiment, "absence_variation", lambda table: seen.append(table.where("draw = 0").count()) or spark.createDataFrame([("uniform", d, "m", 20, 0.6 + d / 10, 0.1) for d in range(3)], "abs_set string, draw int, model string, n_abs int, spatial_auroc double, gap double"))
    study.main(["draws", "--out", str(tmp_path)], spark)
    assert "0.700" in capsys.readouterr().out
    monkeypatch.setattr(study.experiment, "leakage", lambda table: seen.append(table.count()) or spark.createDataFrame([("uniform", 50, "terrain", 0.9, 0.6, 0.3, 5.0)], "abs_set string, block_km int, features string, random_auroc double, spatial_auroc double, gap double, spatial_folds_scored double"))
    study.main(["leakage", "--out", str(tmp_path)], spark)
    said = capsys.readouterr().out
    assert "terrain" in said and "p50" in said and " 2.0" in said and seen == [60, 60, 60]
