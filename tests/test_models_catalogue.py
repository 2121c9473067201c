import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import catalogue, experiment, models
from foldstone.sources import files


def test_learners_rank_a_signal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(int)
    for score in (models.boosted(x, y, x, 60), models.forest_share(x, y, x, 20, 0), models.logistic(x, y, x)):
        assert score[y == 1].mean() > score[y == 0].mean() + 0.3
    assert (models.boosted(x, y, x, 20) == models.boosted(x, y, x, 20)).all()


def test_random_folds_flatter_a_smooth_field(spark):
    """1,500 places, six plane waves and noise; places are the only features."""
    from foldstone.operators import folds, metrics

    rng = np.random.default_rng(42)
    xy = rng.uniform(0, 150_000, size=(1500, 2))
    waves = [(rng.normal(0, 2 * np.pi / 30_000, size=2), rng.uniform(0, 2 * np.pi)) for _ in range(6)]
    field = sum(np.sin(xy @ k + phase) for k, phase in waves)
    y = field + rng.normal(0, 0.3, len(xy)) > np.median(field)
    points = spark.createDataFrame([(i, int(f), float(a), float(b)) for i, ((a, b), f) in enumerate(zip(xy, y))], "id int, label int, x double, y double")
    learner = models.Learner("forest", trees=80, min_leaf=1, balanced=False)
    scored = []
    for kind, dealt, buffer in (("random", folds.stratified_folds(points), 0.0), ("spatial", folds.spatial_folds(points, 30_000.0), 5000.0)):
        training = folds.buffered_training(dealt, 5, buffer)
        found = models.fold_predictions(models.roles(dealt, training), ["x", "y"], learner)
        scored.append(found.select(F.lit(kind).alias("kind"), F.col("test_fold").alias("fold"), "y", "score"))
    gap = metrics.compare(scored[0].unionByName(scored[1])).first()
    assert gap["random_auroc_mean"] > 0.80 and gap["auroc_gap"] > 0.15, gap


def test_forests_are_fitted_alike_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=1200) > 0).astype(int)
    fold = np.arange(1200) % 2
    rows = [(f, "test" if fold[i] == f else "train", i, int(y[i]), *map(float, x[i])) for f in range(2) for i in range(1200)]
    table = spark.createDataFrame(rows, "test_fold int, role string, id long, label int, a double, b double, c double")
    run = lambda **kw: {r["id"]: r["score"] for r in models.fold_predictions(table, ["a", "b", "c"], models.Learner("forest", trees=12, tasks=4, **kw)).collect()}
    want = {}
    for f in range(2):
        train, test = fold != f, np.flatnonzero(fold == f)
        want |= dict(zip(test.tolist(), np.mean([models.forest_share(x[train], y[train], x[test], 3, s) for s in range(4)], axis=0)))
    whole = run()
    assert all(whole[i] == pytest.approx(want[i]) for i in range(1200))
    monkeypatch.setattr(models, "SCORED_ROWS", 100)  # many blocks
    assert run() == pytest.approx(whole)
    part = run(most_rows=200)
    ranks = np.corrcoef([part[i] for i in range(1200)], [whole[i] for i in range(1200)])[0, 1]
    assert part.keys() == whole.keys() and part != whole and ranks > 0.85


def test_large_fits_use_the_same_learners(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=900) > 1).astype(int)
    fold = np.arange(900) % 3
    y[fold == 2] = 1  # its test rows have one class
    rows = [(f, "test" if fold[i] == f else "train", i, int(y[i]), *map(float, x[i])) for f in range(3) for i in range(900)]
    folds = spark.createDataFrame(rows, "test_fold int, role string, id long, label int, a double, b double, c double").repartition(4)
    small = {r["id"]: r["score"] for r in models.fold_predictions(folds, ["a", "b", "c"], "logistic").collect()}
    monkeypatch.setattr(models, "DRIVERLESS_ROWS", 100)
    large = {r["id"]: r["score"] for r in models.fold_predictions(folds, ["a", "b", "c"], "logistic").collect()}
    assert large.keys() == small.keys() == {i for i in range(900) if fold[i] < 2}
    assert all(large[i] == pytest.approx(small[i], abs=1e-7) for i in small)
    monkeypatch.setattr(models, "_spread_boosted", lambda rows, features, spread=models._spread_boosted: spread(rows, features, rounds=5, keep=2))
    large = {r["id"]: r["score"] for r in models.fold_predictions(folds, ["a", "b", "c"], "boosting").collect()}
    assert large.keys() == small.keys()
    for f in (0, 1):
        train, test = fold != f, np.flatnonzero(fold == f)
        want = models.boosted(x[train], y[train], x[test], rounds=5)
        apart = np.abs(want - [large[i] for i in test])
        assert np.quantile(apart, 0.98) < 1e-7 and want.std() > 0.01


def test_catalogue_cleaning(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("﻿country_name,location_accuracy,event_id,event_date,longitude,latitude\nNepal,exact,1,08/01/2014 12:00:00 AM,85,28\n\t nepal ,5km,2,1704067200000,85,28\nIndia,1km,3,2014-01-01,80,20\nNEPAL,unknown,4,not a date,85,28\nNepal,50km,5,1704067200000.0,85,x\n", encoding="utf-8")
    found = {r["event_id"]: r for r in catalogue.clean_catalogue(files.read_catalogue(spark, str(path)), "nepal").collect()}
    assert sorted(found) == ["1", "2", "4", "5"]
    assert [found[k]["accuracy_km"] for k in "1245"] == [0, 5, None, 50]
    assert str(found["1"]["event_time"]) == "2014-08-01 00:00:00" and found["4"]["event_time"] is None
    assert str(found["2"]["event_time"]) == str(found["5"]["event_time"]) == "2024-01-01 00:00:00"


def test_feature_adapter_and_pages(spark):
    good = {"geometry": {"coordinates": [85.0, 28.0]}, "properties": {"event_id": 7, "event_date": 1704067200000, "location_accuracy": "5km"}}
    page = json.dumps({"features": [good, {"geometry": {"coordinates": [1.0]}}, {"properties": {}}]})
    rows = files.feature_rows(spark.createDataFrame([(page,)], "payload string"), "Nepal").collect()
    assert len(rows) == 1 and rows[0]["event_id"] == "7" and rows[0]["country_name"] == "Nepal"
    asked = []

    def fetch(endpoint, params):
        asked.append(params.get("resultOffset"))
        return {"count": 3} if "returnCountOnly" in params else {"features": [good] * min(2, 3 - params["resultOffset"])}

    reader = files._Pages({"endpoint": "x", "size": "2"}, fetch)
    pages = [json.loads(p) for part in reader.partitions() for _, p in reader.read(part)]
    assert asked == [None, 0, 2] and sum(len(p["features"]) for p in pages) == 3


def test_gates_and_sinks(spark, tmp_path):
    files.require_years([1991, 1992], 1991, 1992)
    with pytest.raises(ValueError):
        files.require_years([1991], 1991, 1992)
    with pytest.raises(ValueError):
        files.require_count(["a"], 2, "tiles")
    files.write_document(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first()["s"] == "a"
    page = files.map_page(spark.createDataFrame([(1, 85.0, 28.0, 1, 0.9), (2, 84.0, 28.0, 0, 0.1)], "id int, lon double, lat double, label int, score double"))
    assert page.count("<circle") == 2 and "#2c7bb6" in page
    assert page.count("<g id=") == page.count("checkbox") == 2 and page.count("<li") == 4


def test_ways_and_boundaries(spark, tmp_path):
    ways = spark.createDataFrame([(1, {"highway": "track"}, [(0.0, 0.0), (1.0, 1.0)]), (2, {"highway": "primary"}, [(0.0, 0.0), (1.0, 1.0), (2.0, 1.0)]), (3, {"waterway": "river"}, [(0.0, 0.0)])], "way_id int, tags map<string,string>, nodes array<struct<x:double,y:double>>")
    from foldstone.functions.columns import MOTOR_CLASSES, RIVER_CLASSES

    assert files.segments_of(files.ways_of(ways, "highway", MOTOR_CLASSES)).count() == 2
    assert files.ways_of(ways, "waterway", RIVER_CLASSES).count() == 0 and not set(MOTOR_CLASSES) & set(RIVER_CLASSES)
    shape = {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(shape))
    assert files.ring_edges(spark, str(tmp_path / "b.geojson")).count() == 6


def test_first_row_wins_and_accounts(spark):
    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 1, None), ("b", 3, 5.0)], "k string, n int, v double")
    assert {r["k"]: r["v"] for r in catalogue.keep_first(rows, ["k"], ["n"]).collect()} == {"a": None, "b": 5.0}
    assert catalogue.row_account(rows, ["v"]).first().asDict() == {"before": 3, "after": 2, "dropped": 1}
    holes = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (2.0, None)], "a double, b double")
    assert catalogue.complete(holes, ["a", "b"]).count() == 1 and catalogue.complete(holes, ["b"]).count() == 3
    assert catalogue.row_account(holes, ["a"]).first().asDict() == {"before": 4, "after": 2, "dropped": 2}


def test_headline_and_grid(spark):
    assert experiment.grid(spark).count() == 24
    rows = spark.createDataFrame([(5.0, 50, 10, "Random forest"), (5.0, 25, 10, "Random forest")], "cutoff_km double, block_km int, buffer_km int, model string")
    assert experiment.matching(rows, experiment.HEADLINE).count() == 1


def test_streamed_cleaning_equals_batch(spark, tmp_path):
    from foldstone.streaming import events

    rows = spark.createDataFrame([(str(i), "nepal" if i % 2 else "India", "5km", "2020-01-0%d" % (i % 5 + 1)) for i in range(20)], "event_id string, country_name string, location_accuracy string, event_date string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    cleaned = events.cleaned_stream(events.read_events(spark, str(tmp_path / "in"), rows.schema, 1), "nepal")
    run = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("cleaned").count() == catalogue.clean_catalogue(rows, "nepal").count() == 10
    counts = events.daily_counts(cleaned)
    run = counts.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.sql("select sum(n) s from daily").first()["s"] == 10
