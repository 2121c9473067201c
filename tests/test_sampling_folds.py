import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import folds, metrics, sampling


def cells(spark, n=400):
    return spark.range(n).select("id", F.when(F.col("id") % 40 < 10, 1.0).otherwise(0.0).alias("w"))


def test_samples_are_distinct_and_follow_weights(spark):
    got = [r["id"] for r in sampling.sample_cells(cells(spark), 50, 3).collect()]
    assert len(set(got)) == 50
    assert sampling.sample_cells(cells(spark), 50, 3, "w").where("w = 0").count() == 0


@pytest.mark.parametrize("weight,n,said", [(None, 500, "500 .* from 400"), ("z", 5, "no cell .* weight above zero"), ("w", 200, "200 .* that have a weight")])
def test_sample_errors(spark, weight, n, said):
    with pytest.raises(ValueError, match=said):
        sampling.sample_cells(cells(spark).withColumn("z", F.lit(0.0)), n, 0, weight)


def test_matched_weights_match_the_profile(spark):
    rng = np.random.default_rng(0)
    background = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.random(20000) * 60)], "id int, km double")
    near = [(float(v),) for v in rng.random(150) * 0.15] + [(0.15 + float(v) * 2.85,) for v in rng.random(50)]
    presences = spark.createDataFrame(near, "km double")
    weights = sampling.matched_weights(background, presences)
    total = weights.agg(F.sum("weight")).first()[0]
    share = {r["bin"]: r["s"] / total for r in weights.groupBy("bin").agg(F.sum("weight").alias("s")).collect()}
    wanted = {r["bin"]: r["share"] for r in sampling.bin_shares(presences).collect()}
    assert all(abs(share.get(b, 0) - s) < 0.02 for b, s in wanted.items())


def test_empty_bins_weigh_nothing(spark):
    background = spark.createDataFrame([(0, 0.05), (1, 0.4), (2, 30.0), (3, 45.0)], "id int, km double")
    found = {r["id"]: r["weight"] for r in sampling.matched_weights(background, spark.createDataFrame([(0.02,), (0.08,), (0.3,)], "km double")).collect()}
    assert found[2] == 0 and found[3] == 0 and found[0] > 0 and found[1] > 0
    far = sampling.matched_weights(spark.createDataFrame([(0, 0.05)], "id int, km double"), spark.createDataFrame([(0.02,), (5.0,)], "km double"))
    assert np.isfinite(far.first()["weight"])


def test_bin_shares_have_all_bins(spark):
    found = sampling.bin_shares(spark.createDataFrame([(0.01,), (0.02,), (0.7,), (3.0,)], "km double")).orderBy("bin").collect()
    assert len(found) == 10 and found[0]["share"] == 0.5 and sum(r["share"] for r in found) == 1


def points(spark, n, extent, seed=0):
    xy = np.random.default_rng(seed).random((n, 2)) * extent
    return spark.createDataFrame([(i, int(i % 3 == 0), float(x), float(y)) for i, (x, y) in enumerate(xy)], "id int, label int, x double, y double")


def test_blocks_are_never_split_and_buffers_hold(spark):
    dealt = folds.spatial_folds(points(spark, 400, 1e5), 2e4, 4)
    assert dealt.groupBy(F.floor(F.col("x") / 2e4), F.floor(F.col("y") / 2e4)).agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    every = dealt.toPandas()
    kept = folds.buffered_training(dealt, 4, 3000.0).toPandas()
    for fold in range(4):
        test, train = every[every.fold == fold], every[every.fold != fold]
        apart = np.hypot(train.x.values[:, None] - test.x.values, train.y.values[:, None] - test.y.values).min(axis=1)
        assert set(train.id[apart > 3000]) == set(kept[kept.test_fold == fold].id)


def test_too_few_blocks(spark):
    with pytest.raises(ValueError, match="5 folds need 5 blocks"):
        folds.spatial_folds(points(spark, 50, 1000), 1e4)


def test_stratified_folds_are_balanced(spark):
    sizes = folds.stratified_folds(points(spark, 303, 1e5), 5, 1).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    rows = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, s)] + [("one class", 1, 0.5)], "k string, y int, score double")
    p, n = s[y == 1], s[y == 0]
    won = (p[:, None] > n).sum() + (p[:, None] == n).sum() / 2
    found = metrics.auroc(rows, ["k"]).collect()
    assert [r["k"] for r in found] == ["a"] and found[0]["auroc"] == pytest.approx(won / len(p) / len(n))
    cuts = sorted(set(s), reverse=True)
    ap = sum(((y == 1) & (s == c)).sum() * y[s >= c].mean() for c in cuts) / y.sum()
    assert metrics.average_precision(rows, ["k"]).first()["ap"] == pytest.approx(ap)


def test_no_fold_scored(spark):
    rows = spark.createDataFrame([("random", 0, 1, 0.5), ("spatial", 0, 0, 0.1)], "kind string, fold int, y int, score double")
    with pytest.raises(ValueError, match="No fold contained both classes"):
        metrics.compare(rows)
