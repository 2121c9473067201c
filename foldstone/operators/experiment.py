"""Experiments: the registry of models, the runner, and tables of results (grids, summaries, paired deltas, pivots, frames).

The runner plans all settings and seeds as one set of tables: which rows belong to which set, the folds of every (set, seed,
block size), and the roles of rows in every fold. Folds do not depend on the model, nor random ones on blocks and
buffers, so each is made once, and a random fold is fitted once for all settings of its set.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstone.functions.columns import COVER_GROUPS
from foldstone.operators import folds, metrics, models
from foldstone.operators.models import Learner
from foldstone.session import materialize

#: The settings of the full grid, and the headline setting.
GRID = {"abs_set": ("uniform", "road_weighted"), "cutoff_km": (5.0, 10.0), "block_km": (25, 50, 100), "buffer_km": (0, 10)}
HEADLINE = {"cutoff_km": 5.0, "block_km": 50, "buffer_km": 10}
#: Words of model names and their short forms.
SHORT = (("Random forest", "RF"), ("Gradient boosting", "GB"))


#: Feature columns by theme.
TERRAIN = ["elevation", "slope", "aspect_sin", "aspect_cos", "curvature"]
COVER = list(COVER_GROUPS)
ROAD, RIVER, RAIN = ["log_road_dist"], ["log_river_dist"], ["rain_mm"]
_LOGISTIC, _FOREST, _BOOSTING = Learner("logistic"), Learner("forest"), Learner("boosting")

#: The models of the full study, by name: their features and what is fitted.
MODELS: dict[str, tuple[list[str], Learner]] = {
    "Slope only (logistic)": (["slope"], _LOGISTIC),
    "Elevation only (logistic)": (["elevation"], _LOGISTIC),
    "Logistic regression": (TERRAIN, _LOGISTIC),
    "Random forest": (TERRAIN, _FOREST),
    "Random forest + road distance (ablation)": (TERRAIN + ROAD, _FOREST),
    "Road distance only (logistic)": (ROAD, _LOGISTIC),
    "Random forest + river distance": (TERRAIN + RIVER, _FOREST),
    "River distance only (logistic)": (RIVER, _LOGISTIC),
    "Random forest + road + river distance": (TERRAIN + ROAD + RIVER, _FOREST),
    "Random forest + rainfall": (TERRAIN + RAIN, _FOREST),
    "Random forest + land cover": (TERRAIN + COVER, _FOREST),
    "Random forest + rainfall + land cover": (TERRAIN + RAIN + COVER, _FOREST),
    "Rainfall only (logistic)": (RAIN, _LOGISTIC),
    "Land cover only (forest)": (COVER, _FOREST),
    "Gradient boosting": (TERRAIN, _BOOSTING),
    "Gradient boosting + land cover": (TERRAIN + COVER, _BOOSTING),
    "Gradient boosting + rainfall + land cover": (TERRAIN + RAIN + COVER, _BOOSTING),
}
#: The models of the study of background draws, and what is left out of one more.
DRAW_MODELS = ("Slope only (logistic)", "Logistic regression", "Random forest", "Random forest + road distance (ablation)", "Random forest + rainfall", "Random forest + land cover", "Gradient boosting", "Gradient boosting + land cover")
ACCESS = ("lc_built", "lc_crop")
#: The feature sets and block sizes (km) of the study of leakage; the middle set runs at the headline blocks only.
LEAKS = {"terrain": TERRAIN, "terrain + x, y": [*TERRAIN, "x", "y"], "x, y only": ["x", "y"]}
LEAK_BLOCKS = (50, 100, 200)


def with_logs(table: DataFrame) -> DataFrame:
    """The feature table with the logarithms of its two distances, 10 m added."""
    return table.withColumns({f"log_{c}_dist": F.ln(F.col(f"{c}_dist_km") + 0.01) for c in ("road", "river") if f"{c}_dist_km" in table.columns})


def in_sets(table: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """A row of ``table`` for every set whose predicate it meets, named in ``set``."""
    names = F.array_compact(F.array(*[F.when(met, F.lit(name)) for name, met in sets.items()]))
    return table.withColumn("set", F.explode(names))


def scheme_sets(schemes: tuple[str, ...], cutoffs: tuple[float, ...]) -> dict[str, Column]:
    """For each scheme and cutoff, the presences located to within it and the background of the scheme."""
    return {f"{s}:{c}": ((F.col("label") == 1) & (F.col("accuracy_km") <= c)) | (F.col("abs_set") == s) for s, c in product(schemes, cutoffs)}


def cross_validated(table: DataFrame, sets: dict[str, Column], settings: list[tuple[str, int, int]], registry: dict[str, tuple[list[str], Learner]], seeds: tuple[int, ...], k: int = 5) -> DataFrame:
    """One row for each setting (set, block_km, buffer_km), model and seed: means over scored folds of AUROC and average
    precision, random and spatial, their gap, the folds scored, and the numbers of presences and backgrounds.

    ``table``: id, label, x, y and the features. A setting of which no fold can be scored is an error.
    """
    spark = table.sparkSession
    wanted = sorted({f for features, _ in registry.values() for f in features if f not in ("x", "y")})
    rows = materialize(in_sets(table, sets).select("set", F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in wanted]), "sets")
    places = rows.select("set", "id", "label", "x", "y")
    spatial = [(n, s, b, u, seed) for n, ((s, b, u), seed) in enumerate(product(settings, seeds))]
    random = [(n, s, seed) for n, (s, seed) in enumerate(product(dict.fromkeys(s for s, *_ in settings), seeds), len(spatial))]
    plans = spark.createDataFrame(spatial, "job int, set string, block_km int, buffer_km int, seed int")
    draws = spark.createDataFrame(random, "job int, set string, seed int")
    by_block = folds.spatial_folds(places.join(F.broadcast(plans), "set"), F.col("block_km") * 1000.0, k, F.col("seed"), ["job"])
    training = folds.buffered_training(by_block, k, F.col("buffer_km") * 1000.0, ["job"])
    by_draw = folds.stratified_folds(places.join(F.broadcast(draws), "set"), k, F.col("seed"), by=["job"])
    keep = ["job", "set", "id", "label", "x", "y"]
    roles = [models.roles(found.select(*keep, "fold"), used.select(*keep, "fold", "test_fold")) for found, used in ((by_block, training), (by_draw, folds.buffered_training(by_draw, k, 0.0)))]
    roles = materialize(roles[0].unionByName(roles[1]).select("set", "id", (F.col("job") * k + F.col("test_fold")).alias("test_fold"), "role"), "roles")
    scored = None
    for name, (features, learner) in registry.items():
        table_of = roles.join(rows, ["set", "id"]).select("test_fold", "role", "id", "label", *features)
        found = metrics.fold_scores(models.fold_predictions(table_of, features, learner), ["test_fold"]).withColumn("model", F.lit(name))
        scored = found if scored is None else scored.unionByName(found)
    means = scored.groupBy("model", F.floor(F.col("test_fold") / k).cast("int").alias("job")).agg(F.avg("auroc").alias("auroc"), F.avg("ap").alias("prauc"), F.count(F.lit(1)).cast("int").alias("folds"))
    means = materialize(means, "means")
    if means.count() < len(registry) * (len(spatial) + len(random)):
        raise ValueError(f"{metrics.NOTHING_SCORED} in one of the settings; take another block size or buffer")
    counts = rows.groupBy("set").agg(F.sum("label").cast("int").alias("n_pres"), F.sum(1 - F.col("label")).cast("int").alias("n_abs"))
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("auroc", "prauc", "folds")]
    ours = means.join(F.broadcast(plans), "job").select("set", "block_km", "buffer_km", "seed", "model", *side("spatial"))
    theirs = means.join(F.broadcast(draws), "job").select("set", "seed", "model", *side("random"))
    return ours.join(theirs, ["set", "seed", "model"]).join(F.broadcast(counts), "set").withColumn("gap", F.col("random_auroc") - F.col("spatial_auroc"))


def over_seeds(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means over the seeds, and the population deviation of the spatial score."""
    means = [F.avg(c).alias(c) for c in ("random_auroc", "spatial_auroc", "gap", "random_prauc", "spatial_prauc")]
    found = scores.groupBy(*by).agg(F.max("n_pres").alias("n_pres"), F.max("n_abs").alias("n_abs"), *means, F.stddev_pop("spatial_auroc").alias("spatial_auroc_sd_over_seeds"), F.avg("spatial_folds").alias("spatial_folds_scored"))
    return found


def baselines(table: DataFrame, registry: dict[str, tuple[list[str], Learner]] = MODELS, settings: dict[str, tuple] = GRID, seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """The full study: every model under every setting of the grid, averaged over the seeds."""
    sets = scheme_sets(settings["abs_set"], settings["cutoff_km"])
    plans = [(s, b, u) for s in sets for b in settings["block_km"] for u in settings["buffer_km"]]
    found = over_seeds(cross_validated(with_logs(table), sets, plans, registry, seeds), ["set", "model", "block_km", "buffer_km"])
    name = F.split("set", ":")
    return found.select(name[0].alias("abs_set"), "model", name[1].cast("double").alias("cutoff_km"), *[c for c in found.columns if c not in ("set", "model")])


def absence_variation(table: DataFrame, registry: dict[str, tuple[list[str], Learner]] | None = None, seed: int = 0) -> DataFrame:
    """The headline setting on every (abs_set, draw) of a table of repeated draws: spatial AUROC and gap of each model."""
    if registry is None:
        extra = {"Random forest + land cover (no built, crop)": (TERRAIN + [c for c in COVER if c not in ACCESS], _FOREST)}
        registry = {name: MODELS[name] for name in DRAW_MODELS} | extra
    drawn = [tuple(r) for r in table.where("label = 0").select("abs_set", "draw").distinct().orderBy("abs_set", "draw").collect()]  # a row a draw
    near = (F.col("label") == 1) & (F.col("accuracy_km") <= HEADLINE["cutoff_km"])
    sets = {f"{s}:{d}": near | ((F.col("label") == 0) & (F.col("abs_set") == s) & (F.col("draw") == d)) for s, d in drawn}
    plans = [(s, HEADLINE["block_km"], HEADLINE["buffer_km"]) for s in sets]
    found = cross_validated(with_logs(table), sets, plans, registry, (seed,))
    name = F.split("set", ":")
    return found.select(name[0].alias("abs_set"), name[1].cast("int").alias("draw"), "model", "n_abs", "spatial_auroc", "gap")


def leakage(table: DataFrame, sets_of: dict[str, list[str]] = LEAKS, blocks: tuple[int, ...] = LEAK_BLOCKS, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), learner: Learner = _FOREST) -> DataFrame:
    """Features against bare coordinates, at several block sizes: what random folds reward and spatial ones do not."""
    sets = scheme_sets(GRID["abs_set"], (HEADLINE["cutoff_km"],))
    both = list(sets_of)[1:-1]  # neither the first nor the last: at the headline blocks only
    wide = {name: (features, learner) for name, features in sets_of.items() if name not in both}
    near = {name: (sets_of[name], learner) for name in both}
    run = lambda registry, sizes: over_seeds(cross_validated(table, sets, [(s, b, HEADLINE["buffer_km"]) for s in sets for b in sizes], registry, seeds), ["set", "block_km", "model"])
    found = run(wide, blocks)
    if near:
        found = found.unionByName(run(near, [b for b in blocks if b == HEADLINE["block_km"]]))
    return found.select(F.split("set", ":")[0].alias("abs_set"), "block_km", F.col("model").alias("features"), "random_auroc", "spatial_auroc", "gap", "spatial_folds_scored")


def report(rows: DataFrame, columns: list[str], digits: int = 3, most: int = 1000) -> str:
    """A rounded table as text, for the console; at most ``most`` rows are fetched, and the text says if there are more."""
    kinds = dict(rows.dtypes)
    shown = rows.select(*[F.bround(F.col(f"`{c}`"), digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in columns]).limit(most + 1).collect()
    cells = [columns, *[["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in shown[:most]]]
    widths = [max(map(len, column)) for column in zip(*cells)]
    lines = ["  ".join(v.rjust(w) for v, w in zip(row, widths)) for row in cells]
    return "\n".join(lines + ["..."] * (len(shown) > most))


def grid(spark: SparkSession, settings: dict[str, tuple] = GRID) -> DataFrame:
    """Every combination of the settings."""
    return spark.createDataFrame(list(product(*settings.values())), list(settings)).coalesce(1)


def draw_summary(runs: DataFrame, value: str = "spatial_auroc") -> DataFrame:
    """Mean, sample deviation, least, most and count of a score over draws, rounded half to even."""
    agg = [F.bround(F.avg(value), 3).alias("mean"), F.bround(F.stddev_samp(value), 3).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("draws")]
    return runs.groupBy("abs_set", "model").agg(*agg)


def paired_delta(runs: DataFrame, base: str, value: str = "spatial_auroc") -> DataFrame:
    """Each model's mean difference from ``base`` on the same draw, and on how many draws it is ahead."""
    ref = runs.where(F.col("model") == base).select("abs_set", "draw", F.col(value).alias("ref"))
    met = runs.where(F.col("model") != base).join(ref, ["abs_set", "draw"]).withColumn("delta", F.col(value) - F.col("ref"))
    return met.groupBy("abs_set", "model").agg(F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count(F.lit(1)).alias("draws"))


def pivot(runs: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    """The mean of ``value`` by index, one column ``v_<value>`` for each listed value of ``column``."""
    return runs.groupBy(*index).agg(*[F.avg(F.when(F.col(column) == v, F.col(value))).alias(f"v_{v}") for v in values])


def matching(rows: DataFrame, setting: dict) -> DataFrame:
    """Rows that have all the values of a setting."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in setting.items()]))


def short_name(model: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SHORT, model)


def jitter(runs: DataFrame, by: list[str], order: str, width: float = 0.1) -> DataFrame:
    """Rows of each group spread evenly from -width to width in the given order."""
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(group)
    return runs.withColumn("jitter", F.when(n > 1, -width + 2 * width * place / (n - 1)).otherwise(-width))


def in_order(rows: DataFrame, column: str, wanted: list) -> DataFrame:
    """One row for each wanted value with its ``position``; those without rows have NULLs."""
    spark = rows.sparkSession
    names = spark.createDataFrame(list(enumerate(wanted)), f"position int, {column} string")
    return names.join(rows, column, "left")


def seed_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Means over seeds, population deviation of the spatial score, and the mean gap."""
    return runs.groupBy(*by).agg(F.avg("random_auroc").alias("random_auroc"), F.avg("spatial_auroc").alias("spatial_auroc"), F.stddev_pop("spatial_auroc").alias("spatial_auroc_sd"), F.avg(F.col("random_auroc") - F.col("spatial_auroc")).alias("gap"))


def page_offsets(count: DataFrame, size: int) -> DataFrame:
    """The offsets of the pages that hold ``n`` records."""
    return count.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(size).cast("bigint"))).alias("offset"))
