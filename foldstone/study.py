"""The study from the command line: ``python -m foldstone.study COMMAND``.

``download``, ``features``, ``baselines``, ``draws``, ``leakage`` and ``map`` read and write under one folder: ``--raw`` (or
``FOLDSTONE_RAW``) has the downloads, ``--out`` the tables and reports."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.columns import MOTOR_CLASSES, RIVER_CLASSES, utm_forward
from foldstone.operators import catalogue, experiment, features, models, vector
from foldstone.sources import files, geopackage, osm, tiff

#: Years of rainfall, numbers of tiles, the bounds that rainfall is cut to, and the country.
YEARS, DEM_TILES, COVER_TILES, BOUNDS, COUNTRY = (1991, 2020), 45, 8, (79.9, 26.2, 88.4, 30.6), "nepal"
#: What the web service is asked for.
QUERY = {"where": "1=1", "geometry": "80.0,26.0,89.0,31.0", "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects", "outFields": "*", "returnGeometry": "true"}
TABLE = "label int, abs_set string, event_id string, event_date timestamp, accuracy_km double, longitude double, latitude double, x double, y double, elevation double, slope double, aspect_sin double, aspect_cos double, curvature double, road_dist_km double, river_dist_km double, rain_mm double, " + ", ".join(f"{c} double" for c in features.COVER) + ", inside boolean"


def projected_ways(ways: DataFrame) -> DataFrame:
    """Ways in degrees as ways in metres."""
    def place(p):
        x, y = utm_forward(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return ways.withColumn("nodes", F.transform("nodes", place))


def inputs(spark: SparkSession, raw: str, out: str, events: str) -> features.Inputs:
    """All that the feature table is made from, each source checked for completeness before anything is planned."""
    dem, rain, cover = (files.list_files(spark, f"{raw}/{p}") for p in ("dem/*.tif", "rain/*.tif", "cover/*.tif"))
    files.require_count(dem, DEM_TILES, "elevation tiles")
    files.require_years(files.years_of(rain), *YEARS)
    files.require_count(cover, COVER_TILES, "land-cover tiles")
    lines = {}
    for name, key, keep in (("roads", "highway", MOTOR_CLASSES), ("rivers", "waterway", RIVER_CLASSES)):
        made = geopackage.cached_lines(spark, f"{out}/{name}.gpkg", key, lambda key=key, keep=keep: projected_ways(osm.read_ways(spark, f"{raw}/extract.osm.pbf", key, keep)))
        lines[name] = files.segments_of(made)
    boundary = files.projected(files.ring_edges(spark, f"{raw}/boundary.geojson"))
    grid = features.boundary_grid(boundary)
    from foldstone.operators.raster import annual_mean

    elevation = features.boundary_dem(spark, tiff.read_layers(spark, dem), boundary, grid)
    wet = annual_mean(tiff.read_layers(spark, rain, BOUNDS), BOUNDS)
    cleaned = catalogue.clean_catalogue(files.read_catalogue(spark, events), COUNTRY, ("longitude", "latitude"))
    return features.Inputs(cleaned, boundary, lines["roads"], lines["rivers"], elevation, grid, wet, tiff.read_layers(spark, cover))


def download(spark: SparkSession, args: argparse.Namespace) -> str:
    spark.dataSource.register(files.PagedFeatures)
    pages = spark.read.format("paged_features").options(endpoint=args.endpoint, **QUERY).load()
    rows = files.feature_rows(pages, COUNTRY.title())
    if not rows.limit(1).count():
        raise SystemExit("the service has no events there; look at the endpoint")
    files.write_table(rows, f"{args.raw}/events.csv")
    return f"events in {args.raw}/events.csv"


def build(spark: SparkSession, args: argparse.Namespace) -> str:
    table, far = features.build(inputs(spark, args.raw, args.out, args.catalogue or f"{args.raw}/events.csv"), args.draws)
    if args.draws > 1:
        files.write_table(table.drop("id"), f"{args.out}/features_draws.csv")
        return "features of repeated draws written"
    files.write_table(table.drop("id", "draw"), f"{args.out}/features.csv")
    files.write_document(features.summary(table, far, far.count()), f"{args.out}/features.meta")
    return "features and their summary written"


def _table(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    return files.read_table(spark, path, TABLE + more).withColumn("id", F.monotonically_increasing_id())


def baselines(spark: SparkSession, args: argparse.Namespace) -> str:
    files.write_table(experiment.baselines(_table(spark, f"{args.out}/features.csv")), f"{args.out}/baselines.csv")
    found = spark.read.csv(f"{args.out}/baselines.csv", header=True, inferSchema=True)
    shown = experiment.matching(found, experiment.HEADLINE).orderBy("abs_set", F.desc("spatial_auroc"))
    text = experiment.report(shown, ["abs_set", "model", "spatial_auroc", "spatial_auroc_sd_over_seeds", "random_auroc", "gap", "spatial_prauc", "n_pres", "n_abs"])
    setting = F.concat_ws("_", "cutoff_km", "block_km", "buffer_km")
    wide = found.withColumn("setting", setting)
    names = sorted(r["setting"] for r in wide.select("setting").distinct().collect())  # 24 settings
    for value in ("spatial_auroc", "gap"):
        table = experiment.pivot(wide, ["abs_set", "model"], "setting", names, value)
        text += f"\n\n{value}\n" + experiment.report(table.orderBy("abs_set", "model"), table.columns, 2)
    return text


def draws(spark: SparkSession, args: argparse.Namespace) -> str:
    files.write_table(experiment.absence_variation(_table(spark, f"{args.out}/features_draws.csv", ", draw int")), f"{args.out}/draws.csv")
    found = experiment.draw_summary(spark.read.csv(f"{args.out}/draws.csv", header=True, inferSchema=True))
    return experiment.report(found.orderBy("abs_set", "model"), found.columns)


def leakage(spark: SparkSession, args: argparse.Namespace) -> str:
    table = _table(spark, f"{args.out}/features.csv")
    files.write_table(experiment.leakage(table), f"{args.out}/leakage.csv")
    found = spark.read.csv(f"{args.out}/leakage.csv", header=True, inferSchema=True)
    near = vector.nearest_other(table.where(f"label = 0 or accuracy_km <= {features.CUTOFF_KM}"), "abs_set").join(table.select("id", "abs_set"), "id").where("distance is not null")
    apart = near.groupBy("abs_set").agg(F.count(F.lit(1)).alias("n"), *[(F.percentile("distance", F.lit(q / 100)) / 1000.0).alias(f"p{q}") for q in (10, 50, 90)])
    return experiment.report(found, found.columns) + "\n\nkm to the nearest other place\n" + experiment.report(apart.orderBy("abs_set"), apart.columns, 1)


def draw_map(spark: SparkSession, args: argparse.Namespace) -> str:
    samples = catalogue.one_scheme(_table(spark, f"{args.out}/features.csv"), "road_weighted", features.CUTOFF_KM)
    scored = models.in_sample_scores(samples, experiment.TERRAIN).join(samples.select("id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "label"), "id")
    path = f"{args.out}/map.html"
    with open(path, "w") as page:
        page.write(files.map_page(scored))
    return f"map in {path}"


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], str]] = {"download": download, "features": build, "baselines": baselines, "draws": draws, "leakage": leakage, "map": draw_map}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="foldstone.study", description="Features, experiments and reports of the study.")
    parser.add_argument("command", choices=list(COMMANDS))
    parser.add_argument("--draws", type=int, default=1, help="backgrounds drawn for each scheme; more than one go to a table of their own")
    parser.add_argument("--catalogue", help="events in CSV, if not events.csv of the raw folder")
    parser.add_argument("--raw", default=os.environ.get("FOLDSTONE_RAW", "data/raw"))
    parser.add_argument("--out", default="data/tables")
    parser.add_argument("--endpoint", help="query address of the feature service, for download")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    print(COMMANDS[args.command](spark or SparkSession.builder.appName("foldstone.study").getOrCreate(), args))


if __name__ == "__main__":
    main()
