"""Readers and writers: catalogues, features of the web service, ways, boundaries, tables, gates, documents and maps."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foldstone.functions.columns import colour, two_digits, utm_forward

CATALOGUE = ("country_name", "location_accuracy", "event_id", "event_date", "longitude", "latitude")
_FEATURE = "struct<geometry:struct<coordinates:array<double>>,properties:struct<event_id:string,event_date:string,location_accuracy:string,event_import_source:string,source_name:string,source_link:string>>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue CSV, with or without a byte-order mark before its header. All columns are text but the coordinates."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    named = raw.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in raw.columns])
    return named.select(*[F.col(c).try_cast("double").alias(c) if c in ("longitude", "latitude") else F.col(c) for c in CATALOGUE])


def feature_rows(pages: DataFrame, country: str, column: str = "payload") -> DataFrame:
    """Catalogue rows of GeoJSON pages (text): features with less than two coordinates are left out."""
    parsed = pages.select(F.from_json(column, f"struct<features:array<{_FEATURE}>>").alias("p"))
    each = parsed.select(F.explode("p.features").alias("f")).where(F.size("f.geometry.coordinates") >= 2)
    props = [F.col(f"f.properties.{c}").alias(c) for c in ("event_id", "event_date", "location_accuracy", "event_import_source", "source_name", "source_link")]
    return each.select(*props[:2], F.col("f.geometry.coordinates")[0].alias("longitude"), F.col("f.geometry.coordinates")[1].alias("latitude"), props[2], F.lit(country).alias("country_name"), *props[3:])


def request(endpoint: str, params: dict) -> dict:
    """One reply of the service; an error envelope becomes an exception."""
    with urlopen(f"{endpoint}?{urlencode(params)}", timeout=60) as reply:
        payload = json.load(reply)
    if "error" in payload:
        raise RuntimeError(f"The request failed: {payload['error']}")
    return payload


class PagedFeatures(DataSource):
    """``spark.read.format("paged_features")``: one partition a page, each fetched by its own task.

    Options: endpoint, size (records a page), and any further parameters of the query. ``fetch`` may be replaced.
    """

    fetch: Callable[[str, dict], dict] = staticmethod(request)

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "offset long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options), type(self).fetch)


class _Pages(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, dict], dict]) -> None:
        self.endpoint, self.size = options.pop("endpoint"), int(options.pop("size", 2000))
        self.params, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        count = self.fetch(self.endpoint, {**self.params, "returnCountOnly": "true", "f": "json"})["count"]
        return [InputPartition(offset) for offset in range(0, count, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        page = self.fetch(self.endpoint, {**self.params, "resultOffset": partition.value, "resultRecordCount": self.size, "f": "geojson"})
        yield partition.value, json.dumps(page)


def ways_of(ways: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Ways (way_id, tags: map, nodes: array of x, y) with a wanted value of a key, and at least two nodes."""
    return ways.select("way_id", F.col("tags")[key].alias("kind"), "nodes").where(F.col("kind").isin(*keep) & (F.size("nodes") >= 2))


def segments_of(ways: DataFrame) -> DataFrame:
    """The segments (way_id, kind, x0, y0, x1, y1) of ways."""
    each = ways.select("way_id", "kind", "nodes", F.explode(F.sequence(F.lit(1), F.size("nodes") - 1)).alias("i"))
    a, b = F.element_at("nodes", F.col("i")), F.element_at("nodes", F.col("i") + 1)
    return each.select("way_id", "kind", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))


def ring_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges (part, ring, i, x0, y0, x1, y1) of the polygons of a GeoJSON file, in its own coordinates."""
    whole = spark.read.text(path, wholetext=True)
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    geometry = whole.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.geometry.type", "f.geometry.coordinates")
    rings = "array<array<array<double>>>"
    parts = geometry.select(F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{rings}>")).otherwise(F.array(F.from_json("coordinates", rings))).alias("parts"))
    each = parts.select(F.posexplode("parts").alias("part", "rings")).select("part", F.posexplode("rings").alias("ring", "points")).select("part", "ring", "points", F.explode(F.sequence(F.lit(1), F.size("points") - 1)).alias("i"))
    a, b = F.element_at("points", F.col("i")), F.element_at("points", F.col("i") + 1)
    return each.select("part", "ring", "i", a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1"))


def projected(edges: DataFrame) -> DataFrame:
    """Edges in degrees as edges in metres; further columns stay."""
    (x0, y0), (x1, y1) = utm_forward(F.col("x0"), F.col("y0")), utm_forward(F.col("x1"), F.col("y1"))
    return edges.withColumns({"x0": x0, "y0": y0, "x1": x1, "y1": y1})


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of results or features in CSV with a header, by its schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_table(rows: DataFrame, path: str) -> None:
    """``rows`` as CSV with a header: a folder, or one file where ``path`` ends in .csv (reports; written by one task)."""
    if not path.endswith(".csv"):
        rows.write.mode("overwrite").csv(path, header=True)
        return
    spark = rows.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    rows.coalesce(1).write.csv(part, header=True)
    paths = spark._jvm.org.apache.hadoop.fs
    system = paths.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    (written,) = list_files(spark, f"{part}/part-*")
    system.delete(paths.Path(path), False)
    system.rename(paths.Path(written), paths.Path(path))
    system.delete(paths.Path(part), True)


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern with stars meets, in order, on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or ())


def years_of(paths: list[str]) -> list[int]:
    """The years that file names end in, before the extension."""
    return [int(p.rsplit(".", 2)[-2][-4:]) for p in paths]


def require_years(found: list[int], first: int, last: int) -> None:
    """Raise unless ``found`` is exactly every year from ``first`` to ``last``."""
    if sorted(found) != list(range(first, last + 1)):
        raise ValueError(f"one file a year from {first} to {last} is needed; the years there are {sorted(found)}")


def require_count(names: list[str], expected: int, what: str) -> None:
    if len(names) != expected:
        raise ValueError(f"{expected} {what} are needed; there are {len(names)}")


def write_document(summary: DataFrame, path: str) -> None:
    """One row as a JSON document."""
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: The layers of a map and what their marks look like: radius, outline, opacity.
LAYERS = {0: ("Scores at background places", 3, "none", 0.55), 1: ("Reported events", 4, "#1b1b1b", 0.9)}
LEGEND = (("#7b3294", "reported event"), ("#2c7bb6", "score below a third"), ("#fdae61", "a third to two thirds"), ("#d7191c", "above two thirds"))


def map_page(samples: DataFrame, most: int = 10_000) -> str:
    """A page that draws samples (id, lon, lat, label, score) as coloured marks, in one layer for each label that can be shown or hidden,
    with a legend; refuses more than ``most`` rows."""
    rows = samples.select("id", "lon", "lat", "label", two_digits(F.col("score")).alias("score"), colour(F.col("score")).alias("colour")).orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"A map shows at most {most} samples.")
    marks: dict[int, list[str]] = {label: [] for label in LAYERS}
    for r in rows:
        _, radius, outline, opacity = LAYERS[r["label"]]
        x, y = 10 + (r["lon"] - 80.0) * 100, 10 + (30.7 - r["lat"]) * 110
        said = ("Reported event" if r["label"] else "Background sample") + f", score {r['score']}"
        fill = LEGEND[0][0] if r["label"] else r["colour"]
        marks[r["label"]].append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="{radius}" fill="{fill}" stroke="{outline}" fill-opacity="{opacity}"><title>{html.escape(said)}</title></circle>')
    switches = "".join(f'<label><input type="checkbox" checked onchange="document.getElementById(\'layer{k}\').style.display=this.checked?\'\':\'none\'"> {name}</label> ' for k, (name, *_) in LAYERS.items())
    layers = "".join(f'<g id="layer{k}">{"".join(marks[k])}</g>' for k in LAYERS)
    legend = "".join(f'<li style="color:{fill}">&#9679; <span style="color:black">{text}</span></li>' for fill, text in LEGEND)
    return f'<!doctype html><title>Model scores</title>{switches}<svg viewBox="0 0 870 520">{layers}</svg><ul style="list-style:none">{legend}</ul><p>Scores of sampled places by a model of the terrain; neither a surface nor a forecast.</p>'
