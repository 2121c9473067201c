"""OpenStreetMap extracts: a data source over the blobs of a PBF file, and ways with the places of their nodes.

``spark.read.format("osm_pbf")`` scans the blob headers once and deals the blobs to partitions; a task reads and unpacks its own
blobs only. Ways name their nodes by id, so places come from a join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foldstone.session import ship

SCHEMA = "kind string, id long, lon double, lat double, tags map<string,string>, refs array<long>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message; of a nested one its bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[wire]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def packed(data: bytes) -> np.ndarray:
    """The integers of a packed field, all at once."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def unsigned(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def blob_data(blob: bytes) -> bytes:
    found = dict(fields(blob))
    if 1 in found:
        return found[1]
    if 3 in found:
        return zlib.decompress(found[3])
    raise ValueError("only plain and deflated blobs are read")


def items(block: bytes, key: str | None = None) -> Iterator[tuple]:
    """The nodes and ways of a block; with ``key``, only ways that have it."""
    parts: dict[int, list] = {}
    for number, value in fields(block):
        parts.setdefault(number, []).append(value)
    strings = [v.decode("utf-8", "replace") for n, v in fields(parts[1][0]) if n == 1]
    step, lat0, lon0 = (parts.get(n, [default])[0] for n, default in ((17, 100), (19, 0), (20, 0)))
    degrees = lambda origin, value: 1e-9 * (origin + step * value)
    for group in parts.get(2, ()):
        for number, value in fields(group):
            if number == 1:
                node = dict(fields(value))
                yield "node", unsigned(node[1]), degrees(lon0, unsigned(node[9])), degrees(lat0, unsigned(node[8])), None, None
            elif number == 2:
                dense = dict(fields(value))
                ids, lats, lons = (np.cumsum(signed(packed(dense[n]))) for n in (1, 8, 9))
                for i, x, y in zip(ids.tolist(), degrees(lon0, lons).tolist(), degrees(lat0, lats).tolist()):
                    yield "node", i, x, y, None, None
            elif number == 3:
                way = dict(fields(value))
                names, texts = (packed(way.get(n, b"")).tolist() for n in (2, 3))
                tags = {strings[k]: strings[v] for k, v in zip(names, texts)}
                if key is None or key in tags:
                    yield "way", way[1], None, None, tags, np.cumsum(signed(packed(way.get(8, b"")))).tolist()


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def blob_places(path: str) -> list[tuple[int, int]]:
    """(offset, size) of every data blob: the headers are read, the blobs are skipped."""
    out, at = [], 0
    with _opened(path) as file:
        end = file.size()
        while at < end:
            size = int.from_bytes(file.read_at(4, at), "big")
            head = dict(fields(file.read_at(size, at + 4)))
            at += 4 + size
            if head[1] == b"OSMData":
                out.append((at, head[3]))
            at += head[3]
    return out


class Extract(DataSource):
    """Options: ``path``; ``key``, so that only ways with this key are read; ``blobs`` a partition."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Blobs(dict(self.options))


class _Blobs(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.key, self.each = options["path"], options.get("key"), int(options.get("blobs", 16))

    def partitions(self) -> list[InputPartition]:
        places = blob_places(self.path)
        return [InputPartition(places[i : i + self.each]) for i in range(0, len(places), self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(self.path) as file:
            for at, size in partition.value:
                yield from items(blob_data(file.read_at(size, at)), self.key)


def read_extract(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Extract)
    reader = spark.read.format("osm_pbf").option("path", path)
    return (reader.option("key", key) if key else reader).load()


def read_ways(spark: SparkSession, path: str, key: str, keep: tuple[str, ...]) -> DataFrame:
    """(way_id, kind, nodes: array of x, y in degrees) of the ways whose ``key`` is one of ``keep``. Ways with nodes outside the extract
    are left out, as are those of fewer than two."""
    found = read_extract(spark, path, key)
    ways = found.where((F.col("kind") == "way") & F.col("tags")[key].isin(*keep) & (F.size("refs") >= 2))
    ways = ways.select(F.col("id").alias("way_id"), F.col("tags")[key].alias("kind"), F.size("refs").alias("n"), F.posexplode("refs").alias("at", "ref"))
    nodes = found.where("kind = 'node'").select(F.col("id").alias("ref"), "lon", "lat")
    met = ways.join(nodes, "ref").groupBy("way_id", "kind", "n").agg(F.array_sort(F.collect_list(F.struct("at", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("nodes"))
    return met.where(F.size("nodes") == F.col("n")).select("way_id", "kind", F.transform("nodes", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("nodes"))
