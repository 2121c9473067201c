"""Lines in GeoPackage files: one SQLite file, read by one task and written row by row."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldstone.session import ship

_LINE, _LINES = 2, 5
#: Bytes of the envelope after the head of a geometry, by the number in its flags.
_ENVELOPES = (0, 32, 48, 48, 64)
_ARROW = pa.schema([("way_id", pa.int64()), ("kind", pa.string()), ("nodes", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])
SCHEMA = "way_id long, kind string, nodes array<struct<x:double,y:double>>"


def lines_of(blob: bytes) -> list[list[tuple[float, float]]]:
    """The lines of a geometry; none of other kinds."""
    return _lines(blob, 8 + _ENVELOPES[blob[3] >> 1 & 7])[0]


def _lines(data: bytes, at: int) -> tuple[list[list[tuple[float, float]]], int]:
    order = "<" if data[at] else ">"
    kind, n = struct.unpack_from(order + "II", data, at + 1)
    at += 9
    if kind == _LINE:
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        return [list(zip(flat[::2], flat[1::2]))], at + 16 * n
    if kind == _LINES:
        out = []
        for _ in range(n):
            more, at = _lines(data, at)
            out += more
        return out, at
    return [], len(data)


def blob_of(line: list[tuple[float, float]], srs: int) -> bytes:
    return struct.pack("<2sBBi", b"GP", 0, 1, srs) + struct.pack("<BII", 1, _LINE, len(line)) + struct.pack(f"<{2 * len(line)}d", *(v for p in line for v in p))


def read_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(way_id, kind, nodes) of the lines of every feature layer that has a column ``key``."""
    ship(spark)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with sqlite3.connect(":memory:") as base:
                    base.deserialize(content)
                    quoted = lambda x: '"' + x.replace('"', '""') + '"'
                    for table, column in base.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
                        if key not in [r[1] for r in base.execute(f"pragma table_info({quoted(table)})")]:
                            continue
                        rows = base.execute(f"select rowid, {quoted(key)}, {quoted(column)} from {quoted(table)} where {quoted(column)} is not null")
                        while part := rows.fetchmany(2000):
                            each = [{"way_id": i, "kind": kind, "nodes": [{"x": x, "y": y} for x, y in line]} for i, kind, blob in part for line in lines_of(blob)]
                            yield pa.RecordBatch.from_pylist(each, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(over, SCHEMA)


def write_lines(lines: DataFrame, path: str, key: str, srs: int = 32645, layer: str = "lines") -> int:
    """Write lines (kind, nodes) as a layer; rows come to the driver a partition at a time. Returns how many were written."""
    if os.path.exists(path):
        os.remove(path)
    count = 0
    with sqlite3.connect(path) as base:
        base.executescript(
            f"""pragma application_id = 1196444487;
            create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
            create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, srs_id integer);
            create table gpkg_geometry_columns (table_name text primary key, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null);
            create table "{layer}" (fid integer primary key autoincrement, geom blob, "{key}" text);"""
        )
        base.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srs}", srs, srs))
        base.execute("insert into gpkg_contents values (?, 'features', ?, ?)", (layer, layer, srs))
        base.execute("insert into gpkg_geometry_columns values (?, 'geom', 'LINESTRING', ?, 0, 0)", (layer, srs))
        for row in lines.select("kind", "nodes").toLocalIterator():
            base.execute(f'insert into "{layer}" (geom, "{key}") values (?, ?)', (blob_of([(p["x"], p["y"]) for p in row["nodes"]], srs), row["kind"]))
            count += 1
    base.close()
    return count


def cached_lines(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The lines of ``path``, made and written first where there is no such file."""
    if not os.path.exists(path):
        write_lines(make(), path, key)
    return read_lines(spark, path, key)
