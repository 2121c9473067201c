"""TIFF rasters: plain, deflated or LZW blocks, classic and big files, with their grid and by windows.

A file is one task's, which decodes it block by block and keeps one block in memory besides the file's bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldstone.operators.raster import Grid
from foldstone.session import ship

#: Bytes and struct codes of the field types, and the numbers of the tags that are read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 13: 4, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLE, SCALE, TIE, MISSING = 322, 323, 324, 325, 339, 33550, 33922, 42113

Window = tuple[int, int, int, int]


@dataclass(frozen=True)
class Header:
    order: str
    tags: dict[int, tuple]

    @property
    def grid(self) -> Grid:
        scale, tie = self.tags.get(SCALE, (1.0, 1.0, 0.0)), self.tags.get(TIE, (0.0,) * 6)
        return Grid(tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], self.tags[HEIGHT][0], self.tags[WIDTH][0])

    @property
    def missing(self) -> float | None:
        return float(self.tags[MISSING][0]) if MISSING in self.tags else None


def header_of(data: bytes) -> Header:
    """The tags of the first image."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    word, entry, count_code = ("Q", 20, "Q") if big else ("I", 12, "H")
    at = struct.unpack_from(order + word, data, 8 if big else 4)[0]
    n = struct.unpack_from(order + count_code, data, at)[0]
    at += struct.calcsize(order + count_code)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{word}", data, at + entry * i)
        place = at + entry * i + 4 + struct.calcsize(order + word)
        if SIZES.get(kind, 1) * count > struct.calcsize(order + word):
            place = struct.unpack_from(order + word, data, place)[0]
        if kind == 2:
            tags[tag] = (data[place : place + count].split(b"\0")[0].decode(),)
        elif kind in CODES:
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place)
    return Header(order, tags)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, 256 to start anew, 257 to end, and a width that grows one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, width, held, bits, before = list(start), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(start), 9, None
            continue
        if before is None:
            now = table[code]
        else:
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
            width = min(12, (len(table) + 1).bit_length()) if len(table) + 1 >= 1 << width else width
        out.append(now)
        before = now
    return b"".join(out)


def blocks(data: bytes, window: Window | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of the blocks of a file, cut to ``window`` (row, column, height, width)."""
    head = header_of(data)
    tags, order = head.tags, head.order
    width, height, packing = tags[WIDTH][0], tags[HEIGHT][0], tags.get(PACKING, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags.get(BITS, (8,))[0] // 8}")
    unpack = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
    if unpack is None:
        raise ValueError(f"TIFF files packed by method {packing} are not read")
    tiled = TILES in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS, (height,))[0]))
    top, left, bottom, right = (window[0], window[1], window[0] + window[2], window[1] + window[3]) if window else (0, 0, height, width)
    top, left, bottom, right = max(top, 0), max(left, 0), min(bottom, height), min(right, width)
    across = -(-width // tw)
    for i, (start, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES])):
        r, c = i // across * th, i % across * tw
        if r >= bottom or c >= right or r + th <= top or c + tw <= left:
            continue
        rows = th if tiled else min(th, height - r)
        part = np.frombuffer(unpack(data[start : start + size]), dtype, rows * tw).reshape(rows, tw)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        a, b = max(top - r, 0), max(left - c, 0)
        yield r + a, c + b, part[a : bottom - r, b : right - c].astype(dtype.newbyteorder("="))


def decode_tiff(data: bytes, window: Window | None = None) -> tuple[np.ndarray, Header]:
    """The first band, or the window of it, and the header."""
    head = header_of(data)
    top, left, height, width = window or (0, 0, head.grid.height, head.grid.width)
    out = None
    for r, c, part in blocks(data, window):
        if out is None:
            out = np.zeros((height, width), part.dtype)
        out[r - top : r - top + part.shape[0], c - left : c - left + part.shape[1]] = part
    return (np.zeros((height, width)) if out is None else out), head


def read_rasters(spark: SparkSession, paths: str | list[str], window: Window | None = None) -> DataFrame:
    """(path, r, c, v) of TIFF rasters, one task a file; no-data and not-a-number values are NULL. With ``window``, only its
    blocks are decoded; rows and columns stay those of the whole raster."""
    ship(spark)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                missing = header_of(content).missing
                for top, left, whole in blocks(content, window):
                    for r in range(0, len(whole), 64):
                        part = whole[r : r + 64].astype(np.float64)
                        gone = ~np.isfinite(part) if missing is None else ~np.isfinite(part) | (part == missing)
                        rr, cc = np.indices(part.shape)
                        yield pa.RecordBatch.from_pydict({"path": [path] * part.size, "r": pa.array(rr.ravel() + top + r, pa.int64()), "c": pa.array(cc.ravel() + left, pa.int64()), "v": pa.array(part.ravel(), mask=gone.ravel())})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(over, "path string, r long, c long, v double")


def read_grids(spark: SparkSession, paths: str | list[str]) -> dict[str, Grid]:
    """The grid of every file, by path in order: a row a file comes to the driver."""
    ship(spark)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [header_of(content).grid for content in batch.column("content").to_pylist()]
            columns = {f: [getattr(g, f) for g in grids] for f in ("x0", "y0", "dx", "dy", "height", "width")}
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), **columns})

    rows = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(over, "path string, x0 double, y0 double, dx double, dy double, height long, width long").collect()
    return {r["path"]: Grid(r["x0"], r["y0"], r["dx"], r["dy"], r["height"], r["width"]) for r in sorted(rows)}


def read_layers(spark: SparkSession, paths: str | list[str], bounds: tuple[float, float, float, float] | None = None) -> dict[str, tuple[DataFrame, Grid]]:
    """Each file's raster and grid by path, in order; with ``bounds``, only the blocks under them are decoded."""
    grids = read_grids(spark, paths)
    return {path: (read_rasters(spark, [path], grid.window(bounds) if bounds else None).select("r", "c", "v"), grid) for path, grid in grids.items()}
