import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.functions.columns import MOTOR_CLASSES, utm_forward
from foldstone.operators import raster
from foldstone.operators.raster import Grid
from foldstone.sources import files, geopackage, osm, tiff


def lzw(data):
    """Codes of 9 to 12 bits, highest bit first, the width growing one code early."""
    table, width, out, bits, held = {bytes([i]): i for i in range(256)}, 9, [(256, 9)], 0, b""
    size = 258
    for byte in data:
        now = held + bytes([byte])
        if now in table:
            held = now
            continue
        out.append((table[held], width))
        table[now], size = size, size + 1
        if size >= (1 << width):
            width += 1
        if size >= 4094:
            out.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        held = bytes([byte])
    out += [(table[held], width), (257, width)]
    text = "".join(format(code, f"0{w}b") for code, w in out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def tiff_file(grid, packing=1, rows=None, tile=None, big=False, order="<", place=None, missing=None, predict=False):
    """A TIFF file of one band."""
    height, width = grid.shape
    kind = {"f": 3, "u": 1, "i": 2}[grid.dtype.kind]
    rows = rows or height
    parts = []
    if tile:
        for r in range(0, height, tile):
            for c in range(0, width, tile):
                part = np.zeros((tile, tile), grid.dtype)
                cut = grid[r : r + tile, c : c + tile]
                part[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(part)
    else:
        parts = [grid[r : r + rows] for r in range(0, height, rows)]
    raw = []
    for part in parts:
        if predict:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
        data = part.astype(part.dtype.newbyteorder(order)).tobytes()
        raw.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](data))
    head = 16 if big else 8
    starts = np.cumsum([head] + [len(x) for x in raw])
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [grid.dtype.itemsize * 8]), (259, 3, [packing])]
    if not tile:
        tags += [(273, 4, starts[:-1].tolist()), (278, 4, [rows]), (279, 4, [len(x) for x in raw])]
    if predict:
        tags += [(317, 3, [2])]
    if tile:
        tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts[:-1].tolist()), (325, 4, [len(x) for x in raw])]
    tags += [(339, 3, [kind])]
    if place:
        tags += [(33550, 12, [place[2], place[2], 0.0]), (33922, 12, [0.0, 0.0, 0.0, place[0], place[1], 0.0])]
    if missing is not None:
        tags += [(42113, 2, str(missing).encode() + b"\0")]
    word = "Q" if big else "I"
    room = 8 if big else 4
    body = b"".join(raw)
    at = head + len(body)
    extra, entries = b"", []
    after = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    for tag, kind_, values in tags:
        data = values if kind_ == 2 else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind_] }", *values)
        if len(data) > room:
            entries.append(struct.pack(f"{order}HH{word}{word}", tag, kind_, len(values), after + len(extra)))
            extra += data
        else:
            entries.append(struct.pack(f"{order}HH{word}", tag, kind_, len(values)) + data.ljust(room, b"\0"))
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(entries) + struct.pack(order + word, 0) + extra


@pytest.mark.parametrize("how", [dict(), dict(packing=8, rows=7), dict(packing=5, rows=9), dict(packing=5, tile=16, predict=True), dict(packing=8, tile=16, big=True), dict(order=">", rows=5), dict(big=True, order=">")])
def test_every_form_of_file_is_read(how):
    rng = np.random.default_rng(0)
    for dtype in ("u1", "i2", "f4"):
        if dtype == "f4" and how.get("predict"):
            continue
        grid = rng.integers(0, 100, (40, 53)).astype(dtype)
        data = tiff_file(grid, place=(80.0, 30.0, 0.05), **how)
        got, head = tiff.decode_tiff(data)
        assert (got == grid).all() and head.grid == Grid(80.0, 30.0, 0.05, 0.05, 40, 53)
        window = (11, 20, 9, 25)
        assert (tiff.decode_tiff(data, window)[0] == grid[11:20, 20:45]).all()
    noise = rng.integers(0, 256, 30_000).astype("u1").tobytes() + b"ab" * 9000
    assert tiff.unpack_lzw(lzw(noise)) == noise


def test_rasters_are_read(spark, tmp_path):
    grid = np.arange(12, dtype="f4").reshape(3, 4)
    grid[1, 1], grid[0, 0] = np.nan, -9999
    (tmp_path / "a.tif").write_bytes(tiff_file(grid, 8, missing=-9999, place=(80.0, 30.0, 0.5)))
    found = {(r["r"], r["c"]): r["v"] for r in tiff.read_rasters(spark, str(tmp_path)).collect()}
    assert found[(2, 3)] == 11 and found[(1, 1)] is None and found[(0, 0)] is None and len(found) == 12
    assert tiff.read_rasters(spark, str(tmp_path), (1, 2, 2, 2)).count() == 4
    assert list(tiff.read_grids(spark, str(tmp_path)).values()) == [Grid(80.0, 30.0, 0.5, 0.5, 3, 4)]


# --- rasters on the map


def write(path, grid, left, top, size, missing=None):
    path.write_bytes(tiff_file(grid, 8, rows=16, place=(left, top, size), missing=missing))


def test_annual_mean_crops_and_samples(spark, tmp_path):
    for k, value in enumerate((1000.0, 2000.0, 3000.0)):
        grid = np.full((40, 60), value, "f4")
        grid[:, 20:] += 600
        write(tmp_path / f"rain.{2000 + k}.tif", grid, 80.0, 30.0, 0.05)
    paths = files.list_files(spark, f"{tmp_path}/rain.*.tif")
    assert files.years_of(paths) == [2000, 2001, 2002]
    layers = tiff.read_layers(spark, paths, (80.5, 29.0, 81.5, 29.5))
    mean, place = raster.annual_mean(layers, (80.5, 29.0, 81.5, 29.5))
    assert (place.height, place.width, place.x0, place.y0) == (10, 20, pytest.approx(80.5), pytest.approx(29.5)) and mean.count() == 200
    assert {round(r["v"]) for r in mean.where("c < 10").select("v").distinct().collect()} == {2000}
    assert {round(r["v"]) for r in mean.where("c >= 10").select("v").distinct().collect()} == {2600}
    points = spark.createDataFrame([(1, 80.6, 29.3), (2, 81.4, 29.3), (3, 79.9, 29.3), (4, 80.6, 29.9), (5, 81.51, 29.3)], "id int, x double, y double")
    assert {r["id"]: r["v"] and round(r["v"]) for r in raster.sample_at(mean, place, points).collect()} == {1: 2000, 2: 2600, 3: None, 4: None, 5: None}
    write(tmp_path / "rain.2003.tif", np.ones((40, 60), "f4"), 80.0, 30.05, 0.05)
    with pytest.raises(ValueError, match="grid"):
        raster.annual_mean(tiff.read_layers(spark, str(tmp_path)), (80.5, 29.0, 81.5, 29.5))
    with pytest.raises(ValueError):
        raster.annual_mean({}, (0, 0, 1, 1))


def brute_shares(tiles, lon, lat, size, radius):
    """Every pixel of every tile, one point at a time."""
    prow, pcol = (90.0 - lat) / size, (lon + 180.0) / size
    seen = {}
    for grid, left, top in tiles:
        r0, c0 = round((90.0 - top) / size), round((left + 180.0) / size)
        for r in range(grid.shape[0]):
            for c in range(grid.shape[1]):
                up, over = (r0 + r + 0.5 - prow) * size * 111_320, (c0 + c + 0.5 - pcol) * size * 111_320 * np.cos(np.radians(lat))
                if up**2 + over**2 <= radius**2:
                    seen[r0 + r, c0 + c] = grid[r, c]
    codes = [v for v in seen.values() if v > 0]
    return {c: codes.count(c) / len(codes) for c in set(codes)} if codes else None


def test_cover_in_metric_circles(spark, tmp_path):
    rng = np.random.default_rng(4)
    west, east = rng.choice([10, 30, 0], (60, 60)).astype("u1"), rng.choice([60, 40], (60, 60)).astype("u1")
    write(tmp_path / "a.tif", west, 84.0, 30.0, 0.002)
    write(tmp_path / "b.tif", east, 84.1, 30.0, 0.002)  # ten columns of it lie over the other
    places = [(1, 84.1, 29.94), (2, 84.03, 29.95), (3, 84.2, 29.93), (4, 90.0, 29.9), (5, 84.002, 29.999)]
    points = spark.createDataFrame(places, "id int, lon double, lat double")
    found = {r["id"]: r for r in raster.cover_shares(tiff.read_layers(spark, str(tmp_path)), points, 2.5).collect()}
    names = {10: "lc_tree", 30: "lc_grass", 60: "lc_bare", 40: "lc_crop"}
    for i, lon, lat in places:
        want = brute_shares([(west, 84.0, 30.0), (east, 84.1, 30.0)], lon, lat, 0.002, 2500.0)
        for code, name in names.items():
            assert found[i][name] == (None if want is None else pytest.approx(want.get(code, 0.0)))
    write(tmp_path / "c.tif", east, 84.0005, 30.0, 0.002)
    with pytest.raises(ValueError, match="pixel grid"):
        raster.cover_shares(tiff.read_layers(spark, str(tmp_path)), points)
    with pytest.raises(ValueError, match="At least one"):
        raster.cover_shares({}, points)
    with pytest.raises(ValueError, match="greater than zero"):
        raster.cover_shares(tiff.read_layers(spark, str(tmp_path / "a.tif")), points, 0)


def test_runs_are_exact_at_the_rim(spark):
    cover = spark.createDataFrame([(r, c, 10 + 10 * ((r + c) % 3)) for r in range(40) for c in range(300)], "r int, c int, code int")
    points = spark.createDataFrame([(i, 10.0 + 0.25 * i, 250.0 + 0.5 * i) for i in range(20)], "id int, prow double, pcol double")
    found = {r["id"]: r for r in raster.class_shares(cover, points, 2.5).collect()}
    for i in range(20):
        codes = [(r + c) % 3 for r in range(40) for c in range(300) if (r + 0.5 - 10 - 0.25 * i) ** 2 + (c + 0.5 - 250 - 0.5 * i) ** 2 <= 6.25]
        assert found[i]["lc_tree"] == pytest.approx(codes.count(0) / len(codes)) and found[i]["lc_grass"] == pytest.approx(codes.count(2) / len(codes))


def test_terrain_by_tiles_equals_one_window(spark, monkeypatch):
    rng = np.random.default_rng(1)
    grid = rng.random((23, 31)) * 100
    table = spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(23) for c in range(31)], "r long, c long, v double")
    whole = {(r["r"], r["c"]): r for r in raster.terrain(table).collect()}
    monkeypatch.setattr(raster, "TILE", 7)
    tiled = {(r["r"], r["c"]): r for r in raster.terrain(table).collect()}
    assert tiled == whole and len(whole) == 23 * 31
    north, east = np.gradient(-grid, 30.0, axis=0), np.gradient(grid, 30.0, axis=1)
    assert all(whole[r, c]["slope"] == pytest.approx(np.degrees(np.arctan(np.hypot(east[r, c], north[r, c])))) for r in range(23) for c in range(31))


def test_mosaic_of_a_plane_is_the_plane(spark):
    """Elevation that rises with longitude and latitude comes back at cell centres; a gap and the places outside are NULL."""
    def tile(left, top, gap=False):
        rows = [(r, c, None if gap and 20 <= r < 30 and 20 <= c < 30 else float((left + (c + 0.5) * 0.02) * 1000 + (top - (r + 0.5) * 0.02) * 10)) for r in range(50) for c in range(50)]
        return spark.createDataFrame(rows, "r long, c long, v double"), Grid(left, top, 0.02, 0.02, 50, 50)

    tiles = {"a": tile(84.0, 29.0, True), "b": tile(85.0, 29.0)}
    corner = spark.range(1).select(*[c.alias(n) for c, n in zip(utm_forward(F.lit(84.5), F.lit(28.9)), "xy")]).first()
    grid = raster.Grid(corner["x"] - 30_000, corner["y"], 3000.0, 3000.0, 25, 45)
    cells = raster.all_cells(spark, grid)
    found = raster.mosaic(tiles, cells).join(cells, ["r", "c"])
    from foldstone.functions.columns import utm_inverse

    lon, lat = utm_inverse(F.col("x"), F.col("y"))
    rows = found.select("r", "c", "v", lon.alias("lon"), lat.alias("lat")).collect()
    assert len(rows) == 25 * 45
    hole = [r for r in rows if 84.42 < r["lon"] < 84.58 and 28.42 < r["lat"] < 28.58]
    inner = [r for r in rows if 85.03 < r["lon"] < 85.8 and r["lat"] > 28.05]
    assert hole and all(r["v"] is None for r in hole) and len(inner) > 100
    assert all(r["v"] == pytest.approx(r["lon"] * 1000 + r["lat"] * 10, abs=1e-6) for r in inner)
    assert raster.mosaic({}, cells).where("v is not null").count() == 0


def test_grids_and_windows():
    grid = raster.snapped_grid(100.0, 200.0, 400.0, 500.0)
    assert (grid.x0, grid.y0) == (-900.0, 1500.0) and grid.x0 % 30 == 0 and grid.y0 % 30 == 0
    assert (raster.coarser(grid, 300.0).height, raster.coarser(grid, 300.0).width) == (-(-grid.height * 30 // 300), -(-grid.width * 30 // 300))
    assert Grid(80.0, 30.0, 0.05, 0.05, 40, 60).window((80.5, 29.0, 81.5, 29.5)) == (10, 10, 10, 20)


# --- OpenStreetMap


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zig(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def deltas(values):
    return b"".join(varint(zig(b - a)) for a, b in zip([0, *values], values))


def extract(nodes, ways, plain=False):
    """A PBF file: a header, a blob of dense nodes, a blob of one plain node and the ways."""
    strings, index = [b""], {}
    for _, tags, _ in ways:
        for text in [x for pair in tags.items() for x in pair]:
            index.setdefault(text, len(strings))
            if index[text] == len(strings):
                strings.append(text.encode())
    table = field(1, b"".join(field(1, s) for s in strings))
    units = lambda v: round(v * 1e7)
    ids = sorted(nodes)
    dense = field(1, deltas(ids[1:])) + field(8, deltas([units(nodes[i][1]) for i in ids[1:]])) + field(9, deltas([units(nodes[i][0]) for i in ids[1:]]))
    one = field(1, zig(ids[0])) + field(8, zig(units(nodes[ids[0]][1]))) + field(9, zig(units(nodes[ids[0]][0])))
    lines = b"".join(field(3, field(1, i) + field(2, b"".join(varint(index[k]) for k in tags)) + field(3, b"".join(varint(index[v]) for v in tags.values())) + field(8, deltas(refs))) for i, tags, refs in ways)
    out = b""
    for name, block in (("OSMHeader", b""), ("OSMData", table + field(2, field(2, dense))), ("OSMData", table + field(2, field(1, one)) + field(2, lines))):
        blob = field(1, block) if plain else field(2, len(block)) + field(3, zlib.compress(block))
        head = field(1, name.encode()) + field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out


@pytest.mark.parametrize("plain", [True, False])
def test_extracts_give_ways_with_places(spark, tmp_path, plain):
    nodes = {i: (80.0 + i / 100, 27.0 - i / 300) for i in range(1, 400)}
    ways = [(1, {"highway": "primary", "name": "Küste"}, [1, 2, 300]), (2, {"highway": "track"}, [1, 2]), (3, {"waterway": "river"}, [5, 4, 5]), (4, {"highway": "residential"}, [7, 9999]), (2**40, {"highway": "tertiary_link"}, list(range(399, 0, -1))), (6, {"highway": "primary"}, [3])]
    path = str(tmp_path / "x.osm.pbf")
    open(path, "wb").write(extract(nodes, ways, plain))
    everything = osm.read_extract(spark, path)
    assert everything.where("kind = 'node'").count() == 399 and everything.where("kind = 'way'").count() == 6
    assert everything.where("id = 1 and kind = 'way'").first()["tags"] == {"highway": "primary", "name": "Küste"}
    roads = {r["way_id"]: r for r in osm.read_ways(spark, path, "highway", MOTOR_CLASSES).collect()}
    assert sorted(roads) == [1, 2**40] and roads[1]["kind"] == "primary"
    for way, refs in ((1, [1, 2, 300]), (2**40, list(range(399, 0, -1)))):
        assert [(p["x"], p["y"]) for p in roads[way]["nodes"]] == [pytest.approx(nodes[i], abs=1e-7) for i in refs]
    (river,) = osm.read_ways(spark, path, "waterway", ("river",)).collect()
    assert len(river["nodes"]) == 3 and files.segments_of(osm.read_ways(spark, path, "waterway", ("river",))).count() == 2


# --- GeoPackage and tables


def test_lines_through_a_geopackage(spark, tmp_path):
    lines = [(1, "primary", [(0.0, 0.5), (1.0, 1.0)]), (2, "track", [(5.0, 5.0), (6.0, 7.0), (8.0, 9.25)])]
    table = spark.createDataFrame(lines, geopackage.SCHEMA)
    path, made = str(tmp_path / "roads.gpkg"), []
    for _ in range(2):
        found = geopackage.cached_lines(spark, path, "highway", lambda: made.append(1) or table)
        assert sorted((r["kind"], [tuple(p) for p in r["nodes"]]) for r in found.collect()) == [(k, n) for _, k, n in lines]
    assert made == [1]
    with sqlite3.connect(path) as base:  # another writer's: several lines in one geometry, with an envelope, the other byte order
        part = lambda pts: struct.pack(">BII", 0, 2, len(pts)) + struct.pack(f">{2 * len(pts)}d", *(v for p in pts for v in p))
        blob = b"GP\0" + bytes([0b10]) + struct.pack(">i", 32645) + bytes(32) + struct.pack(">BII", 0, 5, 2) + part([(1.0, 2.0), (3.0, 4.0)]) + part([(5.0, 6.0), (7.0, 8.0)])
        base.execute("insert into lines (geom, highway) values (?, 'service')", (blob,))
    assert geopackage.read_lines(spark, path, "highway").where("kind = 'service'").count() == 2
    assert geopackage.read_lines(spark, path, "waterway").count() == 0


def test_tables_in_and_out(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "id int, name string, v double")
    for path in (f"{tmp_path}/folder", f"{tmp_path}/one.csv"):
        files.write_table(rows, path)
        files.write_table(rows, path)
        assert sorted(map(tuple, files.read_table(spark, path, "id int, name string, v double").collect())) == [(1, "a", 0.5), (2, None, None)]
    assert (tmp_path / "one.csv").read_text().startswith("id,name,v\n")
    assert [p.rsplit("/", 1)[1] for p in files.list_files(spark, f"{tmp_path}/*")] == ["folder", "one.csv"]
    assert files.list_files(spark, f"{tmp_path}/none-*") == []


# --- the web service


@pytest.fixture
def service():
    """A service of 5 features, by pages; an error for one question."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    features = [{"geometry": {"coordinates": [84.0 + i, 28.0]}, "properties": {"event_id": i, "event_date": 1704067200000, "location_accuracy": "5km"}} for i in range(5)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if asked.get("where") == "bad":
                reply = {"error": {"code": 400}}
            elif "returnCountOnly" in asked:
                reply = {"count": len(features)}
            else:
                start = int(asked["resultOffset"])
                reply = {"features": features[start : start + int(asked["resultRecordCount"])]}
            body = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query"
    server.shutdown()


def test_pages_of_a_service(spark, service, tmp_path, capsys):
    from foldstone import study

    spark.dataSource.register(files.PagedFeatures)
    pages = spark.read.format("paged_features").options(endpoint=service, size="2", where="1=1").load()
    assert sorted(r["offset"] for r in pages.collect()) == [0, 2, 4]
    assert sorted(r["event_id"] for r in files.feature_rows(pages, "Nepal").collect()) == ["0", "1", "2", "3", "4"]
    with pytest.raises(RuntimeError, match="400"):
        files.request(service, {"where": "bad"})
    study.main(["download", "--raw", str(tmp_path), "--endpoint", service], spark)
    assert len((tmp_path / "events.csv").read_text().splitlines()) == 6
    cleaned = files.read_catalogue(spark, str(tmp_path / "events.csv"))
    assert cleaned.where("country_name = 'Nepal' and longitude >= 84").count() == 5
