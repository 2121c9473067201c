"""Column builders: terrain, bins, portable randomness, geometry and text cleaning."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres of each stated location accuracy.
ACCURACY_KM = {"exact": 0.0, "1km": 1.0, "5km": 5.0, "10km": 10.0, "25km": 25.0, "50km": 50.0}
#: Inner edges of the road-distance bins in kilometres; the last bin is open.
INNER_EDGES_KM = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
#: Land-cover codes of each group.
COVER_GROUPS = {"lc_tree": (10,), "lc_shrub": (20,), "lc_grass": (30,), "lc_crop": (40,), "lc_built": (50,), "lc_bare": (60,), "lc_snow": (70,), "lc_other": (80, 90, 95, 100)}
#: Way classes that count as motor roads, and as rivers.
MOTOR_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
RIVER_CLASSES = ("river",)


def slope_degrees(east: Column, north: Column) -> Column:
    return F.degrees(F.atan(F.hypot(east, north)))


def aspect_degrees(east: Column, north: Column) -> Column:
    """Downhill bearing, north 0; NULL on flat ground."""
    return F.when(F.hypot(east, north) >= 1e-9, F.pmod(F.degrees(F.atan2(-east, -north)), F.lit(360.0)))


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def bin_of(value: Column, edges: Sequence[float] = INNER_EDGES_KM) -> Column:
    """How many inner edges are at or below ``value``: bins closed on the left, the last one open."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def uniform(seed: Column | int, key: Column) -> Column:
    """A number in (0, 1] from the first 13 hexadecimal digits of md5('seed|key'): the same in every engine."""
    text = F.concat_ws("|", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), key.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + 1) / F.lit(4503599627370497.0)


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point and a segment; a segment without length is a point."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / length))).otherwise(0.0)
    return F.hypot(x - (x0 + along * dx), y - (y0 + along * dy))


def crosses_ray(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the edge crosses the ray that leaves the point eastwards (half-open in y)."""
    spans = (y0 > y) != (y1 > y)
    return spans & (x < F.try_divide((x1 - x0) * (y - y0), y1 - y0) + x0)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lookup(key: Column, values: Mapping[str, float]) -> Column:
    """The value of ``key``, NULL where there is none."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def event_time(raw: Column) -> Column:
    """Milliseconds since 1970 if the text is a number, else a date in one of the known forms, else NULL."""
    number = no_nan(raw.try_cast("double"))
    forms = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy")
    return F.coalesce(F.timestamp_millis(number.cast("bigint")), *[F.try_to_timestamp(raw, F.lit(f)) for f in forms])


def colour(score: Column) -> Column:
    """Blue, orange or red for scores below a third, below two thirds, and above."""
    return F.when(score < 1 / 3, "#2c7bb6").when(score < 2 / 3, "#fdae61").otherwise("#d7191c")


def two_digits(value: Column) -> Column:
    """Text with two digits after the point, as printf rounds: by the exact binary value, ties to even. The product with
    100 is split into its rounded part and the rest, which decides where the rounded part looks like a tie."""
    x = value.cast("double")
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * 100.0
    rest = (high * 100.0 - product) + (x - high) * 100.0
    low = F.floor(product).cast("double")
    whole = F.when((product - low == 0.5) & (rest != 0), F.when(rest > 0, low + 1).otherwise(low)).otherwise(F.rint(product))
    return F.format_string("%.2f", whole / 100)


# Transverse Mercator on WGS84, zone 45 north: radius, flattening, scale, central meridian, false easting. The series are the
# published ones in the third flattening n, up to its fourth power.
_A, _F, _K0, _LON0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 87.0, 500000.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def utm_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north, by the series of fourth order in the flattening."""
    phi, lam = F.radians(lat), F.radians(lon - _LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _RADIUS * east, _K0 * _RADIUS * north


def utm_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees, the series turned around."""
    xi, eta = y / (_K0 * _RADIUS), (x - _E0) / (_K0 * _RADIUS)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return _LON0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)
