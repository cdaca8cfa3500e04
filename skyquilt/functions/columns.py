"""Column expressions: axes, rounding, bins, interpolation weights, time and sky coordinates, polarisation codes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# FITS codes of polarisations.
POLARISATIONS = {1: "I", 2: "Q", 3: "U", 4: "V", -1: "RR", -2: "LL", -3: "RL", -4: "LR", -5: "XX", -6: "YY", -7: "XY", -8: "YX"}
# Observatory latitude and east longitude in degrees; seconds from 1970 to 2000.
LATITUDE, LONGITUDE, EPOCH_2000 = 38.43312, -79.83983, 946684800


def axis(index: Column, n: int, centre: float, delta: float) -> Column:
    """Coordinate of an index on an axis given by its centre (at n // 2) and spacing."""
    return (index - n // 2) * F.lit(float(delta)) + F.lit(float(centre))


def wcs_axis(index: Column, crpix: Column, crval: Column, cdelt: Column) -> Column:
    """Coordinate of a 0-based index on an axis whose reference pixel is 1-based."""
    return (index + 1 - crpix) * cdelt + crval


def pixel(x: Column, n: int, centre: float, delta: float, half_even: bool = True) -> Column:
    """Nearest pixel of a coordinate. Ties go to the even pixel, or away from zero."""
    at = (x - F.lit(float(centre))) / F.lit(float(delta)) + n // 2
    return (F.rint(at) if half_even else F.round(at)).cast("int")


def bucket(x: Column, low: float, width: float, n: int, closed: bool = False) -> Column:
    """Bin of x among n equal bins from ``low``; null outside. ``closed`` puts the last edge into the last bin."""
    k = F.floor((x - F.lit(float(low))) / F.lit(float(width))).cast("int")
    top = F.when(x == F.lit(float(low + n * width)), n - 1) if closed else F.when(F.lit(False), 0)
    return F.coalesce(top, F.when((k >= 0) & (k < n), k))


def edge_bucket(x: Column, edges: list[float], closed: bool = False) -> Column:
    """Bin of x among increasing ``edges``; null outside."""
    steps = [F.when((x >= a) & (x < b), k) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    if closed:
        steps.append(F.when(x == edges[-1], len(edges) - 2))
    return F.coalesce(*steps)


def bin_edges(centres: list[float]) -> list[float]:
    """Edges half way between centres; the outer ones as far away as their neighbours."""
    mid = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return [2 * centres[0] - mid[0], *mid, 2 * centres[-1] - mid[-1]]


def log_edges(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (k / n) for k in range(n + 1)]


def keys_weight(s: Column) -> Column:
    """Cubic convolution kernel with parameter -1/2."""
    a = F.abs(s)
    return F.when(a < 1, 1.5 * a**3 - 2.5 * a**2 + 1).when(a < 2, -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2).otherwise(0.0)


def seconds_2000(ts: Column) -> Column:
    """Seconds since 2000-01-01 of a timestamp without leap seconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6 - EPOCH_2000


def time_text(seconds: Column) -> Column:
    """Text of seconds since 2000-01-01, to hundredths, cut not rounded. A double holds whole microseconds only nearly, so the nearest is taken."""
    stamp = F.timestamp_micros(F.rint(seconds * 1e6).cast("long") + EPOCH_2000 * 1_000_000)
    return F.substring(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SS"), 1, 22)


def text_seconds(text: Column) -> Column:
    """Inverse of ``time_text``; null for text of another form."""
    return seconds_2000(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][.SS][.S]")))


def sidereal_degrees(ts: Column, longitude: float = LONGITUDE) -> Column:
    """Local mean sidereal time in degrees, from the days since noon of 2000-01-01."""
    days = (seconds_2000(ts) - 43200) / 86400
    return F.pmod(F.lit(280.46061837) + days * 360.98564736629 + longitude, F.lit(360.0))


def horizon_to_sky(el: Column, az: Column, lst: Column, latitude: float = LATITUDE) -> tuple[Column, Column]:
    """Right ascension and declination (degrees) from elevation, azimuth and sidereal time."""
    e, a, p = F.radians(el), F.radians(az), math.radians(latitude)
    dec = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(e) * math.sin(p) + F.cos(e) * math.cos(p) * F.cos(a))))
    hour = F.atan2(-F.sin(a) * F.cos(e), F.sin(e) * math.cos(p) - F.cos(e) * F.cos(a) * math.sin(p))
    return F.pmod(lst - F.degrees(hour), F.lit(360.0)), F.degrees(dec)


def sky_to_horizon(ra: Column, dec: Column, lst: Column, latitude: float = LATITUDE) -> tuple[Column, Column]:
    """Azimuth and elevation (degrees); inverse of ``horizon_to_sky``."""
    h, d, p = F.radians(lst - ra), F.radians(dec), math.radians(latitude)
    el = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * math.sin(p) + F.cos(d) * math.cos(p) * F.cos(h))))
    az = F.atan2(-F.sin(h) * F.cos(d), F.sin(d) * math.cos(p) - F.cos(d) * F.cos(h) * math.sin(p))
    return F.pmod(F.degrees(az), F.lit(360.0)), F.degrees(el)


def parallactic_angle(hour: Column, dec: Column, latitude: float = LATITUDE) -> Column:
    """Parallactic angle in radians of an hour angle and declination in degrees."""
    h, d, p = F.radians(hour), F.radians(dec), math.radians(latitude)
    return F.atan(F.sin(h) / (F.cos(d) * math.tan(p) - F.sin(d) * F.cos(h)))


def sexagesimal(x: Column, hours: bool = False) -> Column:
    """[-]dd:mm:ss.ss of degrees (or hh:mm:ss.ss)."""
    v = F.round(F.abs(x) / (15 if hours else 1) * 360000).cast("long")
    body = F.format_string("%02d:%02d:%05.2f", (v / 360000).cast("long"), F.floor(v % 360000 / 6000).cast("long"), (v % 6000) / 100.0)
    return F.concat(F.when(x < 0, "-").otherwise(""), body)


def from_sexagesimal(text: Column, hours: bool = False) -> Column:
    parts = F.split(F.regexp_replace(text, "^-", ""), ":")
    size = parts[0].cast("double") + parts[1].cast("double") / 60 + parts[2].cast("double") / 3600
    return F.when(text.startswith("-"), -size).otherwise(size) * (15 if hours else 1)


def polarisation_name(code: Column) -> Column:
    """Name of a polarisation code; an unknown code is an error."""
    known = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), POLARISATIONS.items(), F)
    return F.when(code.isNull(), None).otherwise(known.otherwise(F.raise_error(F.concat(F.lit("unknown polarisation "), code.cast("string")))))


def nearest_multiple(x: Column, step: float) -> Column:
    return F.rint(x / step) * step


def julian_date(ts: Column) -> Column:
    """Days since noon of 1 January 4713 BC."""
    return seconds_2000(ts) / 86400 + 2451544.5
