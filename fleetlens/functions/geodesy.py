"""Distances on the WGS84 globe as Column expressions.

Sums and products keep one fixed order so that the result does not depend on the
engine; everything stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563

# The spheroid distance over the sphere distance lies in [0.9944, 1.0045] for any
# pair: a radius on the sphere that is this much larger misses nothing.
SPHEROID_PAD = 1.006

METRICS = ("sphere", "spheroid")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    h = _half_chord_sq(
        F.radians(lat1), F.radians(lat2), F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the spheroid by Lambert's formula on reduced latitudes."""
    f = WGS84_F
    b1 = F.atan(F.lit(1 - f) * F.tan(F.radians(lat1)))
    b2 = F.atan(F.lit(1 - f) * F.tan(F.radians(lat2)))
    h = F.least(F.lit(1.0), _half_chord_sq(b1, b2, b2 - b1, F.radians(lng2 - lng1)))
    sigma = F.lit(2.0) * F.asin(F.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x_ratio = F.sin(p) * F.cos(q) / F.sqrt(F.lit(1.0) - h)
    y_ratio = F.cos(p) * F.sin(q) / F.sqrt(h)
    x = (sigma - F.sin(sigma)) * (x_ratio * x_ratio)
    y = (sigma + F.sin(sigma)) * (y_ratio * y_ratio)
    metres = F.lit(WGS84_A) * (sigma - F.lit(f / 2) * (x + y))
    # h = 0: the same point; h = 1: antipodes, where the formula is undefined.
    return (
        F.when(h == 0.0, F.lit(0.0))
        .when(h >= 1.0, haversine(lat1, lng1, lat2, lng2))
        .otherwise(metres)
    )


def distance(metric: str, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return (haversine if metric == "sphere" else geodesic)(lat1, lng1, lat2, lng2)


def millimetres(metres: Column) -> Column:
    """Distances are reported, ranked and tied at millimetre resolution.

    ``round`` goes through the decimal text of a number, a microsecond a row. It is asked only where
    the half millimetre is too near to tell: a whole number over 1000 is the nearest double itself.
    """
    return _whole(metres * 1000.0, 1e-4, F.abs(metres) < 1e8, F.round(metres, 3))


def _whole(mm: Column, doubt: float, known: Column, exact: Column) -> Column:
    """``mm`` to whole millimetres, in metres; ``exact`` where it is not ``known`` or lies within
    ``doubt`` of a half. The zero is for minus zero."""
    sure = known & (F.abs(mm - F.rint(mm)) < 0.5 - doubt)
    return F.when(sure, (F.rint(mm) + 0.0) / 1000.0).otherwise(exact)


# Chords below this (64 km) have a short series for the arc, exact to 1e-20.
SHORT_CHORD = 0.01


def chord_millimetres(chord_sq: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """``millimetres(haversine(...))`` of a pair whose squared chord is at hand: without an angle
    function for a short one, whose arc is then known to 1e-8 m. The formula itself decides where that is
    within 1e-6 m of a half millimetre."""
    x2 = chord_sq * 0.25
    series = 1.0 + x2 * (1 / 6 + x2 * (3 / 40 + x2 * (15 / 336)))
    mm = F.sqrt(x2) * series * (2 * EARTH_RADIUS_M * 1000.0)
    return _whole(mm, 1e-3, chord_sq < SHORT_CHORD * SHORT_CHORD,
                  F.round(haversine(lat1, lng1, lat2, lng2), 3))


def chord_of(radius_m: Column, metric: str) -> Column:
    """Straight-line length, on the unit sphere, that covers ``radius_m``."""
    pad = SPHEROID_PAD if metric == "spheroid" else 1.0
    half_angle = radius_m * F.lit(pad / (2 * EARTH_RADIUS_M))
    chord = F.lit(2.0) * F.sin(F.least(half_angle, F.lit(math.pi / 2)))
    return F.coalesce(chord, F.lit(0.0))  # no radius, no reach


def inner_chord(radius_m: Column, metric: str) -> Column:
    """Straight-line length within which every point is nearer than ``radius_m``, whatever the
    rounding; below zero where no point is known to be."""
    pad = SPHEROID_PAD if metric == "spheroid" else 1.0
    half_angle = radius_m / F.lit(pad * 2 * EARTH_RADIUS_M)
    chord = F.lit(2.0) * F.sin(F.least(half_angle, F.lit(math.pi / 2))) - F.lit(1e-9)
    return F.when(radius_m.isNull(), F.lit(-1.0)).otherwise(chord)


def with_flattened(df: DataFrame, lat: str, prefix: str) -> DataFrame:
    """Add the reduced latitude ``<prefix>b`` and its cosine ``<prefix>c``, for :func:`with_near`."""
    b = F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(F.col(lat))))
    return df.withColumn(f"{prefix}b", b).withColumn(f"{prefix}c", F.cos(F.col(f"{prefix}b")))


def with_near(df: DataFrame, metric: str, sure: Column, radius_m: str,
              a: tuple[str, str, str], b: tuple[str, str, str], out: str) -> DataFrame:
    """Add ``out``: whether a row is ``sure``, or its places ``a`` and ``b`` are at most ``radius_m`` apart.
    The places are names of latitude, longitude and, for the spheroid, the prefix of :func:`with_flattened`.

    The distance on the spheroid is that of :func:`geodesic`, a column for each step: as one expression
    it repeats its steps, and outgrows what the JVM compiles. A filter on ``out`` would be moved below
    the columns, and be one expression again.
    """
    if metric == "sphere":
        return df.withColumn(out, sure | (haversine(*[F.col(c) for c in (*a[:2], *b[:2])]) <= F.col(radius_m)))
    distance(metric, *[F.lit(0.0)] * 4)  # an unknown metric is an error
    b1, b2, c1, c2 = (F.col(f"{x[2]}{y}") for y in "bc" for x in (a, b))
    s_phi, s_lambda = F.sin((b2 - b1) / 2), F.sin(F.radians(F.col(b[1]) - F.col(a[1])) / 2)
    h, sigma, x, y = (F.col(c) for c in ("_gh", "_gs", "_gx", "_gy"))
    f = WGS84_F
    df = df.withColumn("_gh", F.when(~sure, F.least(F.lit(1.0), s_phi * s_phi + c1 * c2 * s_lambda * s_lambda)))
    some = (h > 0.0) & (h < 1.0)
    df = df.withColumns({
        "_gs": F.when(some, F.lit(2.0) * F.asin(F.sqrt(h))),
        "_gx": F.when(some, F.sin((b1 + b2) / 2) * F.cos((b2 - b1) / 2) / F.sqrt(F.lit(1.0) - h)),
        "_gy": F.when(some, F.cos((b1 + b2) / 2) * F.sin((b2 - b1) / 2) / F.sqrt(h))})
    df = df.withColumns({"_gx": (sigma - F.sin(sigma)) * (x * x), "_gy": (sigma + F.sin(sigma)) * (y * y)})
    metres = (
        F.when(h == 0.0, F.lit(0.0))
        .when(h >= 1.0, haversine(*[F.col(c) for c in (*a[:2], *b[:2])]))
        .otherwise(F.lit(WGS84_A) * (sigma - F.lit(f / 2) * (x + y))))
    return df.withColumn(out, sure | (metres <= F.col(radius_m))).drop("_gh", "_gs", "_gx", "_gy")


def inner_sq(radius_m: Column, metric: str) -> Column:
    """Square of :func:`inner_chord`, below zero where no point is known to be within."""
    inner = inner_chord(radius_m, metric)
    return F.when(inner > 0.0, inner * inner).otherwise(F.lit(-1.0))


def _half_chord_sq(phi1: Column, phi2: Column, d_phi: Column, d_lambda: Column) -> Column:
    s_phi, s_lambda = F.sin(d_phi / 2), F.sin(d_lambda / 2)
    return s_phi * s_phi + F.cos(phi1) * F.cos(phi2) * s_lambda * s_lambda
