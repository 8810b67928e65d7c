"""Equal-area hexagon cells of about 0.105 km2 on a sinusoidal map."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.geodesy import EARTH_RADIUS_M

EDGE_M = 201.0  # fixed value: edge length in metres


def hex_cell(lat: Column, lng: Column, edge_m: float = EDGE_M) -> Column:
    """Cell id ``"q:r"`` in axial coordinates; null where a coordinate is null."""
    phi = F.radians(lat)
    x = F.lit(EARTH_RADIUS_M) * F.radians(lng) * F.cos(phi)
    y = F.lit(EARTH_RADIUS_M) * phi
    q = (F.lit(math.sqrt(3) / 3) * x - F.lit(1 / 3) * y) / F.lit(edge_m)
    r = F.lit(2 / 3) * y / F.lit(edge_m)
    # Round the three cube coordinates, then repair the one that moved most.
    s = -q - r
    rq, rr, rs = _half_up(q), _half_up(r), _half_up(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    out_q = F.when(fix_q, -rr - rs).otherwise(rq)
    out_r = F.when(fix_r, -rq - rs).otherwise(rr)
    return F.concat(out_q.cast("long").cast("string"), F.lit(":"), out_r.cast("long").cast("string"))


def _half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("double")
