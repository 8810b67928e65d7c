"""Nested cube cells around the unit sphere: the join key of the radius searches.

A point of the globe is a unit vector in [-1, 1]^3. At level n each axis is cut into
2^n slices, so a point has one cell per level, and a ball of chord ``c`` meets at most
27 cells of the level whose side is at least ``c``. Straight-line distance grows with
great-circle distance, hence poles and the date line need no special case.

A cell id packs a leading one and the three indexes into one long: ids of different
levels never collide. Expressions are kept short on purpose; a code-generated stage that
outgrows the JIT limit runs interpreted. ``explode_outer`` keeps Catalyst from inferring a
filter on the exploded list, which would compute the list twice, below every projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVEL = 20          # about 12 m on the ground
CELLS_PER_BALL = 27
AXES = ("x", "y", "z")
SLACK = 1e-11           # of a chord: far above rounding, below a tenth of a millimetre
CELL_SLACK = 1e-6       # the same in cell sides


def with_vector(df: DataFrame, lat: str, lng: str, prefix: str) -> DataFrame:
    """Add the unit vector ``<prefix>x, <prefix>y, <prefix>z``.

    A missing coordinate becomes NaN, which is in no cell: as the vector is never null,
    Catalyst infers no null checks on it, which would compute it again below.
    """
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lng))
    parts = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return df.withColumns({
        f"{prefix}{a}": F.coalesce(v, F.lit(float("nan"))) for a, v in zip(AXES, parts)
    })


def with_index(df: DataFrame, prefix: str, out: str, level: int = MAX_LEVEL) -> DataFrame:
    """Add the slice numbers ``<out>x, <out>y, <out>z`` at ``level``; 1.0 is in the last slice."""
    def index(axis: str) -> Column:
        at = F.floor((F.col(f"{prefix}{axis}") + 1.0) * float(1 << (level - 1)))
        return F.least(at, F.lit((1 << level) - 1)).cast("long")

    return df.withColumns({f"{out}{a}": index(a) for a in AXES})


def coarser(index: Column, steps: Column) -> Column:
    """Slice number ``steps`` levels up."""
    return F.call_function("shiftright", index, steps)


def cell_id(level: Column, *indexes: Column) -> Column:
    x, y, z = indexes
    return _shl(F.lit(1).cast("long"), level * 3) + _shl(x, level * 2) + _shl(y, level) + z


def cell_at(prefix: str, level: Column) -> Column:
    """Cell of ``level`` from the finest slice numbers ``<prefix>x..z``."""
    up = F.lit(MAX_LEVEL) - level
    return cell_id(level, *[coarser(F.col(f"{prefix}{a}"), up) for a in AXES])


def indexes_of(cell: Column, level: Column) -> list[Column]:
    """The three slice numbers of a cell."""
    mask = _shl(F.lit(1).cast("long"), level) - 1
    return [coarser(cell, level * steps).bitwiseAND(mask) for steps in (2, 1, 0)]


def slices(level: Column) -> Column:
    return _shl(F.lit(1).cast("long"), level).cast("double")


def level_for(chord: Column) -> Column:
    """The finest level whose cells are no smaller than ``chord``."""
    exact = F.floor(F.lit(1.0) - F.log2(F.greatest(chord, F.lit(1e-9)))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.coalesce(exact, F.lit(0))))


def chord_sq(a: str, b: str) -> Column:
    """Squared chord between the vectors with prefixes ``a`` and ``b``."""
    parts = [F.col(f"{a}{x}") - F.col(f"{b}{x}") for x in AXES]
    return reduce(lambda s, d: s + d, [d * d for d in parts])


def cover_ball(df: DataFrame, prefix: str, chord: str, level: str, out: str) -> DataFrame:
    """One row per cell of ``level`` that a ball around the vector can share with the sphere."""
    return _meeting(_scaled(df, prefix, chord, level), prefix, level, out)


def _scaled(df: DataFrame, prefix: str, chord: str, level: str) -> DataFrame:
    """The vector and the ball in units of cell sides, and the cells its box reaches per axis."""
    v = {a: F.col(f"{prefix}{a}") for a in AXES}
    t = {a: F.col(f"_t{a}") for a in AXES}
    return (
        df.withColumn("_n", slices(F.col(level)))
        .withColumns({
            **{f"_t{a}": (v[a] + 1.0) * F.col("_n") * 0.5 for a in AXES},
            "_u": F.col(chord) * F.col("_n") * 0.5 + CELL_SLACK,
        })
        .withColumns({
            **{f"_lo{a}": F.greatest(F.lit(0), F.floor(t[a] - F.col("_u"))) for a in AXES},
            **{f"_hi{a}": F.least((F.col("_n") - 1.0).cast("long"), F.floor(t[a] + F.col("_u")))
               for a in AXES},
            # Half the thickness of a cell along the vector, and the sagitta of the ball.
            "_h": (F.abs(v["x"]) + F.abs(v["y"]) + F.abs(v["z"])) * 0.5
            + F.col(chord) * F.col("_u") * 0.5 + CELL_SLACK,
        })
    )


def _meeting(scaled: DataFrame, prefix: str, level: str, out: str) -> DataFrame:
    """The cells between the bounds that meet both the ball and the sphere."""
    v = {a: F.col(f"{prefix}{a}") for a in AXES}
    t = {a: F.col(f"_t{a}") for a in AXES}
    i = {a: F.col(f"_i{a}") for a in AXES}
    for a in AXES:
        scaled = scaled.withColumn(f"_i{a}", F.explode_outer(F.sequence(f"_lo{a}", f"_hi{a}")))
    gaps = [F.greatest(i[a] - t[a], t[a] - i[a] - 1.0, F.lit(0.0)) for a in AXES]
    near = reduce(lambda s, g: s + g, [g * g for g in gaps])
    height = reduce(lambda s, g: s + g, [v[a] * (i[a] + 0.5 - t[a]) for a in AXES])
    return (
        scaled.where((near <= F.col("_u") * F.col("_u")) & (F.abs(height) <= F.col("_h")))
        .withColumn(out, cell_id(F.col(level), *i.values()))
        .drop("_n", "_u", "_h", *[f"{p}{a}" for p in ("_t", "_lo", "_hi", "_i") for a in AXES])
    )


def within_reach(prefix: str, chord: str, cell: Column, level: Column) -> Column:
    """Whether a ball around the vector can reach a cell."""
    n = slices(level)
    gaps = []
    for a, i in zip(AXES, indexes_of(cell, level)):
        off = F.abs((F.col(f"{prefix}{a}") + 1.0) * n * 0.5 - i - 0.5) - 0.5
        gaps.append(F.greatest(off, F.lit(0.0)))
    u = F.col(chord) * n * 0.5 + CELL_SLACK
    return reduce(lambda s, g: s + g, [g * g for g in gaps]) <= u * u


def farthest(prefix: str, cell: Column, level: Column) -> Column:
    """Distance from the vector to the farthest corner of a cell."""
    n = slices(level)
    sides = [F.abs((F.col(f"{prefix}{a}") + 1.0) * n * 0.5 - i - 0.5) + 0.5
             for a, i in zip(AXES, indexes_of(cell, level))]
    return F.sqrt(reduce(lambda s, d: s + d, [d * d for d in sides])) * 2.0 / n


def _shl(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)
