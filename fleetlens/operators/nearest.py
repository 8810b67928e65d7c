"""k nearest positions of a point, or of every row of a table of points.

The join needs no trial radius and no loop. A pyramid holds the positions' counts per cube
cell, counted once at the finest level and summed from there. A block of two cells per axis, placed so that the query lies in its middle
half, is looked up for every level, and the finest block with k positions or more is
taken. Its cells of the next level, nearest first, hold k positions within a distance
that is known from counts alone; one ball join with that reach finds the neighbours.
Each lookup meets one row per block, or at most 64, so its work grows with its bytes
and AQE's skew join is enough where many queries share a place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import cube, geodesy
from fleetlens.operators.counting import places, pyramid
from fleetlens.operators.radius import ball_join, first_hits, range_join, range_search
from fleetlens.session import spread, stored

# Neighbours tie at millimetres: a bound reaches that much farther (in earth radii).
REACH_SLACK = 1e-9
# A radius cap is searched as it is if no cell of its size has more than so many times k
# positions. Results do not depend on it.
CAP_CROWD = 8
# Of more queries than that, those at one place are searched as one.
SPOTS_FROM = 1_000_000


def knn_search(
    positions: DataFrame,
    lat: float,
    lng: float,
    k: int,
    metric: str = "sphere",
    max_radius_m: float | None = None,
) -> DataFrame:
    """The k nearest positions of one centre, nearest first: a top-k scan."""
    if max_radius_m is not None:
        return range_search(positions, lat, lng, max_radius_m, metric, limit=k)
    d = geodesy.distance(metric, F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return (
        positions.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .withColumn("distance_meter", geodesy.millimetres(d))
        .orderBy("distance_meter", "user_id")
        .limit(k)
    )


def knn_join(
    queries: DataFrame,
    positions: DataFrame,
    metric: str = "sphere",
    max_radius_m: float | None = None,
    max_k: int | None = None,
    keep: tuple[str, ...] = (),
    rows_per_split: int | None = None,
) -> DataFrame:
    """The ``k`` nearest positions of every query (``qid, lat, lng, k``) with their rank.

    Fewer rows come back where fewer positions exist, or lie within ``max_radius_m``; a query
    without ``k`` has none. ``max_k`` is the largest k in ``queries``; if not given, one
    aggregate reads it. The job fails if a query has a larger one.
    """
    if max_k is None:
        max_k = queries.agg(F.max("k")).head()[0] or 0
    located = positions.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    k = F.when(F.col("k") > max_k, F.raise_error(F.lit(f"a query has k over {max_k}")).cast("int")).otherwise(F.col("k"))
    q = queries.where(F.col("k").isNotNull()).select("qid", "lat", "lng", k.alias("k"))
    columns = ["qid", "user_id", "latitude", "longitude", "distance_meter", *keep, "rank"]
    spots = _spots(q, F.max("k").alias("k"))
    ranked = _ranked(q if spots is None else spots, located, metric, max_radius_m, max_k, keep, rows_per_split)
    if spots is None:
        return ranked.select(*columns)
    return q.join(ranked.drop("qid", "k"), ["lat", "lng"]).where(F.col("rank") <= F.col("k")).select(*columns)


def first_within(queries: DataFrame, positions: DataFrame, n: int, metric: str = "sphere") -> DataFrame:
    """The first ``n`` positions within each query's own ``radius_m`` with their rank, as
    ``first_hits`` of a range join, without making the hits beyond them."""
    q = queries.where(F.col("radius_m").isNotNull()).select("qid", "lat", "lng", "radius_m")
    spots = _spots(q, F.lit(n).alias("k"))
    if spots is None:
        return first_hits(range_join(q, positions, metric), n)
    cap = q.agg(F.max("radius_m")).head()[0]
    located = positions.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    # Those that tie at millimetres with the n-th stay: a radius may end between them.
    hits = _ranked(spots, located, metric, cap, n, (), None, ties=True).groupBy("lat", "lng").agg(F.sort_array(
        F.collect_list(F.struct("distance_meter", "user_id", "latitude", "longitude", "_d"))).alias("_hits"))
    within = F.slice(F.filter("_hits", lambda h: h["_d"] <= F.col("radius_m")), 1, n)
    return q.join(hits, ["lat", "lng"]).select("qid", F.posexplode(within).alias("_at", "_h")).select(
        "qid", "_h.user_id", "_h.latitude", "_h.longitude", "_h.distance_meter", (F.col("_at") + 1).alias("rank"))


def _spots(queries: DataFrame, k: Column) -> DataFrame | None:
    """Every place of a large table of queries once, with one query's id, if that at least halves it.
    Queries at one place have the same neighbours."""
    n = queries.count()
    if n <= SPOTS_FROM:
        return None
    located = queries.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    spots = stored(located.groupBy("lat", "lng").agg(F.min("qid").alias("qid"), k), "spots")
    return spots if 2 * spots.count() <= n else None


def _ranked(
    q: DataFrame, located: DataFrame, metric: str, max_radius_m: float | None, max_k: int,
    keep: tuple[str, ...], rows_per_split: int | None, ties: bool = False,
) -> DataFrame:
    """Neighbours of ``qid, lat, lng, k`` up to the k-th, or with ``ties`` to the last that is as far."""
    total, crowd = (None, math.inf) if max_radius_m is None else _crowd(located, float(max_radius_m), metric)
    if crowd <= CAP_CROWD * max_k:
        # a range search that is ranked: a tighter bound would cost more than it saves
        bounded = q.withColumn("_chord", geodesy.chord_of(F.lit(float(max_radius_m)), metric))
    else:
        bounded = _with_bound(q, located, metric, max_radius_m)
    pairs = ball_join(bounded, _thin_stacks(located, max_k), keep, rows_per_split, total)
    d = geodesy.distance(metric, F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))
    hits = pairs.withColumn("_d", d)
    if max_radius_m is not None:
        hits = hits.where(F.col("_d") <= max_radius_m)
    window = Window.partitionBy("qid")
    number = (F.rank().over(window.orderBy("distance_meter")) if ties
              else F.row_number().over(window.orderBy("distance_meter", "user_id")))
    return (
        hits.withColumn("distance_meter", geodesy.millimetres(F.col("_d")))
        .select("qid", "lat", "lng", "user_id", "latitude", "longitude", "distance_meter", "_d", "k", *keep)
        .withColumn("rank", number)
        # The literal bound lets each task drop all but max_k rows before the shuffle.
        .where((F.col("rank") <= max_k) & (F.col("rank") <= F.col("k")))
    )


def _thin_stacks(positions: DataFrame, max_k: int) -> DataFrame:
    """Drop positions that no result can hold: beyond the first ``max_k`` riders of a stack.

    Riders with equal coordinates are equally far from any query and rank by id, so a
    crowd on one spot (a depot, a default coordinate) is cut down in the map tasks.
    """
    stack = Window.partitionBy("lat", "lng").orderBy("user_id")
    return positions.withColumn("_n", F.row_number().over(stack)).where(F.col("_n") <= max_k)


def _crowd(positions: DataFrame, max_radius_m: float, metric: str) -> tuple[int, int]:
    """The number of positions, and the most in any cell of the size of the cap."""
    level = cube.level_for(geodesy.chord_of(F.lit(max_radius_m), metric))
    cells = cube.with_index(cube.with_vector(positions, "lat", "lng", "_p"), "_p", "_f")
    held = cells.groupBy(cube.cell_at("_f", level).alias("cell")).agg(F.count("*").alias("cnt"))
    total, most = held.agg(F.sum("cnt"), F.max("cnt")).head()
    return total or 0, most or 0


def block_members(counts: DataFrame) -> DataFrame:
    """Blocks of two cells per axis with their cells of the next level: ``_block, ix, iy, iz, cnt``.

    A cell takes part in two blocks per axis. A block is named by its level and its lowest
    cell plus one, as blocks reach one cell over the edge. Cells with a single position,
    which is most of the fine ones, are left out: counts only have to be lower bounds, and
    a block that needs them gives way to the next larger one.
    """
    level = F.col("level")
    indexes = cube.indexes_of(F.col("cell"), level)
    members = counts.where((level > 0) & (F.col("cnt") > 1)).select(
        "level", "cnt", *[i.alias(f"i{a}") for a, i in zip(cube.AXES, indexes)]
    )
    for a in cube.AXES:
        parent = cube.coarser(F.col(f"i{a}"), F.lit(1))
        members = members.withColumn(f"b{a}", F.explode(F.array(parent, parent + 1)))
    block = cube.cell_id(level, F.col("bx"), F.col("by"), F.col("bz"))
    return members.select(block.alias("_block"), "ix", "iy", "iz", "cnt")


def _with_bound(
    queries: DataFrame, positions: DataFrame, metric: str, max_radius_m: float | None
) -> DataFrame:
    """Queries with ``_chord``, a length that reaches the k-th neighbour for certain."""
    cap, top = 2.0, 0  # the whole globe
    if max_radius_m is not None:
        pad = geodesy.SPHEROID_PAD if metric == "spheroid" else 1.0
        cap = 2.0 * math.sin(min(max_radius_m * pad / (2 * geodesy.EARTH_RADIUS_M), math.pi / 2))
        # Cells larger than the cap tell nothing.
        top = min(cube.MAX_LEVEL - 1, max(0, math.floor(1 - math.log2(max(cap, 1e-9)))))
    members = block_members(pyramid(places(spread(positions, "user_id")), top))
    blocks = members.groupBy("_block").agg(F.sum("cnt").alias("_n"))

    half = cube.MAX_LEVEL + 1  # slices of half a finest cell
    q = cube.with_index(
        cube.with_vector(spread(queries, "qid"), "lat", "lng", "_v"), "_v", "_f", half
    )
    level = F.col("_level")

    def low(axis: str) -> Column:
        """Lowest cell plus one of the block whose middle half holds the query."""
        halves = cube.coarser(F.col(f"_f{axis}"), F.lit(cube.MAX_LEVEL) - level)
        return cube.coarser(halves + 1, F.lit(1))

    block = cube.cell_id(level + 1, *[low(a) for a in cube.AXES]).alias("_block")
    levels = F.sequence(F.lit(top), F.lit(cube.MAX_LEVEL - 1))
    finest = (
        q.select("qid", "k", *[f"_f{a}" for a in cube.AXES], F.explode(levels).alias("_level"))
        .select("qid", "k", "_level", block)
        .join(blocks, "_block")
        .where(F.col("_n") >= F.col("k"))
        .groupBy("qid").agg(F.max("_level").alias("_level"))
    )
    # Farthest corner of each member cell, in sides of the members' level.
    n = cube.slices(level + 1)
    far = F.lit(0.0)
    for a in cube.AXES:
        t = (F.col(f"_v{a}") + 1.0) * n * 0.5 - F.col(f"i{a}") - 0.5
        far = far + F.pow(F.abs(t) + 0.5, 2)
    # On the spheroid a neighbour at the bound may lie a little farther on the sphere.
    wider = 1.0 if metric == "sphere" else geodesy.SPHEROID_PAD * geodesy.SPHEROID_PAD
    reach = F.sqrt(far) / n * F.lit(2.0 * wider) + F.lit(REACH_SLACK)
    nearest_first = Window.partitionBy("qid").orderBy("_reach")
    enough = F.sum("cnt").over(nearest_first) >= F.col("k")
    chord = F.least(F.lit(cap), F.coalesce(F.min(F.when(F.col("_enough"), F.col("_reach"))),
                                           F.lit(cap)))
    return (
        q.join(finest, "qid", "left")
        .select("qid", "lat", "lng", "k", *[f"_v{a}" for a in cube.AXES], "_level", block)
        .join(members, "_block", "left")
        .select("qid", "lat", "lng", "k", "cnt", reach.alias("_reach"))
        .withColumn("_enough", enough)
        .groupBy("qid", "lat", "lng", "k").agg(chord.alias("_chord"))
    )
