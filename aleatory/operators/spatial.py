"""Point patterns: pairs by grids of cells, so that points only meet those on a circle around them; and great circles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import gamma_p, gamma_q
from ..functions.skip import GOLDEN, field
from . import quadtree

EARTH_RADIUS_M = 6371008.8


#: Points that a block of a field should hold, and pairs that are compared at a time.
BLOCK, PAIRS = 1 << 17, 1 << 20


def _later_pairs(own: np.ndarray, cx: np.ndarray, cy: np.ndarray, x: np.ndarray, y: np.ndarray, x0: float, y0: float, side: float, radius: float) -> int:
    """Pairs of an own point with a later one, by (cell row, cell column, index), within ``radius``; points come in that order.

    Cells of a row that lie wholly within the radius of a point count by their
    number of points; only points of the cells on the circle are compared.
    """
    left, low = int(cx.min()), int(cy.min())
    wide, high = int(cx.max()) - left + 1, int(cy.max()) - low + 1
    start = np.append(np.searchsorted((cy - low) * wide + (cx - left), np.arange(wide * high)), len(x))
    me = np.flatnonzero(own)
    px, py, row = (x[me] - x0) / side - left, (y[me] - y0) / side - low, cy[me] - low  # in cells
    r, slack, found = radius / side, 1e-6, 0
    for d in range(int(r) + 2):
        to = row + d
        near = np.maximum(to - py, 0.0) if d else np.zeros(len(me))
        far = np.maximum(np.abs(to + 1 - py), np.abs(to - py))
        some = np.flatnonzero((to < high) & (near <= r + slack))
        if not len(some):
            continue
        i, base, at = me[some], to[some] * wide, px[some]
        reach = np.sqrt(np.maximum(r * r - near[some] ** 2, 0)) + slack
        inner = np.sqrt(np.maximum(r * r - far[some] ** 2, 0)) - slack
        edge = lambda c: start[base + np.clip(c, 0, wide).astype(np.int64)]
        a, z = edge(np.floor(at - reach)), edge(np.floor(at + reach) + 1)
        b, c = edge(np.ceil(at - inner)), edge(np.floor(at + inner))
        flat = (inner <= 0) | (c <= b)  # no cell wholly within
        b, c = np.where(flat, z, b), np.where(flat, z, c)
        if d == 0:
            a, b, c, z = (np.maximum(v, i + 1) for v in (a, b, c, z))
        found += int((c - b).sum())
        for lo, hi in ((a, b), (c, z)):
            many = np.maximum(hi - lo, 0)
            ends = np.cumsum(many)
            done = 0
            while done < len(i):
                before = int(ends[done - 1]) if done else 0
                upto = max(int(np.searchsorted(ends, before + PAIRS, "right")), done + 1)
                n = many[done:upto]
                p = np.repeat(i[done:upto], n)
                q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[done:upto], n)
                dx, dy = x[p] - x[q], y[p] - y[q]
                found += int((dx * dx + dy * dy <= radius * radius).sum())
                done = upto
    return found


def _pairs_by(points: DataFrame, by: str, radii: list[float], block: int = BLOCK) -> DataFrame:
    """``(by, radius, c)``: ordered pairs of different points within each radius, of each field that has any.

    Fields are cut to square blocks of about ``block`` points, if these lie
    evenly; a block gets the points around it. Cells hold about a point, so a
    field of n points costs about n**1.5 comparisons, none of them a row.
    """
    most = points.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    n, x0, x1, y0, y1 = most.agg(F.max("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    out = f"`{by}` {dict(points.dtypes)[by]}, radius double, c bigint"
    if not n:
        return points.sparkSession.createDataFrame([], out)
    reach = max(radii)
    extent = max(x1 - x0, y1 - y0, reach)
    side = max(math.sqrt(max((x1 - x0) * (y1 - y0), extent * extent / n) / n), extent / (1 << 20))
    halo = int(reach / side) + 2
    cells = max(math.ceil(extent / side * math.sqrt(min(block / n, 1.0))) + 1, 2 * halo if n > block else 1)
    cell = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(side))
    p = points.select(by, "x", "y", cell("x", x0).alias("cx"), cell("y", y0).alias("cy"))
    spread = lambda low, high: F.explode(F.sequence(F.floor(low / cells), F.floor(high / cells)))
    dealt = p.withColumn("bx", spread(F.col("cx") - halo, F.col("cx") + halo)).withColumn("by_", spread(F.col("cy") - halo, F.col("cy")))

    def count(table: pa.Table) -> pa.Table:
        cx, cy, x, y = (table.column(c).to_numpy() for c in ("cx", "cy", "x", "y"))
        own = (cx // cells == table.column("bx")[0].as_py()) & (cy // cells == table.column("by_")[0].as_py())
        order = np.lexsort((cx, cy))
        found = [2 * _later_pairs(*(v[order] for v in (own, cx, cy, x, y)), x0, y0, side, r) if own.any() else 0 for r in radii]
        return pa.table({by: table.column(by).combine_chunks().slice(0, 1).take(pa.array([0] * len(radii))), "radius": pa.array([float(r) for r in radii]), "c": pa.array(found, pa.int64())})

    return dealt.groupBy(by, "bx", "by_").applyInArrow(count, out).groupBy(by, "radius").agg(F.sum("c").alias("c"))


def nearest(points: DataFrame, area: float, n: int) -> DataFrame:
    """``(id, d)`` to the nearest other point, however densely they lie."""
    if n < 2:
        raise ValueError("at least 2 points")
    return quadtree.nearest(points)


def clark_evans(points: DataFrame, area: float, n: int) -> DataFrame:
    """``(n, mean, expected, ratio, z)`` of nearest-neighbour distances."""
    density = n / area
    expected = 1 / (2 * math.sqrt(density))
    m = nearest(points, area, n).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    return m.select("n", "mean", F.lit(expected).alias("expected"), (F.col("mean") / expected).alias("ratio"), ((F.col("mean") - expected) / (0.26136 / math.sqrt(n * density))).alias("z"))


def ripley_l(points: DataFrame, area: float, n: int, radii: list[float]) -> DataFrame:
    """``(radius, l)``: L(r) - r without edge correction."""
    count = quadtree.pair_counts(points.select("id", "x", "y"), radii)
    return count.select("radius", (F.sqrt(F.col("pairs") * (area / n / n / math.pi)) - F.col("radius")).alias("l"))


def ripley_l_by(points: DataFrame, by: str, area: float, radii: list[float]) -> DataFrame:
    """``(by, radius, l)`` of every field in one pass; a field without pairs within a radius has l = -radius."""
    steps = F.explode(F.array(*map(lambda r: F.lit(float(r)), radii))).alias("radius")
    pair = _pairs_by(points, by, radii)
    sizes = points.groupBy(by).agg(F.count("*").alias("n")).select(by, "n", steps)
    out = sizes.join(pair, [by, "radius"], "left")
    n = F.col("n").cast("double")
    return out.select(by, "radius", (F.sqrt(F.coalesce("c", F.lit(0)) * area / n / n / math.pi) - F.col("radius")).alias("l"))


def csr_envelope(spark: SparkSession, n: int, width: float, height: float, radii: list[float], runs: int = 99, seed: int = GOLDEN) -> DataFrame:
    """``(radius, low, high)``: range of L(r) - r over ``runs`` fields of ``n`` points at random, drawn from one seeded chain by many tasks."""
    every = ripley_l_by(field(spark, runs, n, width, height, seed), "run", width * height, radii)
    return every.groupBy("radius").agg(F.min("l").alias("low"), F.max("l").alias("high"))


def csr_test(points: DataFrame, n: int, width: float, height: float, radii: list[float], runs: int = 99, seed: int = GOLDEN) -> DataFrame:
    """``(radius, l, low, high, outside)``: L(r) - r of ``n`` points and whether it leaves the envelope of simulated fields of as many points, at a level of about 2 / (runs + 1)."""
    envelope = csr_envelope(points.sparkSession, n, width, height, radii, runs, seed)
    out = ripley_l(points, width * height, n, radii).join(envelope, "radius")
    return out.select("radius", "l", "low", "high", (~F.col("l").between(F.col("low"), F.col("high"))).alias("outside"))


def neighbour_counts(points: DataFrame, radius: float) -> DataFrame:
    return points.select("id", "x", "y").join(quadtree.neighbour_counts(points, radius), "id")


def attractors(points: DataFrame, area: float, n: int, expected: float = 4.0) -> DataFrame:
    """The points of most and of fewest neighbours within the radius that has ``expected`` on average (ties to the smaller id), with Poisson tails."""
    radius = math.sqrt(expected * area / n / math.pi)
    c = neighbour_counts(points, radius)
    key = F.struct("neighbours", -F.col("id"))
    most = c.agg(F.max_by(F.struct("id", "neighbours"), key).alias("p")).select(F.lit("attractor").alias("kind"), "p.*")
    least = c.agg(F.min_by(F.struct("id", "neighbours"), F.struct("neighbours", "id")).alias("p")).select(F.lit("void").alias("kind"), "p.*")
    k, mu = F.col("neighbours").cast("double"), F.lit(float(expected))
    tail = F.when(F.col("kind") == "void", gamma_q(k + 1, mu)).when(k >= 1, gamma_p(F.greatest(k, F.lit(1.0)), mu)).otherwise(1.0)
    return most.unionByName(least).withColumn("p", tail)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    dx, dy = F.radians(lon2 - lon1), b - a
    h = F.sin(dy / 2) * F.sin(dy / 2) + F.cos(a) * F.cos(b) * F.sin(dx / 2) * F.sin(dx / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> Column:
    """Struct (lat, lon), longitude in [-180, 180)."""
    a, o, t, d = F.radians(lat), F.radians(lon), F.radians(bearing), metres / EARTH_RADIUS_M
    y = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    x = o + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(y))
    return F.struct(F.degrees(y).alias("lat"), (F.pmod(F.degrees(x) + 540, F.lit(360.0)) - 180).alias("lon"))


def region_area(kind: str = "kind") -> Column:
    """Area of a rectangle (width, height) or a disk (radius)."""
    return F.when(F.col(kind) == "disk", math.pi * F.col("radius") * F.col("radius")).otherwise(F.col("width") * F.col("height"))


def valid_region(kind: str = "kind") -> Column:
    """Whether a region's own measures are finite and over 0."""
    fine = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    return F.when(F.col(kind) == "disk", fine("radius")).otherwise(fine("width") & fine("height"))


def point_to_place(lat: Column, lon: Column, x: Column, y: Column) -> Column:
    """Latitude and longitude of the point x metres east and y metres north of a place."""
    return destination(lat, lon, F.degrees(F.atan2(x, y)), F.hypot(x, y))
