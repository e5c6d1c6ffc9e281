"""Regions on the earth as Column predicates. A row without both coordinates never matches."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)
MAX_POLYGONS, MAX_VERTICES = 64, 4096
Point = tuple[float, float]  # latitude, longitude; as a centre, a row may also bring its own as Columns


def point(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Coordinates as doubles; both NULL unless both are there."""
    there = lat.isNotNull() & lng.isNotNull()
    return F.when(there, lat.cast("double")), F.when(there, lng.cast("double"))


def validate_geo(geo: dict) -> dict:
    """Exactly one of radius, bounds, polygons, with sound values; raises ValueError."""
    given = [k for k in ("radius", "bounds", "polygons") if geo.get(k) is not None]
    if len(given) != 1 or set(geo) - {"radius", "bounds", "polygons"}:
        raise ValueError("a region is exactly one of radius, bounds and polygons")

    def check(p: Point) -> None:
        if not (-90 <= p[0] <= 90 and -180 <= p[1] <= 180):
            raise ValueError(f"no such place: {p}")

    if given == ["radius"]:
        check(geo["radius"]["center"])
        if not geo["radius"]["meters"] > 0:
            raise ValueError("a radius is positive")
    elif given == ["bounds"]:
        sw, ne = geo["bounds"]["sw"], geo["bounds"]["ne"]
        check(sw)
        check(ne)
        if not (sw[0] < ne[0] and sw[1] < ne[1]):
            raise ValueError("the south-west corner lies south and west of the north-east corner")
    else:
        rings = geo["polygons"]
        if not 1 <= len(rings) <= MAX_POLYGONS or sum(map(len, rings)) > MAX_VERTICES:
            raise ValueError("1 to 64 polygons with at most 4096 vertices in all")
        for ring in rings:
            if len(ring) < 3:
                raise ValueError("a polygon has three vertices or more")
            for p in ring:
                check(p)
    return geo


def within_bounds(lat: Column, lng: Column, sw: Point, ne: Point) -> Column:
    return lat.between(sw[0], ne[0]) & lng.between(sw[1], ne[1])


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def geodesic(lat: Column, lng: Column, center: Point, turns: int = 12) -> Column:
    """Metres on the WGS84 spheroid by Vincenty's inverse formula; NULL where it does not settle (near antipodes)."""
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (_column(center[0]), lat))
    span = F.radians(lng - _column(center[1]))
    place = F.struct(F.sin(u2).alias("s"), F.cos(u2).alias("c"), span.alias("l"), F.sin(u1).alias("s1"), F.cos(u1).alias("c1"))

    def terms(p: Column, lam: Column) -> dict[str, Column]:
        s2, c2, su1, cu1 = p["s"], p["c"], p["s1"], p["c1"]
        sin_sigma = F.sqrt(F.pow(c2 * F.sin(lam), 2) + F.pow(cu1 * s2 - su1 * c2 * F.cos(lam), 2))
        cos_sigma = su1 * s2 + cu1 * c2 * F.cos(lam)
        sin_alpha = F.when(sin_sigma == 0, 0.0).otherwise(cu1 * c2 * F.sin(lam) / sin_sigma)
        cos2_alpha = 1 - sin_alpha * sin_alpha
        middle = F.when(cos2_alpha < 1e-12, 0.0).otherwise(cos_sigma - 2 * su1 * s2 / cos2_alpha)
        return {"ss": sin_sigma, "cs": cos_sigma, "sa": sin_alpha, "c2": cos2_alpha, "m": middle}

    def let(value: Column, f) -> Column:  # the array of one is a LET
        return F.transform(F.array(value), f)[0]

    def turn(p: Column, lam: Column) -> Column:
        t = F.struct(*[v.alias(k) for k, v in terms(p, lam).items()])

        def step(x: Column) -> Column:
            c = FLATTENING / 16 * x["c2"] * (4 + FLATTENING * (4 - 3 * x["c2"]))
            sigma = F.atan2(x["ss"], x["cs"])
            return p["l"] + (1 - c) * FLATTENING * x["sa"] * (sigma + c * x["ss"] * (x["m"] + c * x["cs"] * (-1 + 2 * x["m"] * x["m"])))

        return let(t, step)

    def metres(p: Column, state: Column) -> Column:
        t = F.struct(*[v.alias(k) for k, v in terms(p, state["now"]).items()])

        def last(x: Column) -> Column:
            sq = x["c2"] * ((A * A - B * B) / (B * B))
            big_a = 1 + sq / 16384 * (4096 + sq * (-768 + sq * (320 - 175 * sq)))
            big_b = sq / 1024 * (256 + sq * (-128 + sq * (74 - 47 * sq)))
            cube = big_b / 6 * x["m"] * (-3 + 4 * x["ss"] * x["ss"]) * (-3 + 4 * x["m"] * x["m"])
            delta = big_b * x["ss"] * (x["m"] + big_b / 4 * (x["cs"] * (-1 + 2 * x["m"] * x["m"]) - cube))
            return B * big_a * (F.atan2(x["ss"], x["cs"]) - delta)

        return F.when(F.abs(state["now"] - state["before"]) < 1e-9, let(t, last))

    def solve(p: Column) -> Column:
        start = F.struct(p["l"].alias("now"), (p["l"] + 1).alias("before"))
        state = F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda s, _: F.struct(turn(p, s["now"]).alias("now"), s["now"].alias("before")))
        return let(state, lambda s: metres(p, s))

    return let(place, solve)


def sphere(lat: Column, lng: Column, center: Point) -> Column:
    """Metres on the sphere of the mean radius, by the haversine formula."""
    clat, clng = map(_column, center)
    a = F.pow(F.sin(F.radians(lat - clat) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(clat)) * F.pow(F.sin(F.radians(lng - clng) / 2), 2)
    return 2 * (2 * A + B) / 3 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_radius(lat: Column, lng: Column, center: Point, meters: float) -> Column:
    """Geodesic distance of at most ``meters``. A box of latitudes (and longitudes off the poles) is tested first."""
    reach = math.degrees(meters / (B * 0.99))
    box = lat.between(center[0] - reach, center[0] + reach)
    widest = min(90.0, abs(center[0]) + reach)
    if widest < 89 and reach / math.cos(math.radians(widest)) < 180 - abs(center[1]):
        side = reach / math.cos(math.radians(widest))
        box = box & lng.between(center[1] - side, center[1] + side)
    return box & reached(lat, lng, center, F.lit(float(meters)))


def reached(lat: Column, lng: Column, center: tuple, meters: Column) -> Column:
    """Geodesic distance of at most ``meters``, without a box; centre and metres may be a row's own."""
    # the spheroid's distance is that of a sphere to within 0.6 percent, so the long formula is for a narrow ring only
    far = sphere(lat, lng, center)
    ring = F.when(far <= meters * 0.993, True).when(far >= meters * 1.007, False).otherwise(F.coalesce(geodesic(lat, lng, center) <= meters, F.lit(False)))
    return F.coalesce(ring, F.lit(False))


def _closed(ring: list[Point]) -> list[Point]:
    return ring if ring[0] == ring[-1] else [*ring, ring[0]]


def within_polygon(lat: Column, lng: Column, ring: list[Point], decimal: bool = False) -> Column:
    """Inside or on the edge, by the even-odd rule in the plane of longitude and latitude; open rings are closed.

    Whether a place is on a slanted edge is decided by the last bit of its numbers. If ``decimal``, the edges are met relative to the ring's south-west corner and
    vertices are decimals there: 30.9 - 30.5 is 0.4, as in SQL with decimals, and not a few units in the last place less. Corners and the given edges count in any case.
    """
    ring = _closed([(float(a), float(b)) for a, b in ring])
    sw, ne = tuple(min(p[i] for p in ring) for i in (0, 1)), tuple(max(p[i] for p in ring) for i in (0, 1))
    edges = lambda points: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y1", "x1", "y2", "x2"), (*a, *b), strict=True)]) for a, b in zip(points, points[1:], strict=False)])
    box = within_bounds(lat, lng, sw, ne)
    if not decimal:
        return box & enclosed(lat, lng, edges(ring))
    local = [(round(a - sw[0], 12), round(b - sw[1], 12)) for a, b in ring]
    return box & (enclosed(lat - sw[0], lng - sw[1], edges(local)) | on_edges(lat, lng, edges(ring)))


def on_edges(lat: Column, lng: Column, edges: Column) -> Column:
    """On one of ``edges``, an array of (y1, x1, y2, x2)."""

    def on_edge(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lng - e["x1"])
        return (cross == 0) & lng.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(edges, on_edge)


def enclosed(lat: Column, lng: Column, edges: Column) -> Column:
    """Inside or on one of ``edges``, an array of (y1, x1, y2, x2). Only edges that reach the point's latitude count, so these are enough."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > lat) != (e["y2"] > lat)
        return spans & (lng < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd | on_edges(lat, lng, edges)


def within_polygons(lat: Column, lng: Column, rings: list[list[Point]], decimal: bool = False) -> Column:
    return reduce(Column.__or__, [within_polygon(lat, lng, r, decimal) for r in rings])


def region(lat: Column, lng: Column, geo: dict | None, decimal: bool = False) -> Column:
    """The predicate of a validated region; none means all rows. ``decimal`` is for polygons, see ``within_polygon``."""
    if geo is None:
        return F.lit(True)
    validate_geo(geo)
    lat, lng = point(lat, lng)
    if geo.get("radius"):
        found = within_radius(lat, lng, geo["radius"]["center"], geo["radius"]["meters"])
    elif geo.get("bounds"):
        found = within_bounds(lat, lng, geo["bounds"]["sw"], geo["bounds"]["ne"])
    else:
        found = within_polygons(lat, lng, geo["polygons"], decimal)
    return F.coalesce(found, F.lit(False))
