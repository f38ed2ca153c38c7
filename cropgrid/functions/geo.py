"""Distances on the sphere and polygon centroids, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Fixed value: mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0088


def half_chord(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Haversine of the central angle: grows with distance and needs no arc tangent."""
    lat_a, lon_a, lat_b, lon_b = (F.radians(col(c)) for c in (lat_a, lon_a, lat_b, lon_b))
    s_lat, s_lon = F.sin((lat_b - lat_a) / 2), F.sin((lon_b - lon_a) / 2)
    return s_lat * s_lat + F.cos(lat_a) * F.cos(lat_b) * s_lon * s_lon


def chord_to_km(h: Column) -> Column:
    h = F.least(h, F.lit(1.0))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_km(lat_a, lon_a, lat_b, lon_b) -> Column:
    return chord_to_km(half_chord(lat_a, lon_a, lat_b, lon_b))


def wrap_longitude(c) -> Column:
    """Longitude in -180..180."""
    return F.pmod(col(c) + 180.0, F.lit(360.0)) - 180.0


RING = "array<array<double>>"
MOMENTS = "struct<a:double,x:double,y:double>"


def _ring_moments(ring: Column, sign: Column) -> Column:
    """Signed doubled area and first moments of one ring.

    Coordinates are taken relative to the ring's first vertex to keep precision, and the sign is
    set by the ring's role (outer ring adds, hole subtracts), not by its drawing direction.
    """
    x0, y0 = ring[0][0], ring[0][1]
    edges = F.transform(
        F.sequence(F.lit(0), F.size(ring) - 2),
        lambda i: F.struct(
            (ring[i][0] - x0).alias("px"), (ring[i][1] - y0).alias("py"),
            (ring[i + 1][0] - x0).alias("qx"), (ring[i + 1][1] - y0).alias("qy"),
        ),
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc, e):
        cross = e.px * e.qy - e.qx * e.py
        return F.struct(
            (acc.a + cross).alias("a"),
            (acc.x + (e.px + e.qx) * cross).alias("x"),
            (acc.y + (e.py + e.qy) * cross).alias("y"),
        )

    def finish(m):
        turn = F.signum(m.a) * sign
        return F.struct(
            (m.a * turn).alias("a"),
            (turn * (m.x + 3 * m.a * x0)).alias("x"),
            (turn * (m.y + 3 * m.a * y0)).alias("y"),
        )

    return F.aggregate(edges, zero, add, finish)


def _length_moments(ring: Column) -> Column:
    edges = F.transform(
        F.sequence(F.lit(0), F.size(ring) - 2),
        lambda i: F.struct(
            F.hypot(ring[i + 1][0] - ring[i][0], ring[i + 1][1] - ring[i][1]).alias("a"),
            ((ring[i][0] + ring[i + 1][0]) / 2).alias("x"),
            ((ring[i][1] + ring[i + 1][1]) / 2).alias("y"),
        ),
    )
    return F.transform(
        edges, lambda e: F.struct(e.a.alias("a"), (e.x * e.a).alias("x"), (e.y * e.a).alias("y"))
    )


def _total(moments: Column, name: str) -> Column:
    return F.aggregate(moments, F.lit(0.0), lambda acc, m: acc + m[name])


def polygons_of(geometry: Column | str) -> Column:
    """GeoJSON text of a Polygon or MultiPolygon as an array of polygons (arrays of rings)."""
    geometry = col(geometry)
    kind = F.get_json_object(geometry, "$.type")
    one = F.from_json(geometry, f"struct<coordinates:array<{RING}>>")["coordinates"]
    many = F.from_json(geometry, f"struct<coordinates:array<array<{RING}>>>")["coordinates"]
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def centroid(geometry: Column | str) -> Column:
    """``struct(longitude, latitude)`` of the area-weighted centroid; NULL for empty geometry.

    Holes subtract. A geometry without area falls back to its length-weighted centroid and then
    to its first vertex.
    """
    polygons = polygons_of(geometry)
    rings = F.filter(
        F.flatten(
            F.transform(
                polygons,
                lambda p: F.transform(
                    p,
                    lambda ring, i: F.struct(
                        ring.alias("ring"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")
                    ),
                ),
            )
        ),
        lambda r: F.size(r.ring) >= 2,
    )
    areas = F.transform(rings, lambda r: _ring_moments(r.ring, r.sign))
    lengths = F.flatten(F.transform(rings, lambda r: _length_moments(r.ring)))
    area, length = _total(areas, "a"), _total(lengths, "a")
    first = F.element_at(rings, 1)["ring"]

    def axis(name: str, index: int) -> Column:
        return (
            F.when(area != 0, _total(areas, name) / (3 * area))
            .when(length != 0, _total(lengths, name) / length)
            .otherwise(first[0][index])
        )

    return F.when(
        F.size(rings) > 0,
        F.struct(axis("x", 0).alias("longitude"), axis("y", 1).alias("latitude")),
    )
